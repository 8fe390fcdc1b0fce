"""Statistical helpers Spark SQL has no built-in for, as Arrow-batched pandas UDFs.

They run on tiny per-feature summaries (one row per column).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark.functions.chi2 import chi2_isf, chi2_sf  # noqa: F401


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(chi2, dof)], dtype="float64")
