"""Named inputs of the registered queries: which view, which target, which id."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from churnspark.sources import fixtures as FX


@dataclass(frozen=True)
class Input:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    target: str
    id_col: str | None


RAW = Input("customer_raw", FX.customer_raw, "Churn", "Customer ID")
CLEAN = Input("customer_features", FX.customer_features, "label", "c_custkey")
DOCS = Input("doc_features", FX.doc_features, "label", "doc_id")
