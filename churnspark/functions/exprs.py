"""Row-wise column expressions (JVM side, codegen friendly).

Every helper returns a ``pyspark.sql.Column``; nothing here touches data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import config as C

# A plain decimal or scientific number, optionally signed. Strings such as
# "nan", "inf", "1d" or "1_000" are not numbers for the cleaner in any engine.
NUMBER_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_name(name: str) -> str:
    """CLN1: strip, lower, blanks and dashes to underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def clean_names(df: DataFrame) -> DataFrame:
    """CLN1 on a whole frame; refuses to create duplicate names."""
    new = [clean_name(c) for c in df.columns]
    dupes = sorted({n for n in new if new.count(n) > 1})
    if dupes:
        raise ValueError(f"column names collide after cleaning: {dupes}")
    return df.toDF(*new)


def strip(col: Column) -> Column:
    """White space of any kind (tabs, line ends) off both ends; ``trim`` removes blanks only."""
    return F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")


def norm_str(col: Column | str) -> Column:
    """lower(strip(cast(c as string)))."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(strip(c))


def numeric_string(col: Column | str) -> Column:
    """CLN2: ``' 1,234.50 '`` -> 1234.5; anything that is not a number -> null."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(strip(c), ",", "")
    v = F.when(s.rlike(NUMBER_RE), s.try_cast("double"))
    # overflowing literals such as 1e400 are not numbers either
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def bool_map_expr(col: Column | str) -> Column:
    """CLN3: boolean-like strings -> 0/1 integer; anything else -> null."""
    s = norm_str(col)
    expr = None
    for word, val in C.BOOL_MAP.items():
        expr = (F.when(s == word, F.lit(val)) if expr is None
                else expr.when(s == word, F.lit(val)))
    return expr.cast("int")


def strict_target(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """CLN4: yes/no, true/false, 1/0 -> 0/1; everything else (null too) -> null.

    Numeric targets are accepted when their value is exactly 0 or 1, so a
    0/1 column that was read as double still works.
    """
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and isinstance(dtype, T.NumericType):
        d = c.cast("double")
        return F.when(d == 1.0, F.lit(1)).when(d == 0.0, F.lit(0)).cast("int")
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast("int")
    s = norm_str(c)
    expr = None
    for word, val in C.STRICT_TARGET_MAP.items():
        expr = (F.when(s == word, F.lit(val)) if expr is None
                else expr.when(s == word, F.lit(val)))
    return expr.cast("int")


def lenient_target(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """CLN5: numeric != 0 -> 1; strings in the positive word set -> 1; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    if dtype is not None and isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.when(c.isNotNull(), (c.cast("double") != 0).cast("int"))
    return F.when(c.isNotNull(), norm_str(c).isin(C.LENIENT_POSITIVE).cast("int"))


def summary_target(col: Column | str) -> Column:
    """CLN6: 1 when lower(trim(c)) is one of the summary churn words, else 0."""
    return F.coalesce(norm_str(col).isin(C.SUMMARY_POSITIVE), F.lit(False)).cast("int")


def fill(template: str, **values: Column) -> Column:
    """A fixed sentence with ``{name}`` placeholders filled by string columns (concat of pieces)."""
    import re
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(values[piece[1:-1]].cast("string"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)
