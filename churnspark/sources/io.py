"""Readers and writers (SRC1-SRC5, SNK1-SNK3).

Uploads are CSV files of any size: the delimiter is sniffed from the first
line of each file (SRC2), the encoding falls back from UTF-8 to ISO-8859-1
where the bytes are not valid UTF-8 (SRC3; latin-1 decodes any byte, so the
original's last fallback is unreachable), and header names are trimmed and
stripped of a byte-order mark (SRC4). Outputs go to the shared output folder
(never a machine-local temporary folder): CSV/Parquet for predictions, JSON
for reports, Spark ML ``save`` for models.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: candidate delimiters in tie-break order ------------------------------
DELIMITERS = [",", ";", "\t", "|"]
BOM = "﻿"
# --- fixed values: words that stand for a missing value in uploads -----------------------
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                 "NaN", "None", "n/a", "nan", "null"]


def delimiter_expr(line: Column) -> Column:
    """SRC2: the most frequent of , ; tab | in a line (ties by that order); none -> ','."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    best = F.lit(DELIMITERS[0])
    best_n = counts[0]
    for d, c in zip(DELIMITERS[1:], counts[1:]):
        best = F.when(c > best_n, F.lit(d)).otherwise(best)
        best_n = F.greatest(best_n, c)
    return F.when(best_n > 0, best).otherwise(F.lit(","))


def first_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file_path, first line) of every file under ``path``; each file contributes its first line only."""
    txt = spark.read.option("encoding", encoding).text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"))
    first_block = txt.filter(F.col("block") == 0)
    # the first row of block 0 of each file: min over a per-split sequence number
    seq = first_block.withColumn("__i", F.monotonically_increasing_id())
    return seq.groupBy("file_path").agg(F.min_by("value", "__i").alias("line"))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    # the most common delimiter over all files' first lines: at most four rows reach the driver
    counts = first_lines(spark, path).select(delimiter_expr(F.col("line")).alias("d")).groupBy("d").count().collect()
    if not counts:
        return ","
    order = {d: i for i, d in enumerate(DELIMITERS)}
    return max(counts, key=lambda r: (r["count"], -order[r["d"]]))["d"]


def clean_header(names: list[str]) -> list[str]:
    """SRC4: trim and drop a leading byte-order mark (also its latin-1 rendering)."""
    out = []
    for n in names:
        n = str(n).strip()
        for bom in (BOM, "ï»¿"):
            if n.startswith(bom):
                n = n[len(bom):]
        out.append(n)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """String columns as bigint, double, boolean or timestamp where every value parses; one aggregate over the frame."""
    kinds = {"bigint": lambda c: c.try_cast("bigint").isNotNull() & ~c.contains("."),
             "double": lambda c: c.try_cast("double").isNotNull() & c.rlike(r"^[+-]?[0-9.]"),
             "boolean": lambda c: F.lower(c).isin("true", "false"),
             "date": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(),
             "timestamp": lambda c: c.try_cast("timestamp").isNotNull() & c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]")}
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not names:
        return df
    fits = df.agg(*[F.bool_and(F.when(F.col(f"`{n}`").isNotNull(), test(F.col(f"`{n}`")))).alias(f"{k}_{i}") for i, n in enumerate(names) for k, test in kinds.items()]).first()
    types = {n: next((k for k in kinds if fits[f"{k}_{i}"]), None) for i, n in enumerate(names)}
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if types.get(c) else F.col(f"`{c}`") for c in df.columns])


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             infer_schema: bool = True, schema=None, embedded_newlines: bool = True) -> DataFrame:
    """SRC1: CSV with header, sniffed delimiter, the encoding fallback and the usual words for missing values.

    Quoted values may hold line breaks, so a file is read by one task; large uploads should come as many files, or the
    caller declares ``embedded_newlines=False`` and files are split. A file that is valid UTF-8 is read as UTF-8 whatever
    characters it holds.
    """
    sep = sep or sniff_delimiter(spark, path)
    if encoding is None:
        # the text source keeps raw bytes: invalid UTF-8 means another encoding
        bad = spark.read.text(path).filter(~F.is_valid_utf8(F.col("value"))).limit(1).count()
        encoding = "ISO-8859-1" if bad else "UTF-8"
    r = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
         .option("multiLine", embedded_newlines).option("mode", "PERMISSIVE"))
    if schema is not None:
        df = r.schema(schema).csv(path)
        return df.toDF(*clean_header(df.columns))
    df = r.option("inferSchema", False).csv(path)
    df = df.toDF(*clean_header(df.columns))
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return infer_types(df) if infer_schema else df


def shape_and_preview(df: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """SRC5: (rows, columns) and an n-row preview."""
    shape = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
    return shape, df.limit(n)


def output_root(spark: SparkSession) -> str:
    """The shared folder outputs go to: ``churnspark.output.dir`` or the checkpoint folder."""
    root = spark.conf.get("churnspark.output.dir", None)
    if not root:
        from churnspark.session import ensure_checkpoint_dir
        root = ensure_checkpoint_dir(spark)
    return root.rstrip("/")


def new_output_path(spark: SparkSession, name: str) -> str:
    return f"{output_root(spark)}/churnspark-out/{name}-{uuid.uuid4().hex[:12]}"


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """SNK1: predictions with a header, no index column."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_report(spark: SparkSession, report: dict, path: str) -> str:
    """SNK2: the report as one JSON document (a one-row frame)."""
    spark.createDataFrame([(json.dumps(report, default=str, sort_keys=True),)], "report string") \
        .coalesce(1).write.mode("overwrite").text(path)
    return path


def save_model(family, path: str) -> str:
    """SNK3: preprocessing plan (JSON) + the model (Spark ML's own writer, or one row per tree)."""
    where = os.path.join(path, "model")
    if family.name == "Logistic Regression":
        family.model.write().overwrite().save(where)
    else:
        family.model.save(where)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(family.prep.to_json(), family.name)], "prep string, family string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(path, "prep"))
    return path


def load_model(spark: SparkSession, path: str):
    from pyspark.ml.classification import LogisticRegressionModel
    from churnspark.operators.prep import PrepModel
    from churnspark.operators.train import FamilyResult
    from churnspark.operators.tree_search import TreeEnsembleModel
    meta = spark.read.json(os.path.join(path, "prep")).first()
    d = json.loads(meta["prep"])
    rare = d.pop("_rare", {})
    prep = PrepModel(**d)
    prep.__dict__["_rare"] = rare
    fam, where = meta["family"], os.path.join(path, "model")
    model = LogisticRegressionModel.load(where) if fam == "Logistic Regression" else TreeEnsembleModel.load(spark, where)
    return FamilyResult(fam, prep=prep, model=model)
