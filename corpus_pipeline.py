"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, token files.

Each stage is written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm import decontaminate, mix, near_dup, quality, token_file
from churnspark.llm.common import read, scratch
from churnspark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host does."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five-word shingles, containment 0.8)."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources at their target weights: one row per document and copy, with the text taken, in shard and place order."""
    return mix.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture in its order (shard after shard, by place), read back: doc_id, start, n_tokens, ids_crc32 of every row.

    The order is that of the mixing stage's files and of the rows in them (of the partitions and their rows, if ``docs`` is not read from files)."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        placed = docs.select("doc_id", "text", F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    return token_file.round_trip(placed, tokenizer_path(), end_id=2, order=("file", "row"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", token_output)]
#: The last stage is a tokenizer: no SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
