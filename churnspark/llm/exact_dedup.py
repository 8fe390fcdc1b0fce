"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition is a run: its rows' digests, sorted and merged to one entry per distinct text (best row, number of
rows). Runs are merged in binomial rounds: in round ``r`` the runs whose numbers agree but for their lowest ``r`` digits (base
``FAN``) exchange entries by digest, and every group of at most ``FAN`` entries of one digest becomes one. After the last
round an entry knows its whole group. The verdicts then go back down the same tree, entry to entry, and from the
entries of a run to the run's rows.

An entry is the digest (SHA-256 of the normalised text) with the text's length in bytes and a second, independent hash; all three
must agree at every level, so an identifier is kept only where the whole check holds. ``best`` orders rows by code points of the
original text (most first), then id (nulls last), then place in the input.

Plan: texts never leave the scan; entries are narrow. A text that a third of all rows share is one entry per run, no group
of a round has more than ``FAN`` rows, and no group of the last join more than a run's rows. Every level is a written table.

Defined cases: null text counts as empty; all texts without a character are one group; rows with the same id are rows of their own, one
of a group stays; a null id comes after all others (``keep_id`` is null only where all ids of the group are); empty table:
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import SPACE, stored

#: Runs merged by one step of a round, as a power of two.
FAN_BITS = 4
KEY = ("digest", "n_bytes", "check")


def bare(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def rows_of(docs: DataFrame) -> DataFrame:
    """One narrow row per document: place in the input, run, id, code points, digest entry."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("points"),
                       bare(F.col("text")).alias("bare"), F.monotonically_increasing_id().alias("place"),
                       F.spark_partition_id().alias("run"))
    return text.select("place", "run", "doc_id", "points", F.unhex(F.sha2("bare", 256)).alias("digest"),
                       F.octet_length("bare").alias("n_bytes"), F.xxhash64("bare").alias("check"))


def _best() -> Column:
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")


def merged(entries: DataFrame, node: Column) -> DataFrame:
    """One entry per (node, digest): the smallest ``best`` and the rows of all."""
    return entries.groupBy(node.alias("node"), *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document, dropped ones too."""
    rows = stored(rows_of(docs), "exact-rows")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [stored(merged(rows.select("run", *KEY, _best().alias("best"), F.lit(1).cast("long").alias("n")), F.col("run")), "exact-run")]
    while runs > 1:
        runs = -(-runs >> fan_bits)
        levels.append(stored(merged(levels[-1], F.shiftright("node", fan_bits)), "exact-round"))
    verdict = levels.pop()
    while levels:
        children = levels.pop().select("node", *KEY, F.shiftright("node", fan_bits).alias("parent"))
        verdict = children.join(verdict.withColumnRenamed("node", "parent"), ["parent", *KEY]).drop("parent")
    found = rows.join(verdict.withColumnRenamed("node", "run"), ["run", *KEY])
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("place") == F.col("best.place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
