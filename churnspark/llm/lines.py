"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate and dropped.

Per host the pages containing each line are divided by the host's pages; a line is dropped from all pages of the host if
that ratio exceeds ``RATIO`` and at least ``MIN_PAGES`` pages hold it. Lines are compared without white space at
their ends; lines without a word are kept as they are.

Plan: text stays inside the scan, only (host, line hash) pairs cross the shuffle, distinct per page and partially
counted. A host has at most (lines per page) / RATIO boilerplate lines, so their hashes fit one array per host whatever its
pages; that table is joined to the documents by host, by broadcast only if counted small, else by a shuffle whose hot
hosts AQE splits.

Defined cases: null text gives an empty text and no line; null host is a host of its own; rows with the same id are pages
of their own; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import small, stored

RATIO = 0.05
MIN_PAGES = 3
_WORD = r"[^\x20\x09-\x0D]"


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = MIN_PAGES) -> DataFrame:
    """(host, line hash, pages with the line, pages of the host) of the lines to drop."""
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(_bare(x))))
    on = pages.select(F.col(host).alias("host"), F.explode(keys).alias("line"))
    counted = on.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy(F.col(host).alias("total_host")).agg(F.count(F.lit(1)).alias("host_pages"))
    totals = stored(totals, "lines-hosts")
    found = counted.filter(F.col("pages") >= least).join(small(totals), F.col("host").eqNullSafe(F.col("total_host")))
    return found.filter(F.col("pages") > F.lit(ratio) * F.col("host_pages")).select("host", "line", "pages", "host_pages")


def dedup_lines(docs: DataFrame, ratio: float = RATIO, least: int = MIN_PAGES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document without the boilerplate lines of its host."""
    bad = boilerplate(docs, ratio=ratio, least=least).groupBy("host").agg(F.collect_list("line").alias("__bad"))
    bad = stored(bad.withColumnRenamed("host", "__host"), "lines-bad")
    joined = docs.select("doc_id", "source", _lines("text").alias("__lines")).join(
        small(bad), F.col("source").eqNullSafe(F.col("__host")), "left")
    bad_array = F.coalesce("__bad", F.array().cast("array<bigint>"))
    keep = F.filter("__lines", lambda x: ~F.array_contains(bad_array, F.xxhash64(_bare(x))) | ~x.rlike(_WORD))
    kept = joined.select("doc_id", F.size("__lines").alias("n"), keep.alias("__kept"))
    return kept.select("doc_id", F.array_join("__kept", "\n").alias("text"), F.col("n").cast("long").alias("n_lines"),
                       (F.col("n") - F.size("__kept")).cast("long").alias("n_dropped"))
