"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact shingle containment.

The question is asymmetric: a short item inside a document that may be a thousand times longer, where the Jaccard
similarity of both is near zero and a document-side MinHash signature would need about as many samples as the document has
shingles. So, as in containment MinHash, the samples are drawn from the item only and looked up in the document. Items
are partitioned by size (powers of two of their distinct shingles); each item's signature is its ``m`` smallest
hash values, where ``m`` is the largest number of shingles that an item of its partition may miss at the threshold, plus
one. A document with the wanted containment then holds at least one sampled shingle of the item for certain (pigeonhole),
so the search loses nothing; candidates are confirmed on all shingles of the item (100 * found >= percent * size).

Plan: documents are hashed to shingle arrays inside the scan and probed with the samples, so text crosses no shuffle; only
candidate (document, item) shingles do. The samples come from the benchmark, whose size is counted: up to
``PROBE_LIMIT`` samples travel as a constant set inside the expression, beyond that documents are found by a shuffle join.

Normal form: A-Z lower-cased words between ASCII white space, five-word shingles; a text with fewer words is one shingle
(it matches only a text of the same words). Defined cases: null or empty items match nothing; null or empty documents
contain nothing; rows with a null id are never flagged and stay; repeated documents and items are each reported once by
id (several rows of one document id count together, of one item id the longest counts); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import SMALL_ROWS, ascii_lower, stored, words

#: Samples that may travel inside the plan as a constant set.
PROBE_LIMIT = 50_000


def _shingles(k: int) -> Column:
    """Distinct shingle hashes of the word array ``__w``."""
    inner = ", ".join(f"get(__w, i + {j})" for j in range(k))
    return F.expr(f"""array_distinct(case when size(__w) = 0 then cast(array() as array<bigint>)
        when size(__w) < {k} then array(xxhash64(__w))
        else transform(sequence(0, size(__w) - {k}), i -> xxhash64({inner})) end)""")


def shingled(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, h): distinct shingle hashes per row; Generate keeps later conditions out of the array expressions."""
    w = df.select(F.col(id_col).cast("long").alias("id"), words(ascii_lower(F.col(text_col))).alias("__w"))
    return w.select("id", F.inline(F.array(F.struct(_shingles(k).alias("h")))))


def item_samples(items: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Stored tables (item_id, size, h) of all item shingles, and of the sampled ones."""
    sets = shingled(items, "item_id", "text", k).filter("id is not null and size(h) > 0")
    sets = sets.groupBy("id").agg(F.max_by("h", F.struct(F.size("h"), F.xxhash64("h"))).alias("h"))  # one row per item id
    full = sets.select(F.col("id").alias("item_id"), F.size("h").cast("long").alias("size"), "h",
                       F.expr("cast(ceil(log2(size(h) + 1)) as int)").alias("part"))
    # partition p holds sizes 2^(p-1) .. 2^p - 1: its longest item may miss (100 - percent)% of 2^p - 1 shingles
    missing = F.expr(f"cast(floor((shiftleft(1L, part) - 1) * {100 - percent} / 100) as int)")
    picked = full.withColumn("m", missing)
    picked = picked.select("item_id", "size", F.expr(
        "transform(slice(array_sort(transform(h, x -> struct(xxhash64(x) as o, x as x))), 1, least(size(h), m + 1)), s -> s.x)"
    ).alias("h"))
    return (stored(full.select("item_id", "size", F.explode("h").alias("h")), "decon-items"),
            stored(picked.select("item_id", F.explode("h").alias("h")), "decon-samples"))


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, found, size, containment) of every item that a document contains to ``percent`` or more."""
    full, samples = item_samples(items, k, percent)
    sets = shingled(docs, "doc_id", "text", k).filter("id is not null")
    probe = samples.select("h").distinct().limit(PROBE_LIMIT + 1).collect()
    if len(probe) <= PROBE_LIMIT:
        values = [r["h"] for r in probe] or [0]
        touched = sets.filter(F.exists("h", lambda x: x.isin(values)))
    else:
        ids = sets.select("id", F.explode("h").alias("h")).join(samples.select("h").distinct(), "h").select("id").distinct()
        touched = sets.join(ids, "id", "left_semi")
    found = touched.select("id", F.explode("h").alias("h"))
    few = full.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    lookup = full.join(samples.withColumn("sampled", F.lit(1)), ["item_id", "h"], "left")
    hits = found.join(F.broadcast(lookup) if few else lookup, "h")
    # several rows of one id add up only over distinct shingles
    per = hits.groupBy("id", "item_id").agg(F.countDistinct("h").alias("found"), F.max("size").alias("size"),
                                            F.max("sampled").alias("sampled"))
    return per.filter(f"sampled = 1 and 100 * found >= {percent} * size").select(
        F.col("id").alias("doc_id"), "item_id", "found", "size", (F.col("found") / F.col("size")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id contains no item."""
    bad = stored(contained(docs, items, k, percent).select(F.col("doc_id").alias("__bad")).distinct(), "decon-bad")
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")
