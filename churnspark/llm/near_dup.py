"""Near duplicates by MinHash bands with odd-sketch verification and exact confirmation.

1. One pass computes per document the shingle set's size and 128-bit key, ``bands`` band hashes over ``bands * rows``
   MinHash samples, and an odd sketch: each sample (its number and value) flips one of 512 bits, so the XOR of two
   sketches has a bit set about where the samples differ and its population count estimates the similarity.
2. Documents with equal sets are one node (their smallest id), so thousands of copies cost one row.
3. Nodes that share a band hash are a bucket. Each node is first compared with one bucket pivot only (the most central
   node of a bucket, of all its buckets the one with the closest sketch); pairs that pass the sketch are confirmed on full
   sets and joined to components.
4. Completion: in buckets whose nodes are still in several components, each node outside the bucket's largest component
   is compared (sketches, inside the join, in the first bucket that a pair shares) with the nodes of other components.
   Nodes already connected are never compared again, so a large group of copies costs a star instead of all its pairs,
   yet no candidate link between different components is left out. Groups of edited copies just below the threshold would
   pass the short sketch by the million, so here the nodes also get a long one, the odd sketch of the whole set (every
   shingle a sample): its XOR count can't exceed the symmetric difference, and is close to it.
5. Final components over all confirmed links.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8; the sketch bound
lies six standard deviations above the expected count at the threshold. Both only ever remove candidates; every link is
confirmed on the full sets with integers (100 * common >= percent * union).

Defined cases: null text counts as empty; an empty set is linked with nothing; rows with a null id get a null component
and are kept; rows with the same id are one document and share its fate; empty table: empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import stored
from churnspark.llm.components import components
from churnspark.llm.shingles import WordHashes, mix, shingle_set

BANDS, ROWS = 32, 4
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
WHOLE_BITS = 4096
_WHOLE = [f"w{i}" for i in range(WHOLE_BITS // 64)]


def sketch_limit(percent: int, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """Largest XOR population count that a pair at the threshold is allowed (six deviations of the samples, three of the bitmap)."""
    t = percent / 100
    differing = 2 * samples * (1 - t) + 12 * math.sqrt(samples * t * (1 - t))
    return math.ceil(bits / 2 * (1 - math.exp(-2 * differing / bits)) + 3 * math.sqrt(bits) / 4)


def whole_limit(percent: int, total: Column, bits: int = WHOLE_BITS) -> Column:
    """Largest XOR count of whole-set sketches at the threshold, for sets of ``total`` shingles together: never below the
    count that the largest symmetric difference allows (a certain bound), or its expectation plus six deviations."""
    most = total * ((100 - percent) / (100 + percent))
    expected = F.lit(bits / 2) * (1 - F.exp(most * (-2 / bits)))
    return F.least(most, expected + 6 * F.least(most * math.sqrt(2 / bits), F.lit(math.sqrt(bits) / 2))) + F.lit(1e-6)


def _multipliers(samples: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20_241).integers(0, 2**64, (2, samples), np.uint64)
    return draws[0] | np.uint64(1), draws[1]


def minhash(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):  # bounds memory for very long texts
        block = items[at:at + 4096, None] * a
        block += b
        np.minimum(out, block.min(0), out=out)
    return out


def _parity(items: np.ndarray, bits: int) -> np.ndarray:
    odd = (np.bincount((mix(items) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def odd_sketch(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of (sample number, value) pairs as signed 64-bit words."""
    return _parity(mins + np.arange(1, len(mins) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), bits)


_SIGNATURE = ("id long, n_shingles long, key_hi long, key_lo long, bands array<long>, "
              + ", ".join(f"{s} long" for s in _SKETCH))


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _multipliers(BANDS * ROWS)
        for batch in batches:
            n_set, keys, bands, sketches = [], [], [], []
            for text in batch.column(1):
                items = shingle_set(text.as_py(), k, hashes)
                n_set.append(len(items))
                digest = xxhash.xxh3_128_digest(items.tobytes())
                keys.append(np.frombuffer(digest, np.int64))
                if not len(items):
                    bands.append(None)
                    sketches.append(np.zeros(SKETCH_WORDS, np.int64))
                    continue
                mins = minhash(items, a, b)
                row = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(ROWS):
                    row = mix(row * np.uint64(0x9E3779B97F4A7C15) + mins[j::ROWS])
                bands.append(row.view(np.int64))
                sketches.append(odd_sketch(mins))
            both, sk = np.array(keys, np.int64).reshape(-1, 2), np.array(sketches, np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_set, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                 pa.array(bands, pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(sk[:, i])) for i in range(SKETCH_WORDS)]],
                names=["id", "n_shingles", "key_hi", "key_lo", "bands", *_SKETCH])
    return run


def _whole_signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if batch.num_rows:
                sk = np.stack([_parity(shingle_set(t.as_py(), k, hashes), WHOLE_BITS) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(np.ascontiguousarray(sk[:, i])) for i in range(sk.shape[1])]], names=["node", *_WHOLE])
    return run


def _confirmer(k: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last = WordHashes(), (None, None)
        for f in frames:
            hit = np.zeros(len(f), bool)
            for i, (ta, tb) in enumerate(zip(f["text_a"], f["text_b"])):
                if last[0] != ta:
                    last = (ta, shingle_set(ta, k, hashes))
                x, y = last[1], shingle_set(tb, k, hashes)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hit[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield f.loc[hit, ["a", "b"]]
    return run


def _apart(x: str, y: str, sketch: list[str] = _SKETCH) -> Column:
    """Population count of the XOR of two sketches."""
    counts = [F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sketch]
    while len(counts) > 1:  # a balanced sum keeps the expression tree shallow
        counts = [sum(counts[i + 1:i + 2], counts[i]) for i in range(0, len(counts), 2)]
    return counts[0]


def _close(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches allow the similarity."""
    small, large = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return (small * 100 >= large * percent) & (_apart(x, y) <= sketch_limit(percent))


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(
        _confirmer(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = stored(source.mapInArrow(_signer(k), _SIGNATURE), "dup-sign")
    known = signed.filter("id is not null and n_shingles > 0")

    # nodes: one per distinct set
    classes = known.groupBy("key_hi", "key_lo").agg(F.min("id").alias("node"))
    member = stored(known.select("id", "key_hi", "key_lo").distinct().join(classes, ["key_hi", "key_lo"]).select("id", "node"),
                    "dup-member")
    nodes = stored(known.join(member.filter("id = node").select("id"), "id").dropDuplicates(["id", "key_hi", "key_lo"])
                   .withColumnRenamed("id", "node").drop("key_hi", "key_lo"), "dup-nodes")
    # several different sets under one id make that id the node of all of them
    same_id = member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("a", "b")

    # buckets with two nodes or more, stored with their members
    spread = nodes.select(F.explode("bands").alias("bucket"), "node")
    pairs = spread.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.count(F.lit(1)).alias("n"))
    shared = stored(spread.join(pairs.filter("low <> top").select("bucket", "n"), "bucket"), "dup-buckets")

    # the pivot of a bucket is its most central node, the one whose buckets are fullest: of a group of edited copies
    # that is the text they were edited from, or one close to it
    central = shared.groupBy("node").agg(F.sum("n").alias("central"))
    ranked = shared.join(central, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("node")).alias("m"))).alias("p"))
    pivots = pivots.select("bucket", (-F.col("p.m")).alias("pivot"))

    # one pivot per node: the closest by sketch
    light = nodes.drop("bands")
    stars = shared.join(pivots, "bucket").filter("node <> pivot").select("pivot", "node").distinct()
    first = (stars.join(light.alias("x").withColumnRenamed("node", "pivot"), "pivot")
             .join(light.alias("y"), "node")
             .filter(_close("x", "y", percent))
             .select("node", "pivot", _apart("x", "y").alias("apart"))
             .groupBy("node").agg(F.min(F.struct("apart", "pivot")).alias("best"))
             .select(F.col("best.pivot").alias("a"), F.col("node").alias("b")))
    first = stored(first, "dup-first")

    # texts of bucket members, once, for both rounds of confirmation
    in_bucket = shared.select(F.col("node").alias("id")).distinct()
    texts = stored(source.join(in_bucket, "id", "left_semi"), "dup-texts")
    links = stored(_confirm(first, texts, k, percent).unionByName(same_id), "dup-links")
    joined = stored(components(links), "dup-cc")

    # completion inside buckets that still span several components
    placed = (shared.drop("n").join(joined.withColumnRenamed("id", "node"), "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    largest = largest.filter("parts > 1").select("bucket", F.col("top.component").alias("main"))
    loose = stored(placed.join(largest, "bucket"), "dup-open")
    mine = loose.groupBy("node").agg(F.collect_list("bucket").alias("mine"))  # at most one bucket per band
    whole = (texts.join(mine.select(F.col("node").alias("id")), "id").select("id", "text")
             .mapInArrow(_whole_signer(k), "node long, " + ", ".join(f"{w} long" for w in _WHOLE)))
    known_open = stored(light.join(mine, "node").join(whole, "node"), "dup-whole")
    open_rows = loose.join(known_open, "node")
    rest = (open_rows.filter("component <> main").alias("x")
            .join(open_rows.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
                  & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
                  & _close("x", "y", percent)
                  & (_apart("x", "y", _WHOLE) <= whole_limit(percent, F.col("x.n_shingles") + F.col("y.n_shingles")))
                  & (F.array_min(F.array_intersect("x.mine", "y.mine")) == F.col("x.bucket")))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
            .join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = _confirm(rest, texts, k, percent)
    final = stored(components(links.unionByName(more)), "dup-components")

    out = (signed.select("id", "n_shingles")
           .join(member.groupBy("id").agg(F.min("node").alias("node")), "id", "left")
           .join(final.select(F.col("id").alias("node"), "component"), "node", "left"))
    component = F.coalesce("component", "node", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: of each component the document with the smallest id."""
    gone = near_duplicates(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
