"""Merkle manifest of a dataset: a persistent tree whose versions copy paths and share everything else.

A row's leaf is the SHA-256 of its fields. Per language the leaves ascend by id and consecutive pairs are hashed level by
level to a subroot; the subroots, in the order of the languages, are hashed likewise to the root. ``manifest`` gives every row's
leaf, proof and the root that folding a tampered row's version gives.

The tree is cut into aligned blocks of ``2 ** BLOCK_BITS`` nodes. Going up, one task hashes one block to its root, and the roots are
the nodes of the next stage until every tree is one node. Going down, a block meets the path from its root to the top and hands each of its
nodes the longer path; at the lowest stage every tampered leaf makes a version of its block: only the leaf's ancestors in the block are
copied, all other nodes are the base's, and the version goes on along the block's path above, again copying one node a level.

Plan: texts leave the scan as hashes only. Ranks come from a range sort and the partitions' counts (a language with a third of all rows
is spread over its ranges); no group holds more than a block, no join key of rows more than a range. Stages are written tables.

Defined cases: null fields hash as ``-``; rows with a null id come first and are never tampered; rows with the same id are ordered by
leaf; a null language is a tree of its own, the first; a row whose n_chars is null is the same after tampering; empty table: empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import stored

BLOCK_BITS = 12
#: Rows of one range of the sort.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class BlockTree:
    """The base version of one block: ``levels[0]`` are its nodes, the last level is its root."""

    def __init__(self, nodes: list[str], height: int | None):
        """``height``: levels to climb (a block of a larger tree); None: until one node remains."""
        self.levels = [nodes]
        while (len(self.levels) <= height) if height is not None else (len(self.levels[-1]) > 1):
            low = self.levels[-1]
            self.levels.append([digest("".join(low[i:i + 2])) for i in range(0, len(low), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[str]:
        """The sibling at each level below the root: ``<`` and its hash (on the left), ``>`` and its hash, or empty (none)."""
        out = []
        for low in self.levels[:-1]:
            j = i ^ 1
            out.append(("<" if j < i else ">") + low[j] if j < len(low) else "")
            i >>= 1
        return out

    def version(self, i: int, node: str) -> dict[tuple[int, int], str]:
        """A version with node ``i`` replaced: the copied nodes by (level, place); all others are shared with the base."""
        copied = {(0, i): node}
        for level, low in enumerate(self.levels[:-1]):
            pair = [copied.get((level, j), low[j]) for j in range(i & ~1, min((i | 1) + 1, len(low)))]
            i >>= 1
            copied[level + 1, i] = digest("".join(pair))
        return copied


def climb(node: str, path: list[str]) -> str:
    """The top node of a version that continues from ``node`` along ``path``, one copied node a level."""
    for side in path:
        node = digest(side[1:] + node if side[:1] == "<" else node + side[1:])
    return node


def _height(size: int, bits: int) -> int | None:
    return bits if size > 1 << bits else None


def leaf_of(columns: dict[str, Column]) -> Column:
    """Hash of a row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[field(columns[f]) for f in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): hash of every row as it is and, where it is tampered with, as it then is."""
    columns = {f: F.col(f) for f in FIELDS}
    changed = {**columns, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("1"), "lang"))   # non-null, in the languages' order
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"),
                       F.when(tampered, leaf_of(changed)).alias("tampered"))


def ranked(rows: DataFrame, group: str, order: list[str], tag: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (stored) with ``pos``, the place in its ``group`` by ``order``, and ``size``, the group's rows.

    Range partitions are sorted and counted; no window runs over rows, only over the partitions' counts."""
    ranges = -(-rows.count() // range_rows) or 1
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    spread = rows.withColumn("__at", F.monotonically_increasing_id())   # equal rows spread over ranges
    placed = spread.repartitionByRange(ranges, *keys, "__at").sortWithinPartitions(*keys, "__at").drop("__at")
    placed = stored(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), tag)
    counts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy("part")
    counts = counts.select(group, "part", (F.sum("n").over(w) - F.col("n") - F.col("first")).alias("shift"),
                           F.sum("n").over(Window.partitionBy(group)).alias("size"))
    return (placed.join(counts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"))


def _up(bits: int):
    def block_root(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        tree = BlockTree(g["node"].tolist(), _height(int(g["size"].iloc[0]), bits))
        size = -(-int(g["size"].iloc[0]) >> bits)
        return pd.DataFrame({"tree": g["tree"].iloc[:1], "pos": g["pos"].iloc[:1] // (1 << bits), "node": tree.root, "size": size})
    return block_root


NODES = "tree string, pos long, node string, size long"


def stages(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Node tables from the given one up to that where every tree is one node, its root."""
    found = [nodes]
    while (found[-1].agg(F.max("size")).first()[0] or 1) > 1:
        up = found[-1].select("tree", "pos", "node", "size")
        groups = up.groupBy("tree", F.shiftright("pos", bits).alias("block"))
        found.append(stored(groups.applyInPandas(_up(bits), NODES), "manifest-stage"))
    return found


def _down(bits: int):
    def longer(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        tree = BlockTree(nodes["node"].tolist(), _height(int(nodes["size"].iloc[0]), bits))
        path = list(above["path"].iloc[0])
        return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0],
                             "path": [tree.path(i) + path for i in range(len(nodes))]})
    return longer


PATHS = "tree string, pos long, subroot string, root string, path array<string>"


def paths(levels: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """Paths of the lowest table in ``levels`` given those of the trees' roots (``top``: tree, pos 0, subroot, root, path)."""
    for nodes in reversed(levels):
        blocks = nodes.groupBy("tree", F.shiftright("pos", bits).alias("block"))
        top = stored(blocks.cogroup(top.groupBy("tree", "pos")).applyInPandas(_down(bits), PATHS), "manifest-paths")
    return top


def _rows(bits: int):
    def proved(rows: pd.DataFrame, above: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values("pos")
        tree = BlockTree(rows["leaf"].tolist(), _height(int(rows["size"].iloc[0]), bits))
        path, subroot, root = list(above["path"].iloc[0]), above["subroot"].iloc[0], above["root"].iloc[0]
        upper = "".join(s[1:] for s in path)
        base = climb(tree.root, path)   # untampered rows share every node, so one fold is theirs
        top = (len(tree.levels) - 1, 0)
        folded = [base if t is None or t == leaf else climb(tree.version(i, t)[top], path)
                  for i, (leaf, t) in enumerate(zip(rows["leaf"], rows["tampered"].astype(object).where(rows["tampered"].notna(), None)))]
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": subroot, "root": root,
            "proof_sha256": [digest("".join(s[1:] for s in tree.path(i)) + upper) for i in range(len(rows))],
            "folded_root": folded, "verified": [f == root for f in folded]})
    return proved


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, bits: int = BLOCK_BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    rows = ranked(stored(leaves(docs), "manifest-leaves"), "tree", ["doc_id", "leaf"], "manifest-sorted", range_rows)
    rows = stored(rows, "manifest-ranked")
    nodes = rows.select("tree", "pos", F.col("leaf").alias("node"), "size")
    levels = stages(nodes, bits)
    subroots = levels[-1].select("tree", F.col("node").alias("subroot"))
    # the tree of the languages, its leaves the subroots
    langs = ranked(stored(subroots.withColumn("all", F.lit("")), "manifest-langs"), "all", ["tree"], "manifest-langs-sorted", range_rows)
    langs = stored(langs, "manifest-langs-ranked")
    lang_levels = stages(langs.select(F.col("all").alias("tree"), "pos", F.col("subroot").alias("node"), "size"), bits)
    top = lang_levels[-1].select("tree", "pos", F.lit("").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
    lang_paths = paths(lang_levels[:-1], top, bits)
    top = langs.join(lang_paths.select("pos", "root", "path"), "pos").select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "root", "path")
    above = paths(levels[1:-1], top, bits) if len(levels) > 1 else top
    blocks = rows.groupBy("tree", F.shiftright("pos", bits).alias("block"))
    return blocks.cogroup(above.groupBy("tree", "pos")).applyInPandas(_rows(bits), RESULT)
