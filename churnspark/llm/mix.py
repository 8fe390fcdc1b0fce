"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. A source's target is its weighted share of ``share`` times all words, at most ``repeat`` times its size;
the excess is shared again by weight among the others (water filling). Documents are cut into blocks of ``BLOCK`` words
(the last one is shorter), the unit that is drawn:

* whole passes: a target of at least the source's size takes every block floor(target / size) times;
* the rest: blocks in the order of md5(doc_id, block) until the running words come nearest to the remaining target. The
  running sum uses a histogram of 65,536 md5 prefixes per source, and only the boundary prefix is ranked, so a source
  with a third of all rows is no hot group.

That gives each source an exact quota of draws. The quotas of all sources are split among the output shards by a binary
tree: at every node the left half of the shards receives a multivariate-hypergeometric draw from the node's quotas (source
after source, each the inverse of a hypergeometric distribution at a number that md5 fixes), the right half the rest.
Each source's draws, in a second md5 order, fill its shard quotas one after the other, so shards hold disjoint blocks;
inside its shard each draw gets a local position from a third order. Everything is SQL on counts and hashes, and reruns agree.

Defined cases: null text has size 0 and is taken 0 times; sources sort by code point, null last; a source without words
has target 0; rows repeated with the same id and text are drawn together; empty table: empty result; extra columns are
ignored by the draws and kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import SPACE, small, stored, words

WEIGHTS = (3, 1, 2)
SHARE, REPEAT = 1.5, 2
BLOCK = 128
#: Blocks that a shard of the mixture holds on average.
SHARD_BLOCKS = 8192
SEED = "mix-1"


def _order(tag: str, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(f"{SEED}-{tag}"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), narrow, stored."""
    return stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """One row per source: source_size, target, passes (whole ones) and rest (words still to draw).

    Water filling: with sources ordered by cap / weight, the capped ones come first; a source is capped if the level
    that the words and weights from it onwards allow lies above its own ratio. Windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                (F.col("rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
                         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
    capped = F.col("level") * F.col("weight") >= F.col("cap")
    # the level of the first source that is not capped holds for all the rest
    per = per.withColumn("free", F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything))
    target = F.when(capped, F.col("cap")).otherwise(F.col("free.level") * F.col("weight"))
    per = per.withColumn("target", target)
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
    per = per.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    return per.select("source", "source_size", "target", F.col("passes").cast("int").alias("passes"), "rest")


def blocks(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, block, words, key): the blocks of every document with their md5 order."""
    b = sized.filter("size > 0").select("doc_id", "source", "size", F.explode(F.sequence(
        F.lit(0), (F.ceil(F.col("size") / BLOCK) - 1).cast("int"))).alias("block"))
    b = b.withColumn("words", F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK))
    return b.withColumn("key", _order("draw", "doc_id", "block"))


def cuts(cut_blocks: DataFrame, per: DataFrame) -> DataFrame:
    """(source, cut): the last md5 key that the partial pass of a source takes (no row: none)."""
    prefix = F.substring("key", 1, 4)
    hist = cut_blocks.groupBy("source", prefix.alias("prefix")).agg(F.sum("words").alias("w"))
    run = Window.partitionBy("source").orderBy("prefix")
    hist = hist.withColumn("upto", F.sum("w").over(run))
    hist = hist.withColumnRenamed("source", "s").join(per.select("source", "rest"), F.col("s").eqNullSafe(F.col("source")))
    # the first prefix that reaches the rest; its keys are ranked one by one
    edge = (hist.filter("upto >= rest and rest > 0").groupBy("source").agg(
        F.min(F.struct("prefix", (F.col("upto") - F.col("w")).alias("before"), "rest")).alias("e"))
        .select(F.col("source").alias("es"), "e.prefix", "e.before", "e.rest"))
    edge = stored(edge, "mix-edge")
    inside = (cut_blocks.withColumn("p", prefix).join(small(edge), F.col("source").eqNullSafe(F.col("es")) & (F.col("p") == F.col("prefix")))
              .groupBy("source", "key", "before", "rest").agg(F.sum("words").alias("w")))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("source").orderBy("key"))
    inside = inside.withColumn("upto", upto)
    # nearest: a key belongs to the draw if at least half of it fits
    taken = inside.filter(F.col("upto") - F.col("w") / 2 <= F.col("rest")).groupBy("source").agg(F.max("key").alias("cut"))
    return edge.select("es", "prefix").join(taken, F.col("es").eqNullSafe(F.col("source")), "left").select(
        F.col("es").alias("cut_source"), F.coalesce("cut", "prefix").alias("cut"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """One stored row per source: targets, passes and cut key."""
    per = stored(targets(sized, weights, share, repeat), "mix-targets")
    cut = cuts(blocks(sized), per)
    return stored(per.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
                  .withColumnRenamed("source", "plan_source"), "mix-plan")


def draws(sized: DataFrame, per: DataFrame) -> DataFrame:
    """(doc_id, source, block, words, copy): every draw, stored. ``copy`` numbers the repeats of a block from 0."""
    b = blocks(sized).join(small(per), F.col("source").eqNullSafe(F.col("plan_source")))
    copies = F.col("passes") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    b = b.withColumn("copies", copies).filter("copies > 0")
    return stored(b.select("doc_id", "source", "size", "block", "words", "source_size", "target",
                           F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")), "mix-draws")


def _let(name: str, values: dict[str, str], body: str) -> str:
    """SQL ``body`` with ``name`` bound to a struct of ``values``, each computed once."""
    return f"element_at(transform(array(named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())})), {name} -> {body}), 1)"


#: Deviation up to which a draw walks from the mode; a wider one takes the first accepted of ``PROPOSALS`` proposals (each is accepted more
#: often than not).
WALK, PROPOSALS = 50, 100


def _walk(e: str, steps: str, goal: str, up: bool) -> str:
    """Weights relative to the mode's, step by step away from it: their sum, and the first value at which the sum passes ``goal``."""
    k = f"({e}.mode {'+' if up else '-'} i)"
    ratio = (f"if({k} > {e}.high, 0D, h.w * ({e}.q - {k} + 1D) * ({e}.m - {k} + 1D) / ({k} * ({e}.n - {e}.q - {e}.m + {k} + 0D)))" if up else
             f"if({k} < {e}.low, 0D, h.w * (({k} + 1D) * ({e}.n - {e}.q - {e}.m + {k} + 1D)) / (({e}.q - {k}) * ({e}.m - {k} + 0D)))")
    return (f"aggregate(sequence(1L, {steps}), named_struct('w', 1D, 's', 0D, 'k', cast(null as bigint)), (h, i) -> named_struct("
            f"'w', {ratio}, 's', h.s + {ratio}, 'k', if(h.k is null and h.s + {ratio} >= {goal}, {k}, h.k)))")


def _log_weight(e: str, z: str) -> str:
    """Log probability of ``z`` up to a constant, for cells of at least one: two binomial terms in the deviance form, exact at any pool size."""
    def deviance(x: str, mean: str) -> str:
        return f"({x} * log1p(({x} - {mean}) / {mean}) - ({x} - {mean}))"

    def stirling(x: str) -> str:
        return f"(1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}))"

    cells = {"a": z, "b": f"({e}.g - {z})", "c": f"({e}.s - {z})", "d": f"({e}.n - {e}.g - {e}.s + {z})"}
    means = {"a": f"{e}.g * ({e}.s / {e}.n)", "b": f"{e}.g * (1D - {e}.s / {e}.n)", "c": f"({e}.n - {e}.g) * ({e}.s / {e}.n)",
             "d": f"({e}.n - {e}.g) * (1D - {e}.s / {e}.n)"}
    terms = " - ".join(f"{deviance(f'v.{c}', f'({means[c]})')} - {stirling(f'v.{c}')} - 0.5D * ln(v.{c})" for c in cells)
    return _let("v", {c: f"({x} + 0D)" for c, x in cells.items()}, f"(0D - {terms})")


def _hypergeometric(n: str, q: str, m: str, u: str) -> str:
    """A hypergeometric draw as SQL: pool ``n``, of which ``q`` are marked, ``m`` drawn; ``u`` in (0, 1) fixes the draw.

    Narrow distributions are inverted: values in the order mode, upwards, downwards, until their weights pass u times the sum. Wide ones take
    the first accepted proposal of the ratio of uniforms (Stadlober, 1990), the uniforms hashed from ``u``. Neither keeps a curve, and the
    work is bounded whatever the pool.
    """
    steps = "(20L + cast(ceil(12 * e.sd) as bigint))"
    small = _let("t", {"up": _walk("e", steps, "1e300D", True) + ".s", "down": _walk("e", steps, "1e300D", False) + ".s"},
                 f"if(e.u * (1D + t.up + t.down) <= 1D, e.mode, coalesce({_walk('e', steps, '(e.u * (1D + t.up + t.down) - 1D)', True)}.k, "
                 f"{_walk('e', steps, '(e.u * (1D + t.up + t.down) - 1D - t.up)', False)}.k, e.mode))")
    random = "((shiftrightunsigned(xxhash64(e.u, i, {}), 11) + 0.5D) / 9007199254740992D)"
    spread, shift = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
    inside = "o.z >= 1 and o.z < f.g and o.z < f.s and f.n - f.g - f.s + o.z >= 1"
    one = _let("p", {"x": random.format(1), "y": random.format(2)}, _let(
        "o", {"z": "floor(f.center + f.width * (p.y - 0.5D) / p.x)", "x": "p.x"},
        f"if({inside} and 2D * ln(o.x) <= {_log_weight('f', 'o.z')} - f.top, o.z, cast(null as bigint))"))
    # by symmetry the rarer mark and the smaller sample
    wide = _let("g", {"n": "e.n", "g": "least(e.q, e.n - e.q)", "s": "least(e.m, e.n - e.m)", "sd": "e.sd"}, _let(
        "f", {"n": "g.n", "g": "g.g", "s": "g.s", "center": "g.s * (g.g / g.n) + 0.5D", "width": f"{spread!r}D * sqrt(g.sd * g.sd + 0.5D) + {shift!r}D",
              "mode": "cast(floor((g.s + 1D) * (g.g + 1D) / (g.n + 2D)) as bigint)",
              "top": _log_weight("g", "cast(floor((g.s + 1D) * (g.g + 1D) / (g.n + 2D)) as bigint)")},
        f"aggregate(sequence(1, {PROPOSALS}), cast(null as bigint), (k, i) -> if(k is not null, k, {one}), k -> coalesce(k, f.mode))"))
    back = _let("w", {"z": wide, "s": "least(e.m, e.n - e.m)"}, _let(
        "r", {"z": "if(e.q > e.n - e.q, w.s - w.z, w.z)"}, "if(e.m > e.n - e.m, e.q - r.z, r.z)"))
    low, high = "greatest(0L, d.m - (d.n - d.q))", "least(d.q, d.m)"
    ends = {"n": "d.n", "q": "d.q", "m": "d.m", "u": "d.u", "low": low, "high": high,
            "mode": f"least({high}, greatest({low}, cast(floor((d.m + 1D) * (d.q + 1D) / (d.n + 2D)) as bigint)))",
            "sd": "sqrt(greatest(0D, d.m * (d.q / greatest(1L, d.n)) * (1 - d.q / greatest(1L, d.n)) * ((d.n - d.m) / greatest(1L, d.n - 1))))"}
    values = {"n": f"cast({n} as bigint)", "q": f"cast({q} as bigint)", "m": f"cast({m} as bigint)", "u": f"cast({u} as double)"}
    return _let("d", values, _let("e", ends, f"if(e.sd > {WALK}, {back}, {small})"))


def shard_quotas(drawn: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source, shard, quota, before): draws of each source per shard, and of the shards before it.

    A node is a range of shards with the quota of every source in it. Splitting a node goes through its sources in
    order; each takes a hypergeometric share of what the left half still needs from the sources not seen yet.
    """
    quota = stored(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), "mix-quota")
    total = quota.agg(F.sum("quota")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / shard_blocks))))
    nodes = quota.select("source", F.lit(0).alias("node"), F.col("quota"))
    for level in range(depth):
        w = Window.partitionBy("node").orderBy(F.col("source").asc_nulls_last())
        # the sources of a node in one array: as many as the mixture has, whatever the number of documents
        packed = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(
            F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("name"), "quota",
            ((F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{SEED}-tree"), F.lit(level), "node",
                                                   F.coalesce("source", F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5)
             / F.lit(float(1 << 48))).alias("u")))).alias("sources"), F.sum("quota").alias("pool"))
        take = _hypergeometric("a.pool", "x.quota", "a.need", "x.u")
        split = packed.select("node", F.expr(f"""aggregate(sources, named_struct('pool', pool, 'need', shiftright(pool + 1, 1),
            'out', cast(array() as array<struct<z:boolean,name:string,quota:bigint,left:bigint>>)), (a, x) -> aggregate(
            array({take}), a, (b, l) -> named_struct('pool', b.pool - x.quota, 'need', b.need - l, 'out', concat(b.out,
            array(named_struct('z', x.z, 'name', x.name, 'quota', x.quota, 'left', l))))), a -> a.out)""").alias("out"))
        rows = split.select("node", F.inline("out")).withColumn("source", F.expr("if(z, null, name)"))
        nodes = stored(rows.select("source", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("quota") - F.col("left")).alias("quota")))).alias("h"))
            .select("source", "h.node", "h.quota"), "mix-tree")
    before = F.sum("quota").over(Window.partitionBy("source").orderBy("node")) - F.col("quota")
    return nodes.select("source", F.col("node").alias("shard"), "quota", before.alias("before"))


def shard_ranges(quotas: DataFrame) -> DataFrame:
    """(qs, qc, width, shard, begin, end): the rank range of every source and shard, once per cell of ranks that it meets.

    A cell of a source holds ``width`` ranks, the source's mean quota, so there are about two rows per source and shard
    and a draw finds its shard by an equal join on the cell, whatever the number of shards.
    """
    q = quotas.filter("quota > 0").select(F.col("source").alias("qs"), "shard", F.col("before").alias("begin"),
                                          (F.col("before") + F.col("quota")).alias("end"))
    width = q.groupBy(F.col("qs").alias("wq")).agg(F.ceil(F.max("end") / F.count(F.lit(1))).cast("long").alias("width"))
    q = q.join(width, F.col("qs").eqNullSafe(F.col("wq"))).drop("wq")
    return q.select("*", F.explode(F.sequence(F.floor(F.col("begin") / F.col("width")),
                                              F.floor((F.col("end") - 1) / F.col("width")))).alias("qc"))


def mixture(drawn: DataFrame, quotas: DataFrame) -> DataFrame:
    """(shard, place, doc_id, source, block, copy, words): every draw with its shard and its place in the shard's local shuffle.

    A draw's rank within its source is its rank within an md5 prefix plus the draws of the prefixes before, so no source
    is ranked in one task; the rank falls into exactly one of the source's shard ranges.
    """
    d = drawn.withColumn("key", _order("shard", "doc_id", "block", "copy")).withColumn("prefix", F.substring("key", 1, 4))
    hist = d.groupBy("source", "prefix").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.withColumn("skip", F.sum("n").over(Window.partitionBy("source").orderBy("prefix")) - F.col("n"))
    hist = hist.select(F.col("source").alias("hs"), F.col("prefix").alias("hp"), "skip")
    ranked = d.join(hist, F.col("source").eqNullSafe(F.col("hs")) & (F.col("prefix") == F.col("hp")))
    rank = F.col("skip") + F.row_number().over(Window.partitionBy("source", "prefix").orderBy("key", "doc_id")) - 1
    ranked = ranked.withColumn("rank", rank)
    ranges = stored(shard_ranges(quotas), "mix-ranges")
    width = F.col("width")
    widths = stored(ranges.select(F.col("qs").alias("ws"), "width").distinct(), "mix-widths")
    ranked = ranked.join(small(widths), F.col("source").eqNullSafe(F.col("ws")))
    placed = ranked.withColumn("cell", F.floor(F.col("rank") / width)).drop("width").join(
        small(ranges.drop("width")), F.col("source").eqNullSafe(F.col("qs")) & (F.col("cell") == F.col("qc"))
        & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("end")))
    placed = placed.withColumn("local", _order("local", "doc_id", "block", "copy"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("local", "doc_id", "block", "copy")) - 1
    return placed.select("shard", place.alias("place"), "local", "doc_id", "source", "size", "source_size", "target", "block", "copy", "words")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
        shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, the plan per source and the mixture (all draws with shard and place) of ``docs``."""
    sized = sizes(docs)
    per = plan(sized, weights, share, repeat)
    drawn = draws(sized, per)
    return sized, per, mixture(drawn, shard_quotas(drawn, shard_blocks))


def taken(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target of its source and the words that the mixture takes of it."""
    sized, per, mixed_rows = mix(docs)
    rows = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    got = mixed_rows.groupBy("doc_id", "source", "size").agg(F.sum("words").alias("got"))
    got = got.select(F.col("doc_id").alias("gd"), F.col("source").alias("gs"), F.col("size").alias("gz"), "got")
    rows = rows.join(got, F.col("doc_id").eqNullSafe(F.col("gd")) & F.col("source").eqNullSafe(F.col("gs")) & (F.col("size") == F.col("gz")), "left")
    rows = rows.join(small(per), F.col("source").eqNullSafe(F.col("plan_source")))
    share = F.coalesce(F.col("got") / F.col("rows"), F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", share.alias("taken"), F.explode(
        F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("one")).drop("one")


_PIECES = r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,%d}" % BLOCK


def shards(docs: DataFrame) -> DataFrame:
    """(shard, place, doc_id, block, copy, words): every draw of the mixture of ``docs`` at its place in its shard."""
    return mix(docs)[2].select("shard", "place", "doc_id", "block", "copy", "words")


def mixed(docs: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mixture as rows of ``docs``: one row per document and copy, holding the text of the blocks taken (all: the whole text).

    A row stands where one of its draws does, the first by their local order (a hash), so a shard gets its share of the words and no shard
    comes before another; every shard's rows are in one partition, in place order. ``n_chars``, if there is one, follows the text. Text crosses two shuffles: the document's key, the shard.
    """
    _, _, rows = mix(docs, shard_blocks=shard_blocks)
    got = rows.groupBy("doc_id", "source", "size", "copy").agg(F.sort_array(F.collect_set("block")).alias("__blocks"),
                                                               F.min(F.struct("local", "shard", "place")).alias("__at"))
    got = got.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), "__blocks", "__at.shard", "__at.place")
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                        F.size(words(F.col("text"))).cast("long").alias("__size"))
    joined = keyed.join(got, F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s"))
                        & (F.col("__size") == F.col("__z")))
    # a text is cut once, behind a Generate (else the cut would be evaluated for every block)
    whole = F.size("__blocks") * BLOCK >= F.col("__size")
    cut = F.when(~whole, F.regexp_extract_all("__row.text", F.lit(_PIECES), F.lit(0)))
    joined = joined.select("__row", "__blocks", "shard", "place", F.inline(F.array(F.struct(whole.alias("__whole"), cut.alias("__pieces")))))
    part = F.array_join(F.transform("__blocks", lambda b: F.get("__pieces", b)), "")
    text = F.when(F.col("__whole"), F.col("__row.text")).otherwise(part)
    out = joined.select("__row", text.alias("__text"), F.col("shard").alias("__shard"), F.col("place").alias("__place"))
    out = out.select(*[F.col("__text").alias("text") if c == "text" else
                       F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                       F.col("__row").getField(c).alias(c) for c in docs.columns], "__shard", "__place")
    return out.repartition("__shard").sortWithinPartitions("__shard", "__place").drop("__shard", "__place")
