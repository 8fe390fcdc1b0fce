"""Quality rules by host: rule failures per source, shrunk with an empirical beta prior, decide over the host's documents.

Every document gets text statistics (array functions inside one scan, no shuffle of text). Each rule's failures are
counted per source (partial aggregation, one row per source and split crosses the shuffle). A rule's failure rate at a
source is shrunk towards the mean over the other sources with a beta prior fitted to them by moments, so a source with few documents
is not judged by them alone. A source loses all its documents if for any rule its shrunk rate lies more than ``DEVIATIONS`` deviations of
that prior above its mean and is at least ``LEAST_RATE``; a document that fails a base rule is dropped whatever its source.

Defined cases: null text counts as empty (0 words, fails the word rule); null source is a source of its own; repeated
rows count as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import small, stored, words

#: Rules: a document fails where the SQL condition holds.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
BASE_RULES = ("few_words", "repeats")
#: A source is rejected if a shrunk rate lies this many deviations of the other sources' prior above its mean, from LEAST_RATE on.
DEVIATIONS, LEAST_RATE = 3.0, 0.2
#: Prior strength (pseudo documents) where the rates of the sources do not vary (variance up to FLAT).
FLAT_STRENGTH, FLAT = 1000.0, 1e-12

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Words in repeated 3-word windows. Each window hash is shifted left and its position put in the low bits, so one
# primitive sort brings equal windows together; the positions that have an equal neighbour are sorted again and each
# adds min(3, gap to the next) words.
_GRAMS = """if(size(__w) < 3, cast(array() as array<bigint>),
    transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))"""
_PACKED = "sort_array(transform(__g, (x, i) -> shiftleft(x, __bits) | cast(i as bigint)))"
_REPEATED = """sort_array(transform(filter(__s, (x, i) ->
    coalesce(shiftright(x, __bits) = shiftright(get(__s, i - 1), __bits), false)
    or coalesce(shiftright(x, __bits) = shiftright(get(__s, i + 1), __bits), false)),
    x -> x & (shiftleft(1L, __bits) - 1)))"""
_COVERED = "aggregate(transform(__p, (x, i) -> least(3L, coalesce(get(__p, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` plus the STATS columns and ``base_failed`` for every row; narrow, in one scan."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], t.alias("__t"), words(t).alias("__w"),
                     lines.alias("__l"))
    df = df.select("*", F.expr(_GRAMS).alias("__g"),
                   F.expr("cast(ceil(log2(size(__w) + 2)) as int)").alias("__bits"))
    df = df.select("*", F.expr(_PACKED).alias("__s"))
    df = df.select("*", F.expr(_REPEATED).alias("__p"))
    stats = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        _without(F.col("__t"), " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("__t") - _without(F.col("__t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    # Generate is a barrier: a later filter on the statistics would else be pushed into the array expressions and
    # evaluate them again for every element
    df = df.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.inline(F.array(stats)))
    return df.withColumn("base_failed", F.expr(" or ".join(f"({RULES[r]})" for r in BASE_RULES)))


def host_verdicts(stats: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, worst shrunk failure rate of a rule and ``host_ok``. A lone host is its own prior."""
    counts = stats.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.expr(f"if({sql}, 1L, 0L)")).alias(f"k_{r}") for r, sql in RULES.items()])
    counts = stored(counts, "quality-hosts")
    # one row: number of hosts, sum and sum of squares of their rates
    x = {r: F.col(f"k_{r}") / F.col("host_docs") for r in RULES}
    total = counts.agg(F.count(F.lit(1)).alias("hosts"), *[F.sum(x[r]).alias(f"s_{r}") for r in RULES], *[F.sum(x[r] * x[r]).alias(f"q_{r}") for r in RULES]).first()
    others = float((total["hosts"] or 1) - 1)
    rates, bad = [], F.lit(False)
    for r in RULES:
        s, q = float(total[f"s_{r}"] or 0), float(total[f"q_{r}"] or 0)
        mean = (F.lit(s) - x[r]) / others if others else x[r]
        var = (F.lit(q) - x[r] * x[r] - F.lit(others) * mean * mean) / (others - 1) if others > 1 else F.lit(0.0)
        strength = F.when(var > FLAT, F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0))).otherwise(F.lit(FLAT_STRENGTH))
        rate = (F.col(f"k_{r}") + mean * strength) / (F.col("host_docs") + strength)
        limit = F.greatest(F.lit(LEAST_RATE), mean + F.lit(DEVIATIONS) * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - mean)) / (strength + 1)))
        rates.append(rate)
        bad = bad | (rate > limit)
    return counts.select("host", "host_docs", F.greatest(*rates).alias("worst_rate"), (~bad).alias("host_ok"))


def judge(stats: DataFrame, host: str = "source") -> DataFrame:
    """``stats`` (from text_stats, with ``host``) plus host_docs, worst_rate and ``kept``."""
    verdicts = stored(host_verdicts(stats, host).select(F.col("host").alias("__host"), "host_docs", "worst_rate", "host_ok"),
                      "quality-verdicts")
    joined = stats.join(small(verdicts), F.col(host).eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("__host", "host_ok")


def quality(docs: DataFrame) -> DataFrame:
    """Full report: statistics and verdict of every document."""
    return judge(stored(text_stats(docs), "quality-stats"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. The statistics are computed twice (for the hosts and for the rows): writing the
    rows with them would take the input's size of disk. Text crosses a shuffle only where the hosts are too many to broadcast."""
    cols = docs.columns
    packed = docs.select(F.struct(*cols).alias("__row"), F.col("text").alias("__text"), F.col("source").alias("__source"))
    stats = text_stats(packed, "__text", ("__row", "__source"))
    return judge(stats, "__source").filter("kept").select("__row.*")
