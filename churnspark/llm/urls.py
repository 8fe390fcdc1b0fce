"""URL filter: rules by host and path, else the host's reputation from labelled pages by empirical Bayes.

Labelled outcomes (bad or not) are counted per host, summed to registered domains and suffixes. Each level's rate is
shrunk towards the level above with a beta prior: suffixes towards the overall rate, domains towards their suffix, hosts
towards their domain, each without the host's own pages, which come in once at the end; a level's prior strength comes from the variance of its raw rates beyond the binomial part. A
host is blocked if the lower quartile of its beta posterior (``Z`` deviations below its mean) lies above the overall rate: the odds are three
to one that it is worse than the average. Hosts without labels have their domain's prior.

Plan: only page id and url are read; counts are partially aggregated; the verdicts (one row per host) are joined back to
the narrow page rows, by broadcast only if counted small. Rules are a fixed list inside the expression.

Defined cases: null url or none with "://" has empty host and path, is a host of its own, and no rule fits; a null
outcome (or label without id) counts nowhere; several labels of a page each count; repeated pages are each judged;
empty tables: no labels means every host is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.llm.common import ascii_lower, small, stored

#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Suffixes of two labels under which names are registered (fixed values, public registry practice).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Deviations of the posterior below its mean at which a host is judged: the lower quartile.
Z = 0.6745
#: Prior strength where the rates of a level do not vary beyond chance.
FLAT_STRENGTH = 1000.0
LEVELS = ("suffix", "domain", "host")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    # regexp_extract gives an empty text where nothing matches
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    fits = []
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        hit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(hit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def levels(host: Column) -> dict[str, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    return {"suffix": F.when(wide, two).otherwise(F.substring_index(host, ".", -1)),
            "domain": F.when(wide, F.substring_index(host, ".", -3)).otherwise(two)}


def reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``hosts`` (host) and ``outcomes`` (host, bad): per host labelled, bad_labelled, rate and bound of the posterior, and whether the bound
    lies above the overall rate."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    every = hosts.select("host").distinct().join(counts, "host", "left").fillna(0, ["n", "k"])
    table = stored(every.select("host", *[c.alias(x) for x, c in levels(F.col("host")).items()], "n", "k"), "url-hosts")
    whole = table.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = whole["k"] / whole["n"] if whole["n"] else 0.0
    prior = F.lit(mean)
    for level in LEVELS:
        per = table.groupBy(level).agg(F.sum("n").alias("ln"), F.sum("k").alias("lk"))
        rate = F.col("lk") / F.col("ln")
        v = per.filter("ln > 0").agg(F.var_samp(rate).alias("v"), F.avg(F.lit(mean * (1 - mean)) / F.col("ln")).alias("w")).first()
        between = (v["v"] or 0.0) - (v["w"] or 0.0)
        strength = max(mean * (1 - mean) / between - 1, 1.0) if between > 0 else FLAT_STRENGTH
        if level == "host":
            a = F.col("k") + prior * strength
            b = F.col("n") - F.col("k") + (1 - prior) * strength
            rate = a / (a + b)
            bound = rate - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
            return table.select("host", F.col("n").alias("labelled"), F.col("k").alias("bad_labelled"), rate.alias("rate"), bound.alias("bound"),
                                (bound > F.lit(mean)).alias("worse"))
        per = stored(per.withColumnRenamed(level, f"{level}_key"), "url-level")
        table = table.join(small(per), F.col(level) == F.col(f"{level}_key"))
        table = table.withColumn(f"p_{level}", (F.col("lk") - F.col("k") + prior * strength) / (F.col("ln") - F.col("n") + F.lit(strength)))
        table, prior = table.drop("ln", "lk", f"{level}_key"), F.col(f"p_{level}")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, labelled, bad_labelled, rate, bound) of every page.

    ``labels`` (doc_id, quality, toxic): a page is bad if it was labelled toxic or of low quality.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = stored(split, "url-pages")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marked = labels.select(F.col("doc_id").alias("__id"), bad.alias("bad")).filter("bad is not null")
    outcomes = split.join(marked, F.col("page_id") == F.col("__id")).select("host", "bad")
    known = stored(reputation(split, outcomes).withColumnRenamed("host", "__host"), "url-reputation")
    fit = split.withColumn("__fit", rule_of(F.col("host"), F.col("path"))).join(small(known), F.col("host") == F.col("__host"), "left")
    own = F.when(F.col("worse"), "block").otherwise("allow")
    return fit.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"),
                      F.coalesce("__fit.verdict", own).alias("verdict"), "labelled", "bad_labelled", "rate", "bound")
