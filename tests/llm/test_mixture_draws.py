"""Draws of the splitting tree at any pool size."""
import math
import time

import pytest
from pyspark.sql import functions as F

from churnspark.llm import mix


def log_pmf(n, q, m, k):
    def c(a, b):
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return c(q, k) + c(n - q, m - k) - c(n, m)


@pytest.mark.parametrize("n,q,m", [(100_000, 40_000, 45_000), (100_000, 70_000, 45_000), (100_000, 40_000, 80_000), (600_000, 550_000, 400_000)])
def test_wide_draws_follow_the_distribution(spark, n, q, m):
    size = 20_000
    u = spark.range(size).select(((F.col("id") + 0.5) / size).alias("u"))
    got = {r.k: r["count"] for r in u.select(F.expr(mix._hypergeometric(f"{n}L", f"{q}L", f"{m}L", "u")).alias("k")).groupBy("k").count().collect()}
    sd = math.sqrt(m * (q / n) * (1 - q / n) * (n - m) / (n - 1))
    assert sd > mix.WALK and all(0 <= k <= min(q, m) and m - k <= n - q for k in got)
    # chi-square over about thirty cells of equal width
    width, mean = max(1, round(sd / 5)), m * q / n
    seen, want = {}, {}
    for k, c in got.items():
        seen[(k - round(mean)) // width] = seen.get((k - round(mean)) // width, 0) + c
    for k in range(round(mean - 8 * sd), round(mean + 8 * sd)):
        want[(k - round(mean)) // width] = want.get((k - round(mean)) // width, 0) + math.exp(log_pmf(n, q, m, k)) * size
    cells = [c for c in want if want[c] >= 5]
    chi2 = sum((seen.get(c, 0) - want[c]) ** 2 / want[c] for c in cells)
    assert chi2 < len(cells) + 4 * math.sqrt(2 * len(cells))


def test_a_draw_from_a_huge_pool_takes_no_time(spark):
    n, q, m = 10 ** 12, 3 * 10 ** 11, 5 * 10 ** 11
    expr = F.expr(mix._hypergeometric("n", "q", "m", "u"))
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"), F.lit(n).alias("n"), F.lit(q).alias("q"), F.lit(m).alias("m"))
    u.limit(1).select(expr).collect()
    t = time.time()
    got = [r.k for r in u.select(expr.alias("k")).collect()]
    assert (time.time() - t) / len(got) < 0.1
    sd = math.sqrt(m * (q / n) * (1 - q / n) * (n - m) / (n - 1))
    z = [(k - m * q / n) / sd for k in got]
    assert abs(sum(z) / len(z)) < 0.1 and abs(sum(x * x for x in z) / len(z) - 1) < 0.15 and max(map(abs, z)) < 6


def test_draws_at_the_edges(spark):
    rows = [(0, 0, 0), (10, 0, 5), (10, 10, 5), (10, 4, 0), (10, 4, 10), (1, 1, 1), (2, 1, 1), (10 ** 9, 10 ** 9, 5 * 10 ** 8), (10 ** 9, 1, 5 * 10 ** 8)]
    df = spark.createDataFrame([(i, *r, 0.3) for i, r in enumerate(rows)], "i int, n long, q long, m long, u double")
    for r in df.select("*", F.expr(mix._hypergeometric("n", "q", "m", "u")).alias("k")).collect():
        assert max(0, r.m - (r.n - r.q)) <= r.k <= min(r.q, r.m)
