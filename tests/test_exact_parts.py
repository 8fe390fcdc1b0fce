"""Nearest-neighbour MI, isotonic calibration and tree attributions against brute force."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from churnspark.operators import explain as EX
from churnspark.operators import hist_trees as H
from churnspark.operators import isotonic as ISO
from churnspark.operators import neighbours as NB
from churnspark.operators import tree_search as TS
from churnspark.operators.ranks import running_sum


def psi(x):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(x)))


def brute_mi(rows, k=3):
    """rows: (v, class)."""
    counts = {c: sum(y == c for _, y in rows) for _, c in rows}
    rows = [r for r in rows if counts[r[1]] > 1]
    if len({y for _, y in rows}) < 2:
        return 0.0
    total = 0.0
    for i, (v, c) in enumerate(rows):
        mine = sorted((abs(o - v), o) for j, (o, y) in enumerate(rows) if y == c and j != i)
        kk = min(k, counts[c] - 1)
        r, at = mine[kk - 1]
        lo, hi = (v - r, at) if at > v else (at, v + r)
        m = sum(lo < o < hi for o, _ in rows)
        total += psi(kk) - psi(counts[c]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("chunk,range_rows", [(50_000, 500_000), (10, 37)])
def test_neighbour_mi_equals_brute_force(spark, chunk, range_rows):
    rng = np.random.default_rng(4)
    n = 300
    y = (rng.random(n) < 0.3).astype(int)
    cols = {"signal": rng.normal(size=n) + 1.5 * y, "noise": rng.normal(size=n), "ties": (rng.integers(0, 3, n) + y).astype(float),
            "hot": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)), "flat": np.full(n, 7.0)}
    rows = [(i, int(y[i]), *(float(c[i]) if (i + j) % 17 else None for j, c in enumerate(cols.values()))) for i in range(n)]
    df = spark.createDataFrame(rows, "c_custkey int, label int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {r.feature: r.mi for r in NB.neighbour_mi(df, list(cols), chunk=chunk, range_rows=range_rows).collect()}
    long = {}
    for r in NB.long_values(df, list(cols), "label", "c_custkey", None).collect():
        long.setdefault(r.feature, []).append((r.v, r.y))
    assert got.keys() == cols.keys()
    for c in cols:
        assert abs(got[c] - brute_mi(long[c])) < 1e-6, c
    assert got["signal"] > 0.15 > got["noise"]


def test_neighbour_mi_of_rows_that_stay_equal(spark, monkeypatch):
    monkeypatch.setattr(NB, "NOISE", 0.0)     # as where more rows share a value than a double holds noises
    rng = np.random.default_rng(6)
    y = (rng.random(200) < 0.4).astype(int)
    cols = {"few": rng.integers(0, 4, 200) + 2 * y, "flat": np.full(200, 7), "some": np.where(rng.random(200) < 0.5, 1.0, rng.normal(size=200)),
            "next": np.where(rng.random(200) < 0.3, 1 - 2.0 ** -53, 1 + rng.integers(0, 70, 200))}
    rows = [(i, int(y[i]), *(float(c[i]) for c in cols.values())) for i in range(200)]
    df = spark.createDataFrame(rows, "c_custkey int, label int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.mi for r in NB.neighbour_mi(df, list(cols), chunk=30, range_rows=70).collect()}
    for c, x in cols.items():
        total = 0.0
        for v, own in zip(x, y):
            near = sorted((abs(o - v), o) for o, w in zip(x, y) if w == own)[1:]     # less the row itself
            r, at = near[2]
            lo, hi = (v - r, at) if at > v else (at, v + r)
            total += psi(3) - psi((y == own).sum()) - psi(sum(bool(o == v or lo < o < hi) for o in x))
        assert abs(got[c] - max(0.0, psi(200) + total / 200)) < 1e-6, c
    assert got["flat"] == 0


def test_neighbour_mi_of_odd_tables(spark):
    one = spark.createDataFrame([(1, 0, 1.0, None), (2, 0, 2.0, None), (3, 1, 5.0, None)], "c_custkey int, label int, a double, b double")
    got = {r.feature: r.mi for r in NB.neighbour_mi(one, ["a", "b"]).collect()}
    assert got == {"a": 0.0, "b": 0.0}      # a class of one row is left out; no value at all
    assert {r.mi for r in NB.neighbour_mi(one.filter("false"), ["a"]).collect()} == {0.0}


def test_running_sum_over_ranges(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    got = {(r.g, r.o): r.s for r in running_sum(df, ["g"], ["o"], F.col("v"), "s", "t", range_rows=9).collect()}
    for g, o, _ in rows:
        assert got[g, o] == sum(v for g2, o2, v in rows if g2 == g and o2 <= o)


def test_isotonic_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ISO, "FAN", 2)
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < 0.2 + 0.6 * p ** 2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, label int")
    # min-max formula of isotonic regression over the distinct scores
    x = np.unique(p)
    s, k = np.array([y[p == a].sum() for a in x]), np.array([(p == a).sum() for a in x])
    means = np.array([[s[i:j + 1].sum() / k[i:j + 1].sum() if i <= j else np.nan for j in range(len(x))] for i in range(len(x))])
    want = [max(min(means[i, j] for j in range(v, len(x))) for i in range(v + 1)) for v in range(len(x))]
    for range_rows in (500_000, 60):
        m = ISO.fit_isotonic(df, range_rows=range_rows)
        assert np.allclose(np.interp(x, m.x, m.y), want)
    got = {r.p: r.p_cal for r in m.apply(df).distinct().collect()}
    assert np.allclose([got[a] for a in x], want)
    with pytest.raises(ValueError):
        ISO.fit_isotonic(df.filter("false"))


def path_value(model, x, known, root):
    """Output of a tree for the features in ``known``; others follow the training rows."""
    i = root
    f = model.feature[i]
    if f < 0:
        return model.value[i]
    left = model.left[i]
    if f in known:
        return path_value(model, x, known, left + int(x[f] > model.threshold[i]))
    return sum(model.cover[c] / model.cover[i] * path_value(model, x, known, c) for c in (left, left + 1))


@pytest.mark.parametrize("spec", [dict(rounds=3, depth=5, l2=1.0, rate=0.3, init=0.2), dict(rule="gini", rounds=1, trees=2, depth=6, rows="poisson", mtry="sqrt"),
                                  dict(growth="oblivious", rounds=2, depth=3, l2=1.0, rate=0.5)])
def test_attributions_equal_the_sum_over_all_subsets(spark, spec):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, (300, 5)).astype(np.uint8)
    y = (rng.random(300) < 0.2 + 0.1 * x[:, 0] * (x[:, 1] > 3)).astype(np.int64)
    s = H.Spec(0, 0, **spec)
    b = H.Block(x, y, np.arange(300, dtype=np.uint64), np.zeros(300, bool), [s], 8).start().grow(10, True)
    m = TS.TreeEnsembleModel(b.trees, [[i + 0.5 for i in range(7)]] * 5, s.rate, s.init, s.boosts)
    rows, paths = x[:6].astype(float), m.paths()
    got = m.attributions(rows, paths)
    scale = m.rate if m.boosts else 1 / m.n_trees
    for r, phi in zip(rows, got):
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = 0.0
            for size in range(5):
                weight = math.factorial(size) * math.factorial(4 - size) / math.factorial(5)
                for known in itertools.combinations(others, size):
                    want += weight * sum(path_value(m, r, {*known, f}, t) - path_value(m, r, set(known), t) for t in m.roots)
            assert abs(phi[f] - scale * want) < 1e-9
    assert np.allclose(got.sum(axis=1) + m.expected(paths), m.margin(rows))
    if m.boosts and s.growth == "level":
        df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(rows)], ["k", "features"])

        class Names:
            def output_names(self):
                return [f"f{i}" for i in range(5)]
        table = {(r.k, r.feature): (r.value, r.phi) for r in EX.tree_shap(df, Names(), m, "k").collect()}
        assert len(table) == 30 and all(abs(table[i, f"f{j}"][1] - got[i, j]) < 1e-12 for i in range(6) for j in range(5))


def test_correlation_filter_over_many_column_blocks(spark, monkeypatch):
    from churnspark.operators import features as FE
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 12))
    cols = [base[:, i] for i in range(12)] + [base[:, 3] * 2 + 1e-3 * rng.normal(size=200), -base[:, 8] * 0.5, np.full(200, 4.0), base[:, 0] + base[:, 1]]
    names = [f"c{i}" for i in range(len(cols))]
    df = spark.createDataFrame([tuple(float(c[r]) for c in cols) for r in range(200)], ", ".join(f"{n} double" for n in names)).repartition(5)
    want = set()
    for j in range(len(cols)):
        for i in range(j):
            if cols[i].std() and cols[j].std() and abs(np.corrcoef(cols[i], cols[j])[0, 1]) > 0.95:
                want.add(names[j] if cols[j].var() < cols[i].var() else names[i])
    assert want == {"c3", "c13"}
    for width, fan in ((256, 16), (5, 2)):
        monkeypatch.setattr(FE, "GRAM_COLUMNS", width)
        monkeypatch.setattr(FE, "GRAM_FAN", fan)
        assert {r.feature for r in FE.correlation_dedup(df, names).collect() if r.dropped} == want


def test_correlation_filter_of_two_thousand_columns(spark):
    from churnspark.operators import features as FE
    names = [f"c{i}" for i in range(2000)]
    df = spark.range(50).select(*[F.rand(i).alias(n) for i, n in enumerate(names[:-1])]).withColumn("c1999", F.col("c7") * 3)
    assert [r.feature for r in FE.correlation_dedup(df, names).collect() if r.dropped] == ["c7"]
