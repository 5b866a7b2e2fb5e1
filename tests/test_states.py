"""Mergeable states of moments and distributions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import states, statistics


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in zip(*(np.asarray(c, object).tolist() for c in columns.values()))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'string' if isinstance(next(v for v in c if v is not None), str) else 'double'}" for n, c in zip(names, columns.values())))


def weighted(v, w):
    m = (w * v).sum() / w.sum()
    d = v - m
    m2, m3, m4, total = (w * d**2).sum(), (w * d**3).sum(), (w * d**4).sum(), w.sum()
    return m, np.sqrt(m2 / total), np.sqrt(total) * m3 / m2**1.5, total * m4 / m2**2 - 3


def test_weighted_moments_read_the_table_once_and_keep_digits_far_from_zero(spark, tmp_path):
    rng = np.random.default_rng(1)
    v, w = rng.gamma(2.0, 1.0, 4000) + 1e9, rng.random(4000) + 0.1
    frame(spark, v=v, w=w).repartition(9).write.parquet(str(tmp_path / "t"))
    out = statistics.moments(spark.read.parquet(str(tmp_path / "t")), ["v"], "w")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and "Join" not in plan
    r = out.first()
    mean, std, skew, kurt = weighted((v - 1e9), w)
    assert r["mean"] == pytest.approx(mean + 1e9, rel=1e-15)
    assert (r["std"], r["skew"], r["kurt"]) == (pytest.approx(std, rel=1e-7), pytest.approx(skew, rel=1e-6), pytest.approx(kurt, rel=1e-6))


def test_states_of_parts_merge_to_the_whole(spark, monkeypatch):
    """Groups, nulls, skipped weights, single rows, and tasks that hand on their groups early."""
    monkeypatch.setattr(states, "MOST_GROUPS", 7)
    rng = np.random.default_rng(2)
    n = 3000
    g = np.array([f"g{k}" for k in rng.zipf(1.5, n) % 40])
    v, u = rng.normal(5, 2, n), rng.integers(-2, 3, n).astype(float)
    v[rng.random(n) < 0.1] = np.nan
    w = np.where(rng.random(n) < 0.05, -1.0, rng.random(n) + 0.5)
    df = frame(spark, g=g, v=v, u=u, w=w).repartition(11)
    parts = [statistics.states_of_moments(df.where(c), ["v", "u"], "w", "g") for c in ("u < 0", "u = 0", "u > 0 and v is not null", "u > 0 and v is null")]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    got = {(r["variable"], r["group"]): r for r in statistics.moments_of(states.merge_moments(both)).collect()}
    once = {(r["variable"], r["group"]): r for r in statistics.moments(df, ["v", "u"], "w", "g").collect()}
    assert set(got) == set(once) == {(x, k) for x in "vu" for k in set(g[w > 0])}
    for (name, k), r in got.items():
        x = {"v": v, "u": u}[name]
        own = (g == k) & (w > 0)
        known = own & ~np.isnan(x)
        assert (r["count"], r["nulls"], r["zeros"]) == (known.sum(), (own & np.isnan(x)).sum(), (x[known] == 0).sum())
        if known.any():
            mean, std, skew, kurt = weighted(x[known], w[known]) if known.sum() > 1 else (x[known][0], None, None, None)
            assert r["mean"] == pytest.approx(mean) and r["min"] == x[known].min() and r["max"] == x[known].max() and r["sum_w"] == pytest.approx(w[known].sum())
            if known.sum() > 3 and std > 0:
                assert (r["std"], r["skew"], r["kurt"]) == (pytest.approx(std), pytest.approx(skew, abs=1e-8), pytest.approx(kurt, abs=1e-8))
        else:
            assert r["mean"] is None and r["min"] is None and r["sum_w"] is None
        for c in r.asDict():
            assert once[name, k][c] == r[c] or once[name, k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)


def test_moments_of_no_rows_and_of_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), 1.0), (None, 1.0), (2.0, None), (1e200, 1.0), (-1e200, 1.0)], "v double, w double")
    r = statistics.moments(df, ["v"], "w").first()
    assert (r["count"], r["nulls"], r["mean"], r["skew"]) == (2, 3, 0.0, None)
    assert statistics.moments(df.limit(0), ["v"], "w").count() == 0


def interpolated(v, w, qs):
    x, at = np.unique(v, return_inverse=True)
    c = np.bincount(at, w)
    return np.interp(np.array(qs) * c.sum(), np.cumsum(c) - c / 2, x)


PERCENTS = tuple(k / 100 for k in range(1, 100))


def test_digests_are_exact_up_to_their_limit_and_close_beyond(spark):
    """Parts by value, by place and of one row merge to a digest within 0.05 % of the exact percentiles."""
    rng = np.random.default_rng(3)
    v, w = rng.lognormal(3, 0.4, 60_000), rng.random(60_000) + 0.5
    df = frame(spark, v=v, w=w, k=np.round(v)).repartition(6)
    held = [statistics.digest(df.where(c), ["v", "k"], "w", exact_values=3000) for c in ("v < 15", "v >= 15 and v < 22", "v >= 22")]
    whole = states.merge_digests(held[0].unionByName(held[1]).unionByName(held[2]), 3000).cache()
    flags = {r["variable"]: (r["n"], r["e"]) for r in whole.groupBy("variable").agg(F.count("*").alias("n"), F.bool_or("exact").alias("e")).collect()}
    assert flags["k"] == (len(np.unique(np.round(v))), True) and flags["v"][0] < 2500 and not flags["v"][1]
    got = {(r["variable"], r["q"]): r["value"] for r in statistics.digest_quantiles(whole, PERCENTS).collect()}
    for name, x, slack in (("v", v, 5e-4), ("k", np.round(v), 1e-12)):
        for q, want in zip(PERCENTS, interpolated(x, w, PERCENTS)):
            assert got[name, q] == pytest.approx(want, rel=slack), (name, q)
    assert whole.where("variable = 'v'").agg(F.sum("weight")).first()[0] == pytest.approx(w.sum())


def test_digests_by_group_with_heavy_values_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(states, "MOST_VALUES", 1000)
    rng = np.random.default_rng(4)
    n = 12_000
    g = np.where(rng.random(n) < 0.4, "hot", np.array([f"g{k}" for k in rng.integers(0, 300, n)]))
    v = np.where(rng.random(n) < 0.3, 7.0, rng.normal(10, 3, n))
    df = frame(spark, g=g, v=v).repartition(5)
    held = statistics.digest(df, ["v"], group="g", exact_values=100)
    got = {(r["group"], r["q"]): r["value"] for r in statistics.digest_quantiles(held, (0.05, 0.3, 0.5, 0.9)).collect()}
    assert len(got) == 4 * len(set(g))
    for k in set(g):
        for q, want in zip((0.05, 0.3, 0.5, 0.9), interpolated(v[g == k], np.ones((g == k).sum()), (0.05, 0.3, 0.5, 0.9))):
            assert got[k, q] == pytest.approx(want, rel=0.02 if k == "hot" else 1e-9), (k, q)
    spike = held.where("group = 'hot' and mean = 7").first()  # a value heavier than a centroid may be stands alone
    assert spike["weight"] == ((g == "hot") & (v == 7)).sum()


def test_digests_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (3.0, -1.0)], "v double, w double")
    assert statistics.digest(df, ["v"], "w").count() == 0
    assert statistics.digest_quantiles(statistics.digest(df.limit(0), ["v"])).count() == 0


def test_shares_at_values(spark):
    df = frame(spark, v=[-1.0, 1.0, 1.0, 2.0, 4.0])
    look = lambda at, log=False: {r["at"]: r["share"] for r in statistics.shares_at(statistics.weighted_cells(df, "v"), at, log=log).collect()}
    assert look((-5.0, -1.0, 0.0, 1.0, 1.5, 3.0, 4.0, 9.0)) == {-5.0: 0.0, -1.0: 0.0, 0.0: 0.4, 1.0: 0.6, 1.5: pytest.approx(0.7), 3.0: 0.9, 4.0: 1.0, 9.0: 1.0}
    assert look((-5.0, 0.5, 1.0, 1.5, 9.0), True) == {-5.0: 0.0, 0.5: 0.0, 1.0: 0.0, 1.5: pytest.approx(0.7), 9.0: 1.0}
