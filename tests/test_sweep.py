"""As-of lookups and sweeps along holes against plain loops, with and without cutting holes in ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import drillhole
from lodeframe.plans import storage, sweep


@pytest.mark.parametrize("range_rows", [10**9, 20])
def test_as_of_equals_a_loop(spark, range_rows):
    rng = random.Random(1)
    marks = sorted({(rng.choice("aab"), rng.randrange(60) / 2) for _ in range(70)}) + [("c", 5.0)]
    asked = [(rng.choice("aabd"), rng.choice([rng.randrange(60) / 2, rng.uniform(-5, 40)]), k) for k in range(400)] + [("c", 4.9, 1000), ("c", 5.0, 1001), (None, 3.0, 1002), ("a", None, 1003)]
    m = spark.createDataFrame([(k, at, f"{k}{at}") for k, at in marks], "hole string, at double, mark string")
    q = spark.createDataFrame(asked, "hole string, at double, n long").withColumn("__range", F.lit("clash"))
    got = {r["n"]: r["mark"] for r in sweep.as_of(q, m, "hole", "at", "mark", range_rows).collect()}
    want = {}
    for k, at, n in asked:
        before = [x for h, x in marks if at is not None and h == k and x <= at]
        if before:
            want[n] = f"{k}{max(before)}"
    assert got == want


def plain_merge(tables):
    """Segments and counts of a merge by looking at all intervals for each segment."""
    out, tally = [], {}
    count = lambda k, n=1: tally.__setitem__(k, tally.get(k, 0) + n)
    holes = {h for t in tables for h, *_ in t}
    for hole in holes:
        own = [sorted([r for r in t if r[0] == hole], key=lambda r: (r[1], r[2], r[3])) for t in tables]
        has = [bool(o) for o in own]
        if sum(has) == 1:
            count(f"hole-only-{'abc'[has.index(True)]}")
        cuts = sorted({d for o in own for r in o for d in r[1:3]})
        ends, last = [], None
        for d in cuts:  # a break point closer than 1e-9 to the one before belongs to it
            if last is None or d - last > 1e-9:
                ends.append([d, d])
            ends[-1][1] = last = d
        for (a, a_last), (b, _) in zip(ends, ends[1:]):
            mid = (a + b) / 2
            over = [[r for r in o if r[1] <= mid <= r[2]] for o in own]
            if not any(over):
                continue
            out.append((hole, a, b, *[o[0][3] if o else None for o in over]))
            for k, o in enumerate(over):
                if has[k] and not o:
                    count(f"gap-{'abc'[k]}")
                if len(o) > 1:
                    count(f"overlap-{'abc'[k]}")
    return sorted(out, key=repr), tally


@pytest.mark.parametrize("range_rows", [10**9, 30])
def test_merge_of_three_tables_with_overlaps_and_near_break_points(spark, range_rows):
    rng = random.Random(2)
    tables = []
    for t in range(3):
        rows = []
        for k in range(150):
            f = rng.choice([rng.randrange(40) / 2, rng.uniform(0, 25)]) + rng.choice([0, 0, 4e-10, -4e-10])
            rows.append((rng.choice(["h1", "h1", "h2", f"h{3 + t}"]), f, f + rng.choice([0.5, 1.0, 7.25, rng.uniform(0.1, 3)]), f"{t}-{k}"))
        tables.append(rows)
    frames = [spark.createDataFrame(t, "bhid string, from double, to double, v string") for t in tables]
    frames[0] = frames[0].unionByName(spark.createDataFrame([("h1", 3.0, 3.0, "none"), ("h1", 5.0, 4.0, "none"), (" ", 0.0, 1.0, "none"), (None, 0.0, 1.0, "none"), ("h1", None, 1.0, "none")], frames[0].schema))
    out, report = drillhole.merge_all(frames, range_rows=range_rows)
    want, tally = plain_merge(tables)
    assert out.columns == ["bhid", "from", "to", "v", "v_2", "v_3"]
    assert sorted(map(tuple, out.collect()), key=repr) == want
    got = {r["check_id"]: r["count"] for r in report.collect()}
    assert {k: n for k, n in got.items() if n and k != "column-collision"} == tally and got["column-collision"] == 2


def test_merge_takes_row_numbers_and_tables_of_one_or_none(spark):
    a = spark.createDataFrame([("h", 0.0, 2.0, "second", 2), ("h", 0.0, 3.0, "first", 1)], "bhid string, from double, to double, v string, n long")
    rows, _ = drillhole.merge_all([a], order="n")
    assert [tuple(r) for r in rows.orderBy("from").collect()] == [("h", 0.0, 2.0, "first"), ("h", 2.0, 3.0, "first")]
    rows, report = drillhole.merge_all([a.drop("n"), a.drop("n").limit(0)])
    assert [(r["from"], r["v"], r["v_2"]) for r in rows.orderBy("from").collect()] == [(0.0, "second", None), (2.0, "first", None)]
    assert {r["check_id"]: r["count"] for r in report.collect()}["hole-only-a"] == 1
    bare = spark.createDataFrame([("h", 1.0, 2.0)], "bhid string, from double, to double")
    assert drillhole.merge_all([a.drop("n"), bare])[0].columns == ["bhid", "from", "to", "v"]


def test_plans_have_no_join_of_points_and_segments(spark):
    holes = spark.range(20).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("bhid"))
    collars = holes.select("bhid", *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "eoh")])
    surveys = holes.select("bhid", F.explode(F.array(F.lit(0.0), F.lit(50.0))).alias("depth"), F.lit(10.0).alias("az"), F.lit(60.0).alias("dip"))
    iv = holes.select("bhid", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("n")).select("bhid", F.col("n").cast("double").alias("from"), (F.col("n") + 1.0).alias("to"))
    known = drillhole.first_collars(collars)
    path = drillhole.desurvey(drillhole.clean_surveys(surveys, known), known)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(drillhole.positions(iv, path, "from")) == joins(path)
    assert joins(drillhole.merge_all([iv, iv, iv])[0]) == 0


def test_a_hole_of_a_million_intervals(spark):
    """Positions along one hole whose intervals are cut in ranges: as many as asked for, each at its depth."""
    collars = spark.createDataFrame([("big", 0.0, 0.0, 0.0), ("small", 0.0, 0.0, 0.0)], "bhid string, x double, y double, z double")
    surveys = spark.createDataFrame([("big", 1000.0 * k, 0.0, 90.0) for k in range(1000)] + [("small", 0.0, 90.0, 0.0)], "bhid string, depth double, az double, dip double")
    points = spark.range(1_000_000).select(F.lit("big").alias("bhid"), F.col("id").cast("double").alias("depth")).unionByName(spark.createDataFrame([("small", 7.0)], "bhid string, depth double"))
    known = drillhole.first_collars(collars)
    path = drillhole.desurvey(drillhole.clean_surveys(surveys, known), known)
    out = drillhole.positions(points, path)
    got = out.groupBy("bhid").agg(F.count("*").alias("n"), F.max(F.abs(F.col("pz") + F.col("depth"))).alias("off"), F.max("px").alias("px"))
    got = {r["bhid"]: r for r in got.collect()}
    assert got["big"]["n"] == 1_000_000 and got["big"]["off"] < 1e-6
    assert got["small"]["n"] == 1 and math.isclose(got["small"]["px"], 7.0)


def test_tasks_of_drillhole_operators_grow_with_their_rows(spark, monkeypatch):
    """A thousand rows in tasks of fifty are dealt over twenty tasks, whatever number shuffles have by default."""
    monkeypatch.setattr(storage, "TASK_ROWS", 50, raising=False)
    iv = spark.createDataFrame([(f"h{k % 250}", float(k // 250), k // 250 + 1.0, float(k)) for k in range(1000)], "bhid string, from double, to double, v double")
    collars = spark.createDataFrame([(f"h{k}", float(k), 0.0, 0.0) for k in range(250)], "bhid string, x double, y double, z double")
    stations = spark.createDataFrame([(f"h{k % 250}", float(k // 250), 10.0, 60.0 + k // 250) for k in range(1000)], "bhid string, depth double, az double, dip double")
    parts = drillhole.composite(iv.withColumnsRenamed({"from": "f", "to": "t"}), 2.0, {"v": "mean"})
    cleaned = drillhole.clean_surveys(stations, collars)
    merged = drillhole.merge(iv, iv.withColumnRenamed("v", "w"))[0]
    placed = drillhole.desurvey_intervals(collars, stations, iv)
    assert [d.rdd.getNumPartitions() >= 20 for d in (parts, cleaned, merged, placed)] == [True] * 4
    assert [d.count() for d in (parts, cleaned, merged, placed)] == [500, 1000, 1000, 1000]


@pytest.mark.parametrize("groups", [1, 65_536])
def test_only_keys_of_many_rows_are_cut(spark, monkeypatch, groups):
    """Keys that share a hash group with a large one are not cut, nor are those of a group that is only large together."""
    monkeypatch.setattr(sweep, "KEY_GROUPS", groups)
    rows = spark.createDataFrame([("large" if k < 300 else f"k{k % 20}", float(k)) for k in range(500)], "hole string, at double")
    total, cuts = sweep.sized(rows, "hole", "at", 100)
    assert total == 500 and [r["hole"] for r in cuts.collect()] == ["large"]
    assert sweep.sized(rows.where("hole <> 'large'"), "hole", "at", 100) == (200, None)
