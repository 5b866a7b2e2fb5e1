"""Operators against hand-made cases, closed forms and small brute-force models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import categories, declustering, drillhole, geometry, grade_tonnage, section, statistics, swath, topcut
from lodeframe.functions import scalar, units


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def model_quantile(pairs, q):
    """Quantile by mid-points of distinct values' weights, straight from its definition."""
    cells = {}
    for v, w in pairs:
        cells[v] = cells.get(v, 0) + w
    total, below, mids = sum(cells.values()), 0.0, []
    for v in sorted(cells):
        mids.append((below + cells[v] / 2, v))
        below += cells[v]
    t = q * total
    if q <= 0:
        return mids[0][1]
    if q >= 1:
        return mids[-1][1]
    for j, (m, v) in enumerate(mids):
        if t < m:
            if j == 0:
                return v
            pm, pv = mids[j - 1]
            return pv + (v - pv) * (t - pm) / (m - pm)
    return mids[-1][1]


def test_quantiles_follow_the_definition(spark):
    rng = random.Random(4)
    for values in ([1, 2, 2, 3, 10, 50], [5], [1, 1, 1], [rng.randint(0, 40) for _ in range(500)]):
        rows = [(float(v), float(rng.randint(1, 5))) for v in values]
        at = (0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
        df = frame(spark, rows, "v double, w double")
        for weight in (None, "w"):
            got = {r["q"]: r["value"] for r in statistics.quantiles(df, "v", at, weight).collect()}
            for q in at:
                assert got[q] == pytest.approx(model_quantile([(v, w if weight else 1.0) for v, w in rows], q))


def test_moments_corrections_and_nulls(spark):
    df = frame(spark, [(x, 1.0) for x in (1.0, 2.0, 2.0, 3.0, 10.0, 50.0)] + [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (7.0, 0.0), (7.0, None)], "v double, w double")
    r = statistics.moments(df, ["v"], "w").first()
    assert (r["count"], r["nulls"], r["sum_w"]) == (6, 3, 6.0)
    r = statistics.moments(df.where("w > 0"), ["v"]).first()
    assert r["skew"] == pytest.approx(2.30228, abs=1e-5) and r["kurt"] == pytest.approx(5.37394, abs=1e-5)
    one = statistics.moments(df.limit(1), ["v"]).first()
    assert one["std"] is None and one["skew"] is None
    none = statistics.moments(df.where("false"), ["v"]).first()
    assert none["count"] == 0 and none["mean"] is None


def test_equal_weights_change_no_mean_or_quantile(spark):
    df = frame(spark, [(float(v), 3.0) for v in (4, 8, 15, 16, 23, 42)], "v double, w double")
    a, b = statistics.moments(df, ["v"]).first(), statistics.moments(df, ["v"], "w").first()
    assert a["mean"] == pytest.approx(b["mean"])
    key = lambda d: [r["value"] for r in d.orderBy("q").collect()]
    assert key(statistics.quantiles(df, "v")) == pytest.approx(key(statistics.quantiles(df, "v", weight="w")))


def test_normal_scores(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.001, 0.02, 0.1, 0.5, 0.77, 0.98, 0.999]
    got = frame(spark, [(p,) for p in ps], "p double").select(scalar.normal_score(F.col("p"))).collect()
    for p, r in zip(ps, got):
        assert r[0] == pytest.approx(NormalDist().inv_cdf(p), abs=5e-8)


def test_scalar_semantics(spark):
    df = frame(spark, [(-2.5, float("nan"), None)], "a double, b double, c double")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(scalar.round_half_up(a), scalar.trunc(a), scalar.ifnull(b, 7), scalar.ifnull(c, 7), scalar.least_of(a, c), scalar.cap(c, 3), scalar.between(c, 0, 1), scalar.isnum(b), scalar.sqrt(a), scalar.remap(a, {-2.5: "x"}, "y"), scalar.truthy(a, "number"), scalar.truthy(c, "number")).first()
    assert list(got) == [-2.0, -2.0, 7.0, 7.0, None, None, False, False, None, "x", True, False]


def test_units_and_roles():
    assert [units.sniff_unit(n) for n in ("Au_ppm", "FE_PCT", "Au_gt", "CU(%)", "AU_OZT", "LITO")] == ["ppm", "%", "g/t", "%", "oz/t", "raw"]
    assert units.guess_roles(["Fe", "EAST", "NORTH", "RL"]) == {"x": "EAST", "y": "NORTH", "z": "RL"}
    assert units.guess_roles(["a", "b", "c", "d"]) == {"x": "a", "y": "b", "z": "c"}


def test_categories_cap_and_flags(spark):
    df = frame(spark, [(f"c{i:04d}", "") for i in range(600)] + [("c0000", None)], "k string, e string")
    got = categories.counts(df, ["k", "e"])
    assert got.count() == 500 and got.first()["overflow"] and got.where("value = 'c0000'").first()["n"] == 2
    grouped = categories.grouped_statistics(frame(spark, [(float(i), i) for i in range(600)], "v double, g long"), ["v"], "g")
    assert grouped.count() == 500 and grouped.where("overflow").count() == 500


def test_group_keys_of_numbers_and_nulls(spark):
    df = frame(spark, [(0.0, 1.0), (0.0, 3.0), (None, 5.0), (0.5, 1.0)], "g double, v double")
    got = {r["group"]: r["count"] for r in statistics.moments(df, ["v"], group="g").collect()}
    assert got == {"0": 2, "": 1, "0.5": 1}


def test_agreement(spark):
    cells = frame(spark, [("a", "a", 20, 20.0), ("a", "b", 5, 5.0), ("b", "a", 5, 5.0), ("b", "b", 20, 20.0)], "a string, b string, n long, w double")
    r = categories.agreement(cells).first()
    assert r["po"] == pytest.approx(0.8) and r["kappa"] == pytest.approx(0.6) and r["band"] in ("moderate", "substantial")
    assert categories.agreement(cells.where("a = 'a' and b = 'a'")).first()["kappa"] is None


def test_grade_tonnage_totals_and_identity(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 5), rng.uniform(1, 3)) for _ in range(300)] + [(None, 1.0), (1.0, -1.0)]
    df = frame(spark, rows, "g double, d double")
    cells = grade_tonnage.bins(df, {"g": grade_tonnage.grade_range(df, "g")}, density="d")
    got = {r["cutoff"]: r for r in grade_tonnage.at_cutoffs(cells, [0.0, 2.0, 9.0]).collect()}
    good = [(g, d) for g, d in rows if g is not None and d > 0]
    assert got[0.0]["tonnage"] == pytest.approx(sum(d for _, d in good)) and got[0.0]["pct"] == pytest.approx(100)
    assert got[2.0]["tonnage"] == pytest.approx(sum(d for g, d in good if g >= 2), rel=2e-2)
    exact = {r["cutoff"]: r for r in grade_tonnage.exact(df, "g", [2.0, 3.0], density="d").collect()}
    assert exact[2.0]["tonnage"] == pytest.approx(sum(d for g, d in good if g >= 2))
    same = grade_tonnage.theoretical(df.where("d > 0"), "g", [2.0], 1.0, "d").first()
    assert same["grade"] == pytest.approx(sum(g * d for g, d in good if g > 2) / sum(d for g, d in good if g > 2))
    reasons = {r["reason"]: r["n"] for r in grade_tonnage.exclusions(df, density="d").collect()}
    assert reasons == {"density": 1}


def test_swath_frame_and_single_rows(spark):
    f = swath.rotated_frame(35, 60, 20)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, b in (("u", "v"), ("u", "w"), ("v", "w")):
        assert dot(f[a], f[b]) == pytest.approx(0, abs=1e-12)
    df = frame(spark, [(1.0, 0.0, 0.0, 5.0), (None, 1.0, 1.0, 7.0)], "x double, y double, z double, v double")
    r = swath.profile(df, ["v"], {"x": ("x", 10.0)}).collect()
    assert len(r) == 1 and r[0]["std"] == 0.0 and r[0]["centre"] == 5.0
    assert swath.profile(df, ["v"], {"n": ((0.0, 1.0, 0.0), 10.0)}).first()["count"] == 2


def test_topcut_against_brute_force(spark):
    rng = random.Random(3)
    v = [math.exp(rng.gauss(0, 1)) for _ in range(200)]
    df = frame(spark, [(x,) for x in v], "v double")
    for r in topcut.at_caps(df, "v", [0.5, 2.0, 99.0]).collect():
        capped = [min(x, r["cap"]) for x in v]
        mean = sum(capped) / len(v)
        assert r["mean"] == pytest.approx(mean) and r["n_capped"] == sum(x > r["cap"] for x in v)
        assert r["std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in capped) / (len(v) - 1)))
    assert topcut.histogram(df, "v", log=True).agg(F.sum("n")).first()[0] == 200


def test_geometry_of_sub_blocks():
    assert geometry.block_size([(10.0, 90), (5.0, 30), (2.5, 20)]) == (10.0, [2.5, 5.0])
    assert geometry.block_size([(10.0, 90), (7.0, 30)]) == (10.0, [])
    assert geometry.block_size([]) == (None, [])
    assert geometry.block_size([(4.0, 9)]) == (4.0, [])


def test_geometry_of_a_grid(spark):
    rows = [(10.0 * i + 5, 20.0 * j, 7.0) for i in range(6) for j in range(4)]
    got = {r["axis"]: r for r in geometry.axes_geometry(frame(spark, rows, "x double, y double, z double"), {a: a for a in "xyz"}).collect()}
    assert (got["x"]["size"], got["x"]["count"], got["x"]["extent"]) == (10.0, 6, 60.0)
    assert (got["y"]["size"], got["z"]["size"]) == (20.0, None)


def brute_declus(points, size, offsets):
    n, w = len(points), [0.0] * len(points)
    lo = [min(p[a] for p in points) for a in (0, 1)]
    hi = [max(p[a] for p in points) for a in (0, 1)]
    for k in range(1, offsets + 1):
        o = [lo[a] - 0.01 - (k - 1) * min(size / offsets, 0.5 * (hi[a] - lo[a])) for a in (0, 1)]
        cell = [tuple(math.floor((p[a] - o[a]) / size) for a in (0, 1)) for p in points]
        count = {c: cell.count(c) for c in cell}
        total = sum(1 / count[c] for c in cell)
        for i, c in enumerate(cell):
            w[i] += 1 / count[c] / total
    return [x * n / sum(w) for x in w]


def test_declustering_against_brute_force(spark):
    rng = random.Random(9)
    pts = [(rng.gauss(20, 2), rng.gauss(20, 2), 9.0) for _ in range(40)] + [(rng.uniform(0, 100), rng.uniform(0, 100), 1.0) for _ in range(30)]
    df = frame(spark, [(i, *p) for i, p in enumerate(pts)], "id long, x double, y double, v double")
    sweep = declustering.Sweep.between(5.0, 40.0, 5, offsets=4)
    curve = {r["size"]: r["mean"] for r in declustering.curve(df, {"x": "x", "y": "y"}, "v", sweep).collect()}
    best = declustering.best_size(declustering.curve(df, {"x": "x", "y": "y"}, "v", sweep))
    for size in sweep.sizes:
        w = brute_declus(pts, size, 4)
        assert curve[size] == pytest.approx(sum(a * p[2] for a, p in zip(w, pts)) / sum(w))
    assert best == min(curve, key=lambda s: (curve[s], s)) and best > 0
    got = {r["id"]: r["weight"] for r in declustering.weights(df, {"x": "x", "y": "y"}, "v", sweep, "id").collect()}
    want = brute_declus(pts, best, 4)
    assert [got[i] for i in range(len(pts))] == pytest.approx(want) and sum(got.values()) == pytest.approx(len(pts))


def test_declustering_of_a_flat_and_a_short_axis(spark):
    """An axis without extent and one shorter than a step between origins, against the sum over every offset."""
    rng = random.Random(10)
    pts = [(rng.uniform(0, 100), rng.choice([0.0, 3.0, 4.5, 7.0]), rng.uniform(0, 9)) for _ in range(60)]
    df = frame(spark, [(*p[:2], 5.0, p[2]) for p in pts], "x double, y double, z double, v double")
    sweep = declustering.Sweep.between(2.0, 50.0, 6, offsets=4, anisotropy=(1.5, 1.0))
    for r in declustering.curve(df, {a: a for a in "xyz"}, "v", sweep).where("size > 0").collect():
        means = []
        for k in range(4):
            cells = {}
            for x, y, v in pts:
                key = []
                for p, lo, hi, s in ((x, min(q[0] for q in pts), max(q[0] for q in pts), r["size"]), (y, 0.0, 7.0, 1.5 * r["size"]), (5.0, 5.0, 5.0, r["size"])):
                    key.append(math.floor((p - (lo - 0.01 - k * min(s / 4, 0.5 * (hi - lo)))) / s))
                cells.setdefault(tuple(key), []).append(v)
            means.append(sum(sum(c) / len(c) for c in cells.values()) / len(cells))
        assert r["mean"] == pytest.approx(sum(means) / 4)


def test_section_bounds_are_inclusive(spark):
    df = frame(spark, [(1.0, 2.0, 5.0), (1.0, 2.0, 5.5), (1.0, 2.0, 5.6), (None, 2.0, 5.0)], "x double, y double, z double")
    assert section.slab(df, "z", 5.0, 1.0, {a: a for a in "xyz"}).count() == 2


def collar(spark, *holes):
    return frame(spark, [(h, 0.0, 0.0, 0.0, 100.0) for h in holes], "bhid string, x double, y double, z double, eoh double")


def path(spark, stations, method="minimum-curvature"):
    holes = drillhole.first_collars(collar(spark, *{s[0] for s in stations}))
    sv = frame(spark, stations, "bhid string, depth double, az double, dip double")
    return drillhole.desurvey(drillhole.clean_surveys(sv, holes), holes, method)


def test_straight_hole_is_closed_form(spark):
    for method in ("minimum-curvature", "balanced-tangential", "tangential"):
        p = path(spark, [("A", 0.0, 30.0, 60.0)], method)
        r = drillhole.positions(frame(spark, [("A", 50.0)], "bhid string, depth double"), p).first()
        a, d = math.radians(30), math.radians(60)
        assert (r["px"], r["py"], r["pz"]) == pytest.approx((50 * math.sin(a) * math.cos(d), 50 * math.cos(a) * math.cos(d), -50 * math.sin(d)))


def test_horizontal_circle_is_met_inside_segments(spark):
    n, radius = 20, 100.0
    length = 2 * math.pi * radius / n
    p = path(spark, [("A", k * length, 360.0 * k / n, 0.0) for k in range(n + 1)])
    depths = [0.37 * length, 4.5 * length, 11.1 * length, 19.9 * length]
    for r in drillhole.positions(frame(spark, [("A", d) for d in depths], "bhid string, depth double"), p).collect():
        t = r["depth"] / radius
        assert (r["px"], r["py"]) == pytest.approx((radius * (1 - math.cos(t)), radius * math.sin(t)), abs=1e-8)


def test_hole_without_survey_hangs_and_last_station_wins(spark):
    holes = drillhole.first_collars(collar(spark, "A", "B"))
    sv = frame(spark, [("B", 0.0, 0.0, 10.0), ("B", 0.0, 0.0, 45.0), ("B", 5.0, 0.0, 45.0), ("X", 0.0, 0.0, 0.0)], "bhid string, depth double, az double, dip double")
    got = {(r["bhid"], r["depth"]): r["dip"] for r in drillhole.clean_surveys(sv, holes).collect()}
    assert got == {("A", 0.0): 90.0, ("B", 0.0): 45.0, ("B", 5.0): 45.0}
    assert drillhole.dip_convention(frame(spark, [(-60.0,), (-50.0,), (0.0,)], "dip double")) == "neg-down"


def intervals(spark, rows):
    return frame(spark, rows, "bhid string, `from` double, `to` double, v double, rock string")


def test_composites_by_hand(spark):
    iv = intervals(spark, [("A", 0.0, 1.0, 1.0, "x"), ("A", 1.0, 3.0, 4.0, "y"), ("A", 4.0, 5.0, 10.0, "y")])
    known = drillhole.first_collars(collar(spark, "A"))
    got = sorted(drillhole.composite(drillhole.clean_intervals(iv, known), 2.0, {"v": "mean"}, {"rock": "majority"}).collect(), key=lambda r: r["from"])
    assert [(r["from"], r["to"], r["support"], r["v"]) for r in got] == [(0.0, 2.0, 2.0, 2.5), (2.0, 4.0, 1.0, 4.0), (4.0, 5.0, 1.0, 10.0)]
    assert [(r["rock"], r["mixed"], r["mid"]) for r in got] == [("x", True, 1.0), ("y", False, 2.5), ("y", False, 4.5)]
    assert drillhole.composite(drillhole.clean_intervals(iv, known), 2.0, {"v": "mean"}, min_coverage=0.6).count() == 2
    split = drillhole.composite(drillhole.clean_intervals(iv, known), 10.0, {"v": "sum"}, split=("rock",))
    assert sorted((r["from"], r["to"], r["v"]) for r in split.collect()) == [(0.0, 1.0, 1.0), (1.0, 5.0, 18.0)]


def test_validation_finds_every_defect(spark):
    c = frame(spark, [("A", 0.0, 0.0, 0.0, 10.0), ("A", 1.0, 1.0, 1.0, 10.0), ("B", None, 0.0, 0.0, 10.0), ("C", 0.0, 0.0, 0.0, 10.0), ("D", 0.0, 0.0, 0.0, 10.0)], "bhid string, x double, y double, z double, eoh double")
    s = frame(spark, [("A", 0.0, 0.0, 60.0), ("A", 0.0, 0.0, 61.0), ("A", 5.0, 0.0, 95.0), ("Z", 0.0, 0.0, 60.0)], "bhid string, depth double, az double, dip double")
    i = intervals(spark, [("A", 0.0, 2.0, 1.0, "x"), ("A", 1.0, 3.0, 1.0, "x"), ("A", 9.0, 12.0, 1.0, "x"), ("A", 5.0, 5.0, 1.0, "x"), ("Z", 0.0, 1.0, 1.0, "x"), ("D", 0.0, 1.0, 1.0, "x")])
    got = {r["check_id"]: r["count"] for r in drillhole.validate(c, s, i).collect()}
    assert got == {"bad-collar": 1, "dup-collar": 1, "orphan-survey": 1, "orphan-interval": 1, "bad-interval": 1, "collar-no-intervals": 1, "bad-survey": 1, "dup-survey-depth": 1, "collar-no-survey": 1, "past-eoh": 1, "overlap": 1}


def test_merge_keeps_length_and_reports(spark):
    a = frame(spark, [("A", 0.0, 2.0, 1), ("A", 2.0, 4.0, 2), ("B", 0.0, 1.0, 9)], "bhid string, `from` double, `to` double, v int")
    b = frame(spark, [("A", 1.0, 3.0, 7), ("A", 5.0, 6.0, 8)], "bhid string, `from` double, `to` double, v int")
    seg, report = drillhole.merge(a, b)
    got = sorted((r["bhid"], r["from"], r["to"], r["v"], r["v_2"]) for r in seg.collect() if r["bhid"] == "A" and r["v"] is not None)
    assert got == [("A", 0.0, 1.0, 1, None), ("A", 1.0, 2.0, 1, 7), ("A", 2.0, 3.0, 2, 7), ("A", 3.0, 4.0, 2, None)]
    assert {r["check_id"]: r["count"] for r in report.collect()} == {"gap-a": 1, "gap-b": 2, "overlap-a": 0, "overlap-b": 0, "hole-only-a": 1, "hole-only-b": 0, "column-collision": 1}


def test_survey_deeper_than_the_hole_and_rows_without_a_hole(spark):
    c = frame(spark, [("A", 0.0, 0.0, 0.0, 10.0), (None, 0.0, 0.0, 0.0, 10.0)], "bhid string, x double, y double, z double, eoh double")
    s = frame(spark, [("A", 0.0, 0.0, 60.0), ("A", 11.0, 0.0, 61.0), (None, 0.0, 0.0, 1.0)], "bhid string, depth double, az double, dip double")
    i = intervals(spark, [("A", 0.0, 12.0, 1.0, "x"), (None, 0.0, 1.0, 1.0, "x")])
    got = {r["check_id"]: (r["count"], r["holes"], r["bhids"]) for r in drillhole.validate(c, s, i).collect()}
    assert got == {"bad-collar": (1, 0, []), "orphan-survey": (1, 0, []), "orphan-interval": (1, 0, []), "past-eoh": (2, 1, ["A"])}


def test_first_rows_win_by_order_of_reading(spark):
    c = frame(spark, [("A", 9.0, 9.0, 9.0, 7), ("A", 1.0, 1.0, 1.0, 8)], "bhid string, x double, y double, z double, at long")
    assert drillhole.first_collars(c, "at").first()["x"] == 9.0 and drillhole.first_collars(c.withColumn("at", -F.col("at")), "at").first()["x"] == 1.0
    s = frame(spark, [("A", 0.0, 50.0, 80.0, 1), ("A", 0.0, 10.0, 10.0, 2)], "bhid string, depth double, az double, dip double, at long")
    assert drillhole.clean_surveys(s, drillhole.first_collars(c, "at"), order="at").first()["dip"] == 10.0
    a = frame(spark, [("A", 0.0, 2.0, 5, 1), ("A", 0.0, 1.0, 6, 2)], "bhid string, `from` double, `to` double, v int, at long")
    seg, report = drillhole.merge(a, a.withColumnRenamed("v", "w").where("at = 1"), "at")
    assert {r["v"] for r in seg.collect()} == {5} and {r["check_id"]: r["count"] for r in report.collect()}["column-collision"] == 0


def test_suffixes_of_clashing_columns(spark):
    row = frame(spark, [("A", 0.0, 1.0, 1, 2)], "bhid string, `from` double, `to` double, v int, v_2 int")
    assert drillhole.merge(row, row)[0].columns == ["bhid", "from", "to", "v", "v_2", "v_22", "v_2_2"]


def test_emitted_datasets_carry_their_weight(spark):
    c, s = collar(spark, "A"), frame(spark, [("A", 0.0, 0.0, 90.0)], "bhid string, depth double, az double, dip double")
    i = intervals(spark, [("A", 0.0, 1.0, 1.0, "x"), ("A", 1.0, 2.0, 3.0, "x"), ("A", 2.0, 3.0, 5.0, "x")])
    comp = drillhole.emit("composite", c, s, i, length=None, numeric={"v": "mean"})
    assert comp.weight == "support" and sorted((r["z"], r["v"]) for r in comp.frame().collect()) == [(-2.5, 5.0), (-1.5, 3.0), (-0.5, 1.0)]
    iv = drillhole.emit("intervals", c, s, i)
    assert iv.weight == "length" and {"x", "y", "z", "from", "to", "length", "rock"} <= set(iv.frame().columns) and drillhole.emit("collar", c, s, i).frame().count() == 1
    rows, n = drillhole.prepared(i, {"w": "v * 2"}, "w > 2")
    assert rows.columns[-1] == "w" and rows.count() == 2 and n.first().asDict() == {"total": 3, "kept": 2}


def test_columns_of_interval_tables_are_typed(spark):
    df = frame(spark, [("A", "1.5", "x", None), ("A", "2", "3", ""), ("A", "3e1", "y", ""), ("B", "high", "4", "")], "bhid string, fe string, rock string, none string")
    assert dict(drillhole.typed_columns(df).dtypes) == {"bhid": "string", "fe": "double", "rock": "string", "none": "string"}


def test_summary_and_listings_of_many_categories(spark):
    df = spark.range(60_000).select((F.col("id") % 600).cast("string").alias("k"), (F.col("id") % 300).alias("a"), (F.col("id") % 2).alias("b"))
    r = categories.summary(df, ["k"]).first()
    assert (r["distinct"], r["nulls"], r["covering_80"]) == (600, 0, 480) and r["entropy"] == pytest.approx(math.log2(600)) and r["diversity_pct"] == 100
    p = categories.pareto(df, ["k"])
    assert p.count() == 500 and p.where("overflow").count() == 500
    listed = categories.crosstab(df, "a", "b")
    assert listed.agg(F.sum("n")).first()[0] == 40_000 and listed.where("overflow").count() == listed.count()
    cells = categories.crosstab_cells(df, "a", "b")
    assert categories.margins(cells).where("a is null and b is null").first()["total"] == 60_000 and categories.agreement(cells).first()["total"] == 60_000
    t = categories.crosstab_tallies(df, "a", "b").first()
    assert (t["total"], t["placed"], t["a_labels"], t["a_overflow"], t["b_overflow"]) == (60_000, 60_000, 300, True, False)


def test_category_orders(spark):
    df = frame(spark, [("b", 5), ("a", 5), ("c", 9), ("∅", 1)], "value string, n long")
    got = {m: [r["value"] for r in categories.in_order(df, m, ["b", "zz"]).collect()] for m in ("count-desc", "count-asc", "alpha", "missing-last", "custom")}
    assert got == {"count-desc": ["c", "a", "b", "∅"], "count-asc": ["∅", "a", "b", "c"], "alpha": ["a", "b", "c", "∅"], "missing-last": ["a", "b", "c", "∅"], "custom": ["b", "c", "a", "∅"]}
    many = spark.range(31).select(F.col("id").cast("string").alias("value"), F.col("id").alias("n"))
    assert categories.shown(many).count() == 20 and categories.shown(many.where("id > 0") if "id" in many.columns else many.where("n > 0")).count() == 30


def test_levels_passed_counts_like_a_loop(spark):
    from lodeframe.plans.levels import levels_passed

    for n in (0, 1, 5, 8, 9, 64, 99, 230):
        levels = sorted({round(k * 0.37 % 7, 6) for k in range(n)})
        rows = [(x / 10,) for x in range(-5, 80)] + [(v,) for v in levels[:5]] + [(None,)]
        got = frame(spark, rows, "v double").select("v", levels_passed(levels, lambda c: c <= F.col("v")).alias("k")).collect()
        assert all(r["k"] == (0 if r["v"] is None else sum(x <= r["v"] for x in levels)) for r in got)


def test_weights_that_sum_unevenly_lose_no_level(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"), F.lit(0.1).alias("w"))
    at = tuple(k / 20 for k in range(21))
    for f in (statistics.quantiles, statistics.step_percentiles):
        got = {r["q"]: r["value"] for r in f(df, "v", at, "w").collect()}
        assert sorted(got) == list(at) and [got[q] for q in at] == sorted(got.values())


def test_empty_bins_are_in_the_curve(spark):
    df = frame(spark, [(1.0, "a"), (3.0, "a"), (2.0, "b")], "g double, k string")
    cells = grade_tonnage.bins(df, {"g": (1.0, 3.0)}, "k", n_bins=4)
    got = sorted((r["group"], r["bin"], r["tonnage"], r["metal"]) for r in grade_tonnage.bin_curve(cells, 4).collect())
    assert got == [("a", 0, 2.0, 4.0), ("a", 1, 1.0, 3.0), ("a", 2, 1.0, 3.0), ("a", 3, 1.0, 3.0), ("b", 0, 1.0, 2.0), ("b", 1, 1.0, 2.0), ("b", 2, 1.0, 2.0), ("b", 3, 0.0, 0.0)]
    few = grade_tonnage.bin_curve(cells, 4, groups=1)
    assert {r["group"] for r in few.collect()} == {"a"} and few.where("overflow").count() == 4


def test_irregular_gaps_do_not_pass_for_blocks(spark):
    # Over 200 different gaps; the share of a gap is of all of them.
    v, rows = 0.0, []
    for k in range(1500):
        v += 10.0 if k % 3 == 0 else 0.001 * k
        rows.append((round(v, 3), 1.0, 1.0))
    g = geometry.axes_geometry(frame(spark, rows, "x double, y double, z double"), {"x": "x"}, sizes=None).first()
    assert g["size"] == 10.0 and g["sub_sizes"] == [] and g["regularity"] < 0.5
    d = geometry.axes_geometry(spark.range(300).select(F.col("id").cast("double").alias("x"), (F.col("id") % 70 + 1).cast("double").alias("d")), {"x": "x"}, sizes={"x": "d"}).first()
    assert d["size"] == 70.0 and d["sub_count"] == 69 and len(d["sub_sizes"]) == 50


def test_roles_of_tables():
    assert drillhole.table_role(["BHID", "FROM", "TO", "Fe"]) == "intervals"
    assert drillhole.table_role(["HOLEID", "AT", "AZIMUTH", "DIP"]) == "survey"
    assert drillhole.table_role(["BHID", "XCOLLAR", "YCOLLAR", "ZCOLLAR"]) == "collar"
    assert drillhole.table_role(["a"]) is None and drillhole.table_role(["a"], "assays_2020.csv") == "intervals"
    assert drillhole.map_columns(["Hole-ID", "MD", "Azim", "Plunge"], "survey") == {"bhid": "Hole-ID", "depth": "MD", "az": "Azim", "dip": "Plunge"}


def test_cutoff_ranges():
    assert grade_tonnage.cutoff_range(0.0, 0.3, 0.1) == [0.0, 0.1, 0.2, 0.3]
    assert grade_tonnage.cutoff_range(1.0, 1.0, 0.5) == [1.0]


def test_labels_go_by_letter_then_accent_then_case(spark):
    words = ["z", "É", "e", "f", "∅", "E", "é", "Ä", "a", "zeta", "Zebra", "a2", "a-1"]
    df = frame(spark, [(w, 1) for w in words], "value string, n long")
    got = [r["value"] for r in categories.in_order(df, "alpha").collect()]
    assert got[-1] == "∅" and [w for w in got if w in "zÉefEéÄa"] == ["a", "Ä", "e", "E", "é", "É", "f", "z"]
    assert got.index("Zebra") < got.index("zeta")
    placed = categories.with_place(df, "missing-last").collect()
    assert {r["value"]: r["place"] for r in placed} == {w: k + 1 for k, w in enumerate(got)}
    many = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("value"), (F.col("id") % 7).alias("n"))
    rows = categories.with_place(many, "count-asc").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(1, 5001)) and [(r["n"], r["value"]) for r in rows] == sorted((r["n"], r["value"]) for r in rows)


def brute_sweep(x, v, sizes, offsets, anisotropy=(1.0, 1.0)):
    """{size: (mean, weights)} by one dictionary of cells per size and origin."""
    low, extent, out = x.min(0), x.max(0) - x.min(0), {}
    for size in sizes:
        s, w = size * np.array([1.0, *anisotropy]), np.zeros(len(x))
        for k in range(offsets):
            cells = np.floor((x - (low - 0.01 - k * np.minimum(s / offsets, 0.5 * extent))) / s)
            _, of, n = np.unique(cells, axis=0, return_inverse=True, return_counts=True)
            w += 1 / n[of.reshape(-1)] / len(n)
        out[size] = ((w * v).sum() / w.sum(), w * len(x) / w.sum())
    return out


def test_declustering_of_scattered_points_in_ranges(spark, monkeypatch):
    """Continuous points in space, half of them in one small cluster and many at one place, in forty ranges: exact, and few cells cross borders."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random((3000, 3)) * [1000, 600, 80], rng.normal([200, 300, 40], [5, 5, 2], (2700, 3)), np.full((300, 3), [700.0, 100.0, 10.0])])
    v = rng.lognormal(0, 1, len(x)) + (x[:, 0] < 250)
    df = spark.createDataFrame([(i, *map(float, p), float(a)) for i, (p, a) in enumerate(zip(x, v))], "id long, x double, y double, z double, v double").repartition(5)
    axes, rows, keep = {a: a for a in "xyz"}, [], declustering.checkpoint
    monkeypatch.setattr(declustering, "checkpoint", lambda d: rows.append(keep(d)) or rows[-1])
    sweep = declustering.default_sweep(df, axes, "v", anisotropy=(1.0, 0.25))
    assert len(sweep.sizes) == 25 and sweep.offsets == 8
    want = brute_sweep(x, v, sweep.sizes, 8, (1.0, 0.25))
    got = {r["size"]: r["mean"] for r in declustering.curve(df, axes, "v", sweep, range_points=150).collect()}
    assert got.pop(0.0) == pytest.approx(v.mean())
    assert got == {s: pytest.approx(m) for s, (m, _) in want.items()}
    assert rows[0].rdd.getNumPartitions() == 40
    few = keep(declustering.curve(df, axes, "v", sweep, range_points=3000))
    assert few.count() == 26 and rows[-1].count() < 0.25 * 200 * len(x)
    for size in (sweep.sizes[0], sweep.sizes[12], sweep.sizes[-1]):
        found = {r["id"]: r["weight"] for r in declustering.weights(df, axes, "v", sweep, "id", size, range_points=150).collect()}
        assert found == {i: pytest.approx(w) for i, w in enumerate(want[size][1])}
    best = min(want, key=lambda s: want[s][0])
    found = {r["id"]: r["weight"] for r in declustering.weights(df.withColumnRenamed("id", "share"), axes, "v", sweep, "share", range_points=1000).withColumnRenamed("share", "id").collect()}
    assert found == {i: pytest.approx(w) for i, w in enumerate(want[best][1])}


def test_declustering_of_a_plane_keeps_cells_in_their_ranges(spark, monkeypatch):
    """Without a third axis, and with a second one much shorter, only cells on borders of ranges leave their task: a tenth of all, not each of them."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.random(8000) * 20000, rng.random(8000) * 1000, np.zeros(8000)])
    v = rng.lognormal(0, 1, len(x))
    df = spark.createDataFrame([(i, float(p[0]), float(p[1]), float(a)) for i, (p, a) in enumerate(zip(x, v))], "id long, x double, y double, v double").repartition(3)
    sweep, rows, keep = declustering.Sweep([100.0, 150.0], offsets=2), [], declustering.checkpoint
    monkeypatch.setattr(declustering, "checkpoint", lambda d: rows.append(keep(d)) or rows[-1])
    got = {r["size"]: r["mean"] for r in declustering.curve(df, {"x": "x", "y": "y"}, "v", sweep, range_points=2000).collect()}
    want = brute_sweep(x, v, sweep.sizes, 2, (1.0, 1.0))
    assert got.pop(0.0) == pytest.approx(v.mean())
    assert got == {s: pytest.approx(m) for s, (m, _) in want.items()}
    cells = sum(len({tuple(c) for c in np.floor((x[:, :2] - (x[:, :2].min(0) - 0.01 - k * np.minimum(s / 2, 0.5 * np.ptp(x[:, :2], 0)))) / s)}) for s in sweep.sizes for k in range(2))
    left = [d.where("cx is not null").count() for d in rows if "cx" in d.columns]
    assert 0 < left[-1] < 0.1 * cells
    found = {r["id"]: r["weight"] for r in declustering.weights(df, {"x": "x", "y": "y"}, "v", sweep, "id", 100.0, range_points=2000).collect()}
    assert found == {i: pytest.approx(w) for i, w in enumerate(want[100.0][1])}
