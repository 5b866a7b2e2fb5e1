"""A deposit with planted findings from reading to declustered comparison: a biased, partly crowded sample of a regular model."""

import math
import random

import pytest

from lodeframe.operators import declustering, geometry, grade_tonnage, statistics
from lodeframe.plans.dataset import Dataset
from lodeframe.sources import text

BIAS = 2.0


def grade(x, y):
    """A rich corner and a poor one."""
    return 50 + 12 * math.exp(-((x - 60) ** 2 + (y - 60) ** 2) / 6000) - 6 * math.exp(-((x - 200) ** 2 + (y - 180) ** 2) / 8000)


@pytest.fixture(scope="module")
def deposit(spark):
    rng = random.Random(5)
    model = [f"{10 * i + 5},{10 * j + 5},{10 * k + 5},{grade(10 * i + 5, 10 * j + 5) + rng.gauss(0, 1):.4f}" for i in range(24) for j in range(24) for k in range(10)]
    spots = [(rng.uniform(0, 240), rng.uniform(0, 240)) for _ in range(420)] + [(rng.gauss(60, 12), rng.gauss(60, 12)) for _ in range(280)]
    samples = [f"{x:.3f};{y:.3f};{rng.uniform(0, 100):.3f};{grade(x, y) + BIAS + rng.gauss(0, 2):.4f}" for x, y in spots]
    lines = lambda head, rows: spark.createDataFrame([(r,) for r in (head, *rows)], "value string")
    return text.from_lines(lines("X,Y,Z,Fe", model)), text.from_lines(lines("EAST;NORTH;ELEV;Fe", samples))


def test_reading_finds_types_delimiters_and_roles(deposit):
    model, samples = deposit
    assert (model.delimiter, samples.delimiter) == (",", ";") and set(model.types.values()) == {"numeric"}
    assert model.roles == {"x": "X", "y": "Y", "z": "Z"} and samples.roles == {"x": "EAST", "y": "NORTH", "z": "ELEV"}


def test_model_is_a_full_grid_of_ten_metre_blocks(deposit):
    model, _ = deposit
    found = geometry.axes_geometry(model.data(), model.roles)
    got = {r["axis"]: (r["size"], r["count"]) for r in found.collect()}
    assert got == {"x": (10.0, 24), "y": (10.0, 24), "z": (10.0, 10)} and geometry.is_regular(found)
    assert model.data().count() == 24 * 24 * 10


def test_declustering_pulls_the_difference_back_to_the_bias(deposit):
    model, samples = deposit
    axes, df = samples.roles, text.with_row_id(samples.data(), ["EAST", "NORTH", "ELEV"])
    weights = declustering.weights(df, {a: axes[a] for a in "xy"}, "Fe", declustering.Sweep.between(5.0, 120.0, 12), "row_id")
    truth = statistics.moments(model.data(), ["Fe"])
    mean = lambda d, w=None: statistics.moments(d, ["Fe"], w).first()["mean"]
    naive, fair = mean(df) - mean(model.data()), mean(df.join(weights, "row_id"), "weight") - mean(model.data())
    assert naive > fair > 0 and abs(fair - BIAS) < abs(naive - BIAS)
    delta = statistics.relative_differences(statistics.moments(df, ["Fe"]), truth).where("metric = 'mean'").first()
    assert delta["delta_pct"] == pytest.approx(100 * naive / mean(model.data()))


def test_tonnage_at_the_lowest_cutoff_is_all_of_it(deposit):
    model, _ = deposit
    df = Dataset(model.data(), {"rock": "case when Fe > 55 then 'rich' else 'poor' end"}).frame()
    cells = grade_tonnage.bins(df, {"Fe": grade_tonnage.grade_range(df, "Fe")}, "rock", block_volume=1000.0, density=3.0)
    rows = grade_tonnage.at_cutoffs(cells, [0.0]).collect()
    assert sum(r["tonnage"] for r in rows) == pytest.approx(5760 * 3000) and all(r["pct"] == pytest.approx(100) for r in rows)
