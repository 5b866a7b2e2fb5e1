"""Links, components and counts of embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import descent

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    """(links, component) of each row, by comparing all with all."""
    unit = []
    for _, v, label in rows:
        good = v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(c for c in v)
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if good else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(n):
        low.setdefault(find(i), []).append(rows[i][0])
    return sorted(((r[0], links[i], min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr), {r["recall"] for r in rows}


def clusters(rng, dims, sizes, spread):
    """Unit vectors around random centres; a spread of 0.02 makes cosines about 0.98."""
    out = []
    for size in sizes:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        out += [centre + rng.normal(size=dims) * spread for _ in range(size)]
    return out


def test_groups_of_all_sizes_equal_brute_force(spark):
    """Pairs, groups above the length of lists, one group far above, loose chains at the threshold, and a label with half of all rows."""
    rng = np.random.default_rng(8)
    x = clusters(rng, 24, [1] * 250 + [2] * 60 + [5] * 10 + [45, 140], 0.03) + clusters(rng, 24, [30, 30], 0.055)
    rows = [(int(i) * 3, v.tolist(), 0 if k % 2 else int(rng.integers(0, 4))) for k, (i, v) in enumerate(zip(rng.permutation(len(x)), x))]
    got, recall = found(descent.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), block=50))
    assert got == brute(rows) and recall == {1.0}


def test_pairs_just_above_the_threshold_are_found_among_many_others(spark):
    rng = np.random.default_rng(9)
    one = rng.normal(size=(1500, 48))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = rng.normal(size=(300, 48))
    side -= (side * one[:300]).sum(1, keepdims=True) * one[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.91, 0.95, (300, 1))
    two = one[:300] * cosine + side * np.sqrt(1 - cosine**2)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([one, two]))], SCHEMA)
    rows, recall = found(descent.near_duplicates(df, probes=2000))
    linked = {i for i, n, _ in rows if n}
    want = {i for k in np.flatnonzero(cosine[:, 0] >= 0.93) for i in (k, 1500 + k)}
    assert linked <= want and len(linked) >= 0.99 * len(want)
    assert recall.pop() == pytest.approx(len(linked) / len(want), abs=1e-9)


def test_a_poor_start_is_refined_and_audited(spark):
    """From random lists alone, neighbours of neighbours lead to the groups; without any step, the audit tells that links are missing."""
    rng = np.random.default_rng(10)
    x = np.concatenate([c + rng.normal(size=(25, 3)) @ rng.normal(size=(3, 16)) * 0.03 for c in rng.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    _, poor = found(descent.near_duplicates(df, tables=1, steps=0, rounds=1))
    rows, good = found(descent.near_duplicates(df, tables=1, rounds=2, wanted=1.0))
    assert max(poor) < 0.7 and min(good) > 0.99
    assert sum(n for _, n, _ in rows) >= 0.99 * 60 * 25 * 24


def test_odd_vectors(spark):
    rng = np.random.default_rng(11)
    same, other = rng.normal(size=4).tolist(), rng.normal(size=4).tolist()
    rows = [(50 + i, same, 1) for i in range(60)] + [(7, [2e200 * c for c in same], 1), (8, [1e-300 * c for c in same], 1), (None, same, 1), (None, same, 1), (9, same, 2), (9, other, 2), (9, other, 2)]
    rows += [(200, None, 1), (201, [0.0] * 4, 1), (202, [0.0] * 4, 1), (203, [1.0, None, 2.0, 3.0], 1), (204, [float("nan")] * 4, 1), (205, [float("inf"), 0.0, 0.0, 0.0], 1), (206, [], 1), (None, None, 1)]
    rows += [(300, same, None), (301, same, None), (400, same[:3], 1), (401, same[:3], 1), (500, [0.0, -0.0, 0.0, 1.0], 3), (501, [0.0, 0.0, 0.0, 1.0], 3), (None, other, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("recall", "point", "copies", "kept", "first", "v", "g"):
        df = df.withColumn(name, F.lit("clash"))
    got = descent.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert descent.near_duplicates(df.limit(0)).count() == 0
    none, _ = found(descent.near_duplicates(df.where("vec_id = 200 or vec_id = 300")))
    assert none == [(200, 0, 200), (300, 0, 300)]
    floats = df.where("vec_id >= 400").withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("label", F.concat(F.lit("l"), "label"))
    assert found(descent.near_duplicates(floats))[0] == [(400, 1, 400), (401, 1, 400), (500, 1, 500), (501, 1, 500)]
