"""Text, zip and binary sources, sinks, datasets, lineage and streams on small fixtures."""

import struct
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeframe.plans.dataset import Dataset
from lodeframe.plans.lineage import Registry
from lodeframe.plans.prefix import running_totals
from lodeframe.sources import files, paged, sinks, text, zipped
from lodeframe.streaming import running

LINES = "# made by hand\r\nHOLE,\"FE\",ROCK,E\r\nA,1.5,HEM,\r\n\r\nB,-999,'ITA',\r\nC,high,NA,\r\nD,-999.0,,x,extra\r\nE,1e400,CGA"


def test_text_rules(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(LINES.encode())
    t = text.read_text(spark, str(tmp_path / "t.csv"), types={"FE": "numeric"})
    assert t.header == ["HOLE", "FE", "ROCK", "E"] and t.delimiter == ","
    got = {r["HOLE"]: (r["FE"], r["ROCK"]) for r in t.data().collect()}
    assert got == {"A": (1.5, "HEM"), "B": (None, "ITA"), "C": (None, "NA"), "D": (-999.0, None), "E": (None, "CGA")}
    assert t.counters().first().asDict() == {"rows": 5, "ragged_rows": 2, "parse_fails": 2, "comment_count": 1}


def test_a_column_that_fills_up_late_is_typed_by_all_rows(spark):
    lines = ["A,B,C"] + [f"{k},,1" for k in range(150)] + [f"{k},rock{k},2" for k in range(50)]
    t = text.from_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    assert t.types == {"A": "numeric", "B": "categorical", "C": "numeric"}
    assert t.data().where("B is not null").count() == 50 and t.counters().first()["parse_fails"] == 0


def test_lines_like_the_header_are_rows(spark, tmp_path):
    bare = spark.createDataFrame([("a,b",)] * 3, "value string")
    assert text.from_lines(bare, header=["A", "B"]).data().count() == 3
    assert text.from_lines(bare).data().count() == 2
    for name in ("1.csv", "2.csv"):
        (tmp_path / name).write_text("# c\nA,B\n1,2\nA,B\n3,4\n")
    t = text.read_text(spark, str(tmp_path))
    assert t.counters().first().asDict() == {"rows": 6, "ragged_rows": 0, "parse_fails": 0, "comment_count": 2}


def test_sniffing():
    assert text.sniff_delimiter(["a;b;c", "1;2,5;3"]) == ";"
    assert text.sniff_delimiter(["a\tb", "1\t2"]) == "\t"
    assert text.sniff_delimiter(["a b c"]) == " "
    assert text.column_type(["1", "2", "x", "NA"]) == "categorical"
    assert text.column_type(["1"] * 9 + ["x"]) == "numeric"
    assert text.column_type(["", "NA"]) == "numeric"


def test_zip_members(spark, tmp_path):
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        path = tmp_path / f"t{kind}.zip"
        with zipfile.ZipFile(path, "w", kind) as z:
            z.writestr("__MACOSX/a.csv", "x")
            z.writestr("readme.md", "x")
            z.writestr("first.csv", "A,B\n1,2\n3,4")
            z.writestr("second.csv", "A,B\n5,6")
        assert {r["member"] for r in zipped.members(spark, str(path)).collect()} == {"first.csv", "second.csv"}
        assert sorted(tuple(r) for r in zipped.read_zip(spark, str(path)).data().collect()) == [(1.0, 2.0), (3.0, 4.0)]
        assert zipped.read_zip(spark, str(path), "second.csv").data().count() == 1


def paged_file(size, order, rows, cut=0):
    number, words = {4: "f", 8: "d"}[size], paged.PAGE_WORDS

    def num(x):
        return struct.pack(order + number, x)

    def txt(s):
        return s.ljust(4).encode() + b" " * (size - 4)

    fields = [("X", "N", 1, 1, 0.0), ("ROCK", "A", 2, 1, ""), ("ROCK", "A", 3, 2, ""), ("CONST", "N", 0, 1, 2.5)]
    per = paged.RECORD_WORDS // 3
    pages = -(-len(rows) // per)
    head = [num(0)] * words
    head[24], head[25], head[26] = num(len(fields)), num(pages + 1), num(len(rows) - (pages - 1) * per)
    for k, (name, kind, word, part, default) in enumerate(fields):
        at = paged.HEADER_WORDS + k * paged.FIELD_WORDS
        head[at], head[at + 1], head[at + 2], head[at + 3], head[at + 4] = txt(name[:4]), txt(name[4:]), txt(kind), num(word), num(part)
        head[at + 6] = num(default) if kind == "N" else txt(default)
    out = b"".join(head)
    for p in range(pages):
        page = b"".join(num(x) + txt(r[:4]) + txt(r[4:]) for x, r in rows[p * per : (p + 1) * per])
        out += page.ljust(words * size, b"\0")
    return out[: len(out) - cut]


@pytest.mark.parametrize("size", [4, 8])
@pytest.mark.parametrize("order", ["<", ">"])
def test_paged_binary(spark, tmp_path, size, order):
    rows = [(float(k), "HEMATITE" if k % 2 else "ITA") for k in range(400)] + [(1e30, "CGA")]
    (tmp_path / "m.dm").write_bytes(paged_file(size, order, rows))
    got = sorted((tuple(r) for r in paged.read_paged(spark, str(tmp_path / "m.dm")).collect()), key=lambda r: (r[0] is None, r[0]))
    assert len(got) == 401 and got[1] == (1.0, "HEMATITE", 2.5) and got[-1] == (None, "CGA", 2.5)
    (tmp_path / "n.dm").write_bytes(paged_file(size, order, rows[:5]))
    for limit in (0, 2 * 512 * size, 10**9):  # a task a page or two, or a file
        both = paged.read_paged(spark, str(tmp_path), partition_bytes=limit).collect()
        assert len(both) == 406 and sorted({tuple(r) for r in both}, key=lambda r: (r[0] is None, r[0])) == got


def test_truncated_page_gives_what_it_holds(spark, tmp_path):
    rows = [(float(k), "HEM") for k in range(300)]
    (tmp_path / "m.dm").write_bytes(paged_file(4, "<", rows, cut=1500))
    n = paged.read_paged(spark, str(tmp_path / "m.dm")).count()
    assert 169 < n <= 300


@pytest.mark.parametrize("cut", [0, 5, 1500, 2048, 5000])
def test_many_ranges_give_the_rows_of_one_also_of_truncated_files(spark, tmp_path, cut):
    rows = [(float(k), "HEM" if k % 3 else "ITABIRIT") for k in range(20_000)]
    (tmp_path / "m.dm").write_bytes(paged_file(4, "<", rows, cut=cut))
    one, many = (paged.read_paged(spark, str(tmp_path / "m.dm"), partition_bytes=b) for b in (10**9, 4096))
    assert many.rdd.getNumPartitions() > 50 and one.rdd.getNumPartitions() == 1
    got = sorted(map(tuple, many.collect()))
    assert got == sorted(map(tuple, one.collect())) and got == [(x, r, 2.5) for x, r in rows[: len(got)]]
    assert len(got) == 20_000 if cut == 0 else 20_000 - 169 * (cut // 2048 + 2) <= len(got) <= 20_000


def test_only_the_columns_asked_for_are_decoded(spark, tmp_path):
    (tmp_path / "m.dm").write_bytes(paged_file(8, ">", [(1.0, "a"), (2.0, "b")]))
    df = paged.read_paged(spark, str(tmp_path / "m.dm"), columns=["CONST", "X"])
    assert df.columns == ["CONST", "X"] and sorted(map(tuple, df.collect())) == [(2.5, 1.0), (2.5, 2.0)]
    header = paged.read_header((tmp_path / "m.dm").read_bytes())
    assert set(paged.decode_pages(b"", header, 1, 0, ["ROCK"])) == {"ROCK"}
    with pytest.raises(Exception, match="not a paged"):
        (tmp_path / "bad.dm").write_bytes(b"x" * 5000)
        paged.read_paged(spark, str(tmp_path / "bad.dm")).count()


def test_archives_of_many_members_and_split_stored_ones(spark, tmp_path):
    lines = {f"t{k}.csv": [f"{k},{j}" + "x" * (j % 7) for j in range(300 * k)] for k in range(5)}
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(tmp_path / f"{kind}.zip", "w", kind) as z:
            for name, rows in lines.items():
                z.writestr(name, "\n".join(rows) + ("\n" if name > "t2" else ""))
    for split in (64, 1000, 10**9):
        got = {}
        df = zipped.all_lines(spark, str(tmp_path), split)
        for r in df.collect():
            got.setdefault((r["archive"].rsplit("/", 1)[-1], r["member"]), []).append(r["value"])
        assert {k: sorted(v) for k, v in got.items()} == {(f"{kind}.zip", name): sorted(rows) for kind in (0, 8) for name, rows in lines.items() if rows}
    assert df.rdd.getNumPartitions() == 10


def test_several_archives_each_with_a_header(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("t.csv", f"A,B\n{k},2\n")
    assert sorted(tuple(r) for r in zipped.read_zip(spark, str(tmp_path)).data().collect()) == [(0.0, 2.0), (1.0, 2.0), (2.0, 2.0)]
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.md", "x")
    assert zipped.member_lines(spark, str(tmp_path / "none.zip")).count() == 0


def test_written_paged_tables_read_back(spark, tmp_path):
    rows = [(k, k / 8, f"text {k} ä"[: k % 14] or None) for k in range(5000)] + [(None, float("nan"), "a text that is longer than sixteen")]
    df = spark.createDataFrame(rows, "n int, v double, t string").repartition(5)
    for word in (4, 8):
        path = str(tmp_path / f"w{word}")
        paged.write_paged(df, path, word)
        assert len(list((tmp_path / f"w{word}").iterdir())) == 5
        back = sorted(map(tuple, paged.read_paged(spark, path, partition_bytes=8192).collect()), key=repr)
        want = sorted(((None if n is None else float(n), None if v != v else v, (t or "")[:16].strip() or None) for n, v, t in rows), key=repr)
        assert back == want
    paged.write_paged(df.limit(3), path, overwrite=True)
    paged.write_paged(df.where("n < 0"), path)
    assert paged.read_paged(spark, path).count() == 3
    with pytest.raises(Exception, match="do not fit"):
        paged.write_paged(spark.range(1).select(*[F.lit("x").alias(f"c{k}") for k in range(30)]), str(tmp_path / "wide"))


def test_a_failed_write_leaves_nothing_to_be_read(spark, tmp_path):
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("double").alias("v"))
    with pytest.raises(Exception):
        paged.write_paged(df, str(tmp_path / "t"))
    assert files.listed(str(tmp_path / "t")) == []


def test_written_archives_read_back(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").cast("double").alias("A"), F.concat(F.lit("k"), F.col("id") % 7).alias("B")).repartition(4)
    zipped.write_zip(df, str(tmp_path / "z"), {"A": "a", "B": "b"}, sinks.TextFormat(comments=("made here",)))
    t = zipped.read_zip(spark, str(tmp_path / "z"))
    assert t.header == ["a", "b"] and sorted(map(tuple, t.data().collect())) == sorted(map(tuple, df.collect()))
    assert zipped.members(spark, str(tmp_path / "z")).count() == 4 and t.comments.count() == 4


def test_an_archive_above_two_gigabytes_takes_little_memory(spark, tmp_path):
    """A sparse file with the archive behind 2.2 GB, and a member of 200 MB that is inflated as it is read."""
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(2_200_000_000)
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z, z.open("t.csv", "w") as raw:
        raw.write(b"A,B\n")
        for _ in range(200):
            raw.write(b"1,2345678\n" * 100_000)
    reader = zipped.ZipReader({"path": str(path)})
    tracemalloc.start()
    n = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000_001 and peak < 30_000_000
    assert zipped.members(spark, str(path)).first()["size"] == 200_000_004


def test_text_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.0, 2), ('say "x"', 2.346, None), (None, float("nan"), 3)], "s string, d double, i int")
    fmt = sinks.TextFormat(precision=2, comments=("hand-made",))
    assert [r[0] for r in sinks.text_lines(df, fmt=fmt).collect()] == ['"a,b",1.00,2', '"say ""x""",2.35,', ",,3"]
    sinks.write_text(df, str(tmp_path / "out"), {"s": "S", "i": "I"}, fmt, single=True)
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert [r[0] for r in lines][:2] == ["# hand-made", "S,I"]
    back = text.read_quoted(spark, str(tmp_path / "out"))
    assert {r["S"] for r in back.collect()} == {"a,b", 'say "x"', None}


def test_bounding_box(spark):
    obj = sinks.bounding_box_obj(spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 20.0, 30.0)], "x double, y double, z double"), {a: a for a in "xyz"}, {"x": 2.0})
    assert obj.count("v ") == 8 and obj.count("f ") == 6 and "v -1 0 0" in obj and "v 11 20 30" in obj


def test_dataset_filters_and_problems(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, "c")], "v double, k string")
    d = Dataset(df, {"w": "v * 2", "x": "w + 1"}, "x > 3", "v")
    assert d.frame().count() == 1 and d.frame("k = 'a'").count() == 0
    assert d.filter_count().first().asDict() == {"total": 3, "kept": 1}
    assert Dataset.from_recipe(df, d.recipe()).frame().count() == 1
    assert Dataset(df, where="v").frame().count() == 2
    told = Dataset(df, {"w": "vv * 2"}).problems()
    assert len(told) == 1 and told[0].startswith("w:")
    assert d.problems() == []
    est = Dataset(df, where="v > 2 and k <> 'a'").marginal_estimate(["v"], ["k"], 500).first()
    assert est["draws"] == 500 and 0 < est["kept_pct"] < 100


def test_lineage_marks_only_what_changed():
    made = []
    r = Registry()
    r.source("holes", 1)
    r.source("model", 1)
    r.add("composites", ("holes",), lambda: made.append("c"))
    r.add("analysis", ("composites", "model"), lambda: made.append("a"))
    r.refresh("analysis")
    assert made == ["c", "a"] and r.stale() == []
    r.source("model", 2)
    assert r.stale() == ["analysis"]
    r.refresh("analysis")
    assert made == ["c", "a", "a"]


def test_running_totals_are_exact_for_any_cuts(spark):
    rows = [(k % 3, float(v), 1.0) for k in range(3) for v in range(200)]
    cells = spark.createDataFrame(rows, "k long, v double, c double")
    for buckets in (2, 7, 64):
        got = running_totals(cells, ["k"], "v", "c", buckets).orderBy("k", "v").collect()
        for i, r in enumerate(got):
            assert r["cum"] == i % 200 + 1 and r["total"] == 200
            assert r["prev_value"] == (None if i % 200 == 0 else r["v"] - 1)


def test_row_ids_are_dense(spark):
    df = spark.createDataFrame([((k * 37) % 101,) for k in range(101)], "v long")
    got = text.with_row_id(df, ["v"]).collect()
    assert sorted((r["row_id"], r["v"]) for r in got) == [(k, k) for k in range(101)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_ids_hold_for_all_columns_and_reruns(spark, adaptive):
    df = spark.range(40_000).select((F.col("id") * 7919 % 997).alias("v"), (F.col("id") % 5).alias("w"), F.col("id").cast("string").alias("s"), F.lit(1).alias("at"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        a, b = (text.with_row_id(df.repartition(n), ["v", "w"]) for n in (3, 17))
        r = a.agg(F.count_distinct("row_id").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("s").alias("s"), F.sum("at").alias("at")).first()
        assert tuple(r) == (40_000, 0, 39_999, 40_000, 40_000)
        assert a.join(b, "s").where(a.row_id != b.row_id).count() == 0
        assert a.alias("x").join(a.alias("y"), F.expr("x.row_id + 1 = y.row_id")).where("(x.v, x.w) > (y.v, y.w)").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert text.with_row_id(df.limit(0), ["v"]).count() == 0


def test_health_tells_what_reading_lost(spark):
    lines = spark.createDataFrame([("# c",), ("X,FE,NONE",), ("1,2,",), ("NA,high,",), ("3,4,,5",)], "value string").coalesce(1)
    t = text.from_lines(lines, types={"X": "numeric", "FE": "numeric", "NONE": "categorical"})
    got = {r["check_name"]: r["n"] for r in Dataset(t.data(), where="X > 0 or FE is null", weight="FE").health(t, {"x": "X"}).collect()}
    assert got == {"rows": 3, "kept": 3, "weight_excluded": 1, "empty_columns": 1, "coordinates_ignored": 1, "parse_fails": 1, "ragged_rows": 1, "comment_count": 1}


def test_exports_of_datasets_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "v double, k string")
    Dataset(df, {"w": "v * 2"}, "v > 1").export(str(tmp_path / "one"), {"k": "K", "w": "W"})
    assert [tuple(r) for r in text.read_quoted(spark, str(tmp_path / "one")).collect()] == [("b", "4")]
    sinks.write_tables({"collar": df, "survey": df.limit(1)}, str(tmp_path / "all"))
    assert text.read_quoted(spark, str(tmp_path / "all" / "survey")).count() == 1


def test_recipes_hold_text_only(spark):
    with pytest.raises(TypeError):
        Dataset(spark.range(1), {"w": F.col("id") * 2}).recipe()
    types = Dataset(spark.range(1), {"b": "id > 0", "s": "cast(id as string)"}).column_types({"id": "categorical"})
    assert types == {"id": "categorical", "b": "numeric", "s": "categorical"}


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    df = spark.range(100).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).cast("string").alias("g"))
    df.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = running.upsert(running.running_moments(stream, "v", "g"), str(out), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.select("group", "count", "sum", "min", "max").collect()))
    assert key(spark.read.parquet(str(out))) == key(running.running_moments(df, "v", "g"))


def test_decimals(spark):
    lines = spark.createDataFrame([("A,B,C",), ("1.25,7,x",), ("3.5,8.125,y",)], "value string")
    t = text.from_lines(lines, types={"A": "numeric", "B": "numeric", "C": "categorical"})
    assert {r["column"]: r["decimals"] for r in text.decimals(lines, t).collect()} == {"A": 2, "B": 3}


def test_marginals_of_ten_thousand_categories(spark):
    """Every category and number can be drawn, by its own share; missing values are not drawn; calculated columns follow what was drawn."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 < 2, (F.col("id") % 10_000)).cast("string").alias("k"), (F.col("id") % 1000).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("flag"))
    tail = Dataset(rows, where="cast(k as int) >= 5000")  # none of them among the commonest two hundred
    draws = 20_000
    near = lambda got, p: abs(got - 100 * p) < 300 * (p * (1 - p) / draws) ** 0.5
    est = tail.marginal_estimate([], ["k"], draws).first()
    assert est["draws"] == draws and near(est["kept_pct"], 0.5)
    both = Dataset(rows, {"w": "v * 2"}, "w < 500 and cast(k as int) % 4 = 0 and flag").marginal_estimate(["v"], ["k", "flag"], draws).first()
    assert near(both["kept_pct"], 0.25 * 0.25 * 0.5)
    assert both == Dataset(rows.repartition(7), {"w": "v * 2"}, "w < 500 and cast(k as int) % 4 = 0 and flag").marginal_estimate(["v"], ["k", "flag"], draws).first()
    none = Dataset(rows.where("v < 0"), where="v is null").marginal_estimate(["v"], ["k"], 10).first()
    assert none["draws"] == 10 and none["kept_pct"] == 100


def test_ranges_of_a_large_paged_table_grow_instead_of_their_number(spark, tmp_path, monkeypatch):
    """Two thousand pages asked for one by one are read in some tens of ranges where that is the most, each row once."""
    path = str(tmp_path / "t")
    paged.write_paged(spark.range(400_000).select(F.col("id").alias("N"), (F.col("id") / 4).alias("V")).repartition(2), path)
    monkeypatch.setattr(paged, "MOST_RANGES", 30, raising=False)
    reader = paged.PagedReader(path, 4096, ["N", "V"])
    ranges = reader.partitions()
    assert sum(length for _, length in files.listed(path)) > 1000 * 4096 and 20 <= len(ranges) <= 32
    seen = [n for r in ranges for batch in reader.read(r) for n in batch.column(0).to_pylist()]
    assert sorted(seen) == list(range(400_000))
    monkeypatch.setattr(paged, "PARTITION_BYTES", 8192)
    assert len(reader.partitions()) > 500
