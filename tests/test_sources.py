import struct

from pyspark.sql import functions as F

from seamline.operators import learning as L
from seamline.sources import binary, sinks, text
from seamline.streaming import incremental

LAS = "~V\nVERS. 2.0 : x\n~W\nNULL. -999.25 : none\n~C\n# note\nDEPT.M : depth\nGR .API : gamma\n NPHI.V/V : porosity\n~A DEPT GR NPHI\n100.0 50.5 0.1\n100.1 -999.25 0.2\n\n100.2 52.5 0.3\n"


def test_las(spark, tmp_path):
    (tmp_path / "w1.las").write_text(LAS.replace("\n", "\r\n"))
    long = text.read_las(spark, str(tmp_path))
    rows = sorted((r.curve, r.depth, r.value) for r in long.select("curve", "depth", F.coalesce("value", F.lit(-1.0)).alias("value")).collect())
    assert rows == [("GR", 100.0, 50.5), ("GR", 100.1, -1.0), ("GR", 100.2, 52.5), ("NPHI", 100.0, 0.1), ("NPHI", 100.1, 0.2), ("NPHI", 100.2, 0.3)]
    curves = text.curves_of(long, ["file", "curve"])
    back = text.depths_of(curves, ["file", "curve"]).filter("curve = 'NPHI'").orderBy("i").collect()
    assert [round(r.depth, 6) for r in back] == [100.0, 100.1, 100.2] and [r.value for r in back] == [0.1, 0.2, 0.3]


def test_profile_grid_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("X;ALn\n1;5\n1;7\n2;3\n2;3\n3;1\n3;2\n")
    assert sorted((r.place, r.signal) for r in text.read_profile(spark, str(tmp_path / "p.csv")).collect()) == [(1.0, [5.0, 7.0]), (3.0, [1.0, 2.0])]
    (tmp_path / "g.dat").write_text("1 2 3\n 4 5 1.8e38\n6 7 nan\nx y z\n")
    assert text.read_grid(spark, str(tmp_path / "g.dat")).collect() == [(1.0, 2.0, 3.0)]
    (tmp_path / "w.csv").write_text("Name;East;North\nA;1,5;2\nB;x;3\n")
    got = text.read_points(spark, str(tmp_path / "w.csv"), {"Name": "name", "East": "x", "North": "y"}, ["x", "y"])
    assert sorted(map(tuple, got.collect())) == [("A", 1.5, 2.0), ("B", None, 3.0)]


def test_binary(spark, tmp_path):
    record = lambda k: struct.pack("<7h", *range(7)) + bytes((i * k) % 256 for i in range(512))
    (tmp_path / "a.geo").write_bytes(b"h" * 15 + record(1) + record(3) + b"cut")
    assert binary.count_records(spark, str(tmp_path / "a.geo")).first().records == 2
    rows = binary.read_traces(spark, str(tmp_path / "a.geo")).orderBy("trace").collect()
    assert [r.trace for r in rows] == [0, 1] and rows[0].signal[127:130] == [127.0, -128.0, -127.0] and len(rows[1].signal) == 512


def test_sinks(spark, tmp_path):
    traces = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "id int, a array<double>")
    sinks.write_samples(traces, str(tmp_path / "s"), ["id"], "a", 1)
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "s"))
    assert sorted((int(r.sample), r.amplitude) for r in back.collect()) == [(0, "1.0"), (0, "4.0"), (1, "2.0"), (1, "5.0")]
    line = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.5), (2, 0, 0.0, 0.0)], "k int, i int, x double, y double")
    assert [r.text for r in sinks.mif_lines(line, ["k"], "i", "x", "y").collect()] == ["Pline 2\n0.000 1.000\n2.000 3.500"]


def test_json_series(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ("[1, null]",), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(text.series_from_json(F.col("t"))).collect()] == [[1.0, 2.5], None, None, None]


def test_stream_sync_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "h string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("h string, v int").parquet(str(tmp_path / "in"))
        incremental.sync_to(stream, str(tmp_path / "out"), "h", str(tmp_path / f"check{k}")).awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_cleaning(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (float("nan"), 6.1, 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    assert [r.a for r in L.impute_median(df, ["a"]).orderBy("b").collect()] == [1.0, 2.0, 2.0, 4.0]
    assert L.uncorrelated(L.impute_median(df, ["a"]), ["a", "b", "c"], 0.9) == ["a"]
    assert L.finite_report(df, ["a", "b", "c"]).first().bad_rows == 1
