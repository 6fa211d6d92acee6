"""Text formats: semicolon profiles, grids, well logs, interval tables, point tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_number


def read_profile(spark: SparkSession, path: str, place: str = "X", sample: str = "ALn") -> DataFrame:
    """A semicolon table of samples as traces in order of place: place, signal. Traces of one distinct value are dropped; samples keep the file's order."""
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    rows = rows.select(F.col(place).cast("double").alias("place"), F.col(sample).cast("double").alias("v"), F.monotonically_increasing_id().alias("row"))
    traces = rows.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("row", "v"))).alias("s"), F.count_distinct("v").alias("kinds")).filter("kinds > 1")
    return traces.select("place", F.transform("s", lambda x: x["v"]).alias("signal"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A blank-separated grid x y z without cells that are missing, infinite or beyond 1.7e38."""
    line = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(*(F.get(line, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")))
    return rows.filter("x is not null and y is not null and z is not null and not isnan(z) and z <= 1.7e38")


def read_points(spark: SparkSession, path: str, columns: dict[str, str], numbers: list[str], sep: str = ";", charset: str = "UTF-8") -> DataFrame:
    """A table of points with its columns renamed (file's name to ours); ``numbers`` are parsed with decimal commas, null where they are none."""
    rows = spark.read.option("sep", sep).option("header", True).option("encoding", charset).csv(path)
    return rows.select(*((parse_number(F.col(f"`{old}`")) if new in numbers else F.col(f"`{old}`")).alias(new) for old, new in columns.items()))


def read_las(spark: SparkSession, path: str, missing: float = -999.25) -> DataFrame:
    """LAS well logs of a file or folder in long form: file, curve, unit, depth, value (null where missing).

    The first curve is the depth. Files are read whole, one row each, and
    taken apart by column functions.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r", "").alias("t"))
    part = lambda letter: F.regexp_extract("t", rf"(?is)(?:^|\n)~{letter}[^\n]*\n(.*?)(?=\n~|$)", 1)
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    null = F.coalesce(F.regexp_extract("t", r"(?im)^\s*NULL\s*\.\S*\s+([-+0-9.eE]+)", 1).try_cast("double"), F.lit(missing))
    curves = F.transform(lines(part("C")), lambda x: F.named_struct(F.lit("name"), F.trim(F.regexp_extract(x, r"^\s*([^.\s]+)\s*\.", 1)), F.lit("unit"), F.regexp_extract(x, r"^\s*[^.]+\.(\S*)", 1)))
    files = files.select("file", null.alias("null"), curves.alias("curves"), F.posexplode(lines(part("A"))).alias("row", "line"))
    cells = files.select("file", "null", "curves", F.split(F.trim("line"), r"\s+").alias("v"))
    long = cells.select("file", "null", "curves", F.get("v", F.lit(0)).try_cast("double").alias("depth"), F.posexplode("v").alias("k", "x")).filter("k > 0")
    curve, value = F.get("curves", F.col("k")), F.col("x").try_cast("double")
    return long.select("file", curve["name"].alias("curve"), curve["unit"].alias("unit"), "depth", F.when(value != F.col("null"), value).alias("value"))


def curves_of(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long logs as regular curves: begin, end, step and values in order of depth."""
    done = long.groupBy(*keys).agg(F.min("depth").alias("begin"), F.max("depth").alias("end"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("depth", "value"))).alias("s"))
    return done.select(*keys, "begin", "end", (F.try_divide(F.col("end") - F.col("begin"), F.col("n") - 1)).alias("step"), F.transform("s", lambda x: x["value"]).alias("values"))


def depths_of(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Regular curves in long form: depth is begin + place * step."""
    return curves.select(*keys, "begin", "step", F.posexplode("values").alias("i", "value")).select(*keys, "i", (F.col("begin") + F.col("i") * F.col("step")).alias("depth"), "value")


def read_parameters(spark: SparkSession, path: str, ids: list[str], sep: str = ";") -> DataFrame:
    """A wide table of measurements in long form: ids, name, value; empty cells are left out."""
    rows = spark.read.option("sep", sep).option("header", True).csv(path)
    values = [c for c in rows.columns if c not in ids]
    return rows.unpivot(ids, values, "name", "raw").select(*ids, "name", parse_number(F.col("raw")).alias("value")).filter("value is not null")


def read_stations(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated surveys (length, dip, azimuth), a file for each well named after it."""
    rows = spark.read.option("sep", "\t").schema("length double, dip double, azimuth double").csv(folder).select("*", F.col("_metadata.file_name").alias("file"))
    return rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("well"), "length", "dip", "azimuth").filter("length is not null")


def series_from_json(c: Column) -> Column:
    """A JSON list of numbers as an array; null for what isn't one or holds anything that isn't finite."""
    parsed = F.from_json(c, "array<double>", {"mode": "PERMISSIVE"})
    return F.when(F.forall(parsed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), parsed)
