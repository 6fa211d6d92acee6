"""Writers of exchange formats. All are written by executors, a part of the output for each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_samples(traces: DataFrame, path: str, columns: list[str], signal: str, last: int) -> None:
    """Tab-separated files of each sample 0 to ``last`` across all traces, a folder for each sample."""
    long = traces.select(*columns, F.posexplode(F.slice(signal, 1, last + 1)).alias("sample", "amplitude"))
    long.repartition("sample").write.mode("overwrite").partitionBy("sample").option("sep", "\t").option("header", True).csv(path)


def mif_lines(lines: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """A polyline of each key in the text form of exchange files: keys, text. Lines of fewer than two points are left out."""
    done = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(x), F.col(y)))).alias("p")).filter(F.size("p") >= 2)
    points = F.array_join(F.transform("p", lambda v: F.format_string("%.3f %.3f", v[x], v[y])), "\n")
    return done.select(*keys, F.concat(F.lit("Pline "), F.size("p").cast("string"), F.lit("\n"), points).alias("text"))


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)


def write_pieces(df: DataFrame, path: str, split: str) -> None:
    """Parquet with a folder for each part of a split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
