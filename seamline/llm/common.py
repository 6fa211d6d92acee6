"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are none of these.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a character class for Java, RE2 and DuckDB.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on one machine, where it is unset (tests), a folder below the warehouse stands in; on a cluster that is an error."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir")
    if not own and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (own or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint where rows hold texts, and the job's shuffle files go when it is written."""
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared ones that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout."""
    import os
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    old = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in old.split(os.pathsep) and root in sys.path + [os.getcwd(), ""]:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, old) if x)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of text, or one row."""
    give_back()
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0))
        if not len(sizes):
            continue
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        give_back()


def give_back() -> None:
    """Return memory that this worker no longer uses to the system: workers live on, and the next operator's worker needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch[column].cast(pa.large_string()), "")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and each text's start in them with the end as last entry."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's text number and code, and the distinct words that the codes mean."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    rows = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    coded = flat.dictionary_encode()
    return rows[full], np.asarray(coded.indices)[full].astype(np.int64), coded.dictionary


def codes(keys: np.ndarray) -> np.ndarray:
    """Small consecutive numbers for equal keys, by order of first appearance."""
    return np.asarray(pa.array(keys).dictionary_encode().indices).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(32)
    return x


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in distinct.cast(pa.large_binary())), np.uint64, len(distinct))
