"""Binary radar files: a header of 15 bytes, then records of seven 16-bit numbers and 512 signed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER, HEAD, SAMPLES = 15, 14, 512
RECORD = HEAD + SAMPLES


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """Files and how many whole records they hold, from their lengths alone."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.greatest(F.lit(0), F.floor((F.col("length") - HEADER) / RECORD)).alias("records"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """path, trace (from 0), signal of each whole record; a cut record at the end is left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = np.frombuffer(content.as_buffer(), np.uint8)[HEADER:]
                n = len(data) // RECORD
                signal = data[: n * RECORD].reshape(n, RECORD)[:, HEAD:].view(np.int8).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SAMPLES), pa.array(signal.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), lists], ["path", "trace", "signal"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, trace long, signal array<double>")
