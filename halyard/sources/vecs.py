"""Vector files of fixed records: per row an int32 dimension, then that many float32 or int32 values, little-endian.

Files are read as `binaryRecords`-like byte ranges by Spark, so they may lie in any store that Spark reads; each
range is decoded by numpy in an Arrow batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int")}


class VectorFileError(ValueError):
    pass


def dimension(spark: SparkSession, path: str) -> tuple[int, int]:
    """(dimension, rows) of a file, checked against its size."""
    row = spark.read.format("binaryFile").load(path).select("length").first()
    size = row[0] if row else 0
    if size < 4:
        raise VectorFileError(f"{path}: no record")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        dim = struct.unpack("<i", bytes(stream.read() & 255 for _ in range(4)))[0]
    finally:
        stream.close()
    if dim <= 0 or size % (4 + 4 * dim):
        raise VectorFileError(f"{path}: {size} bytes are no whole records of dimension {dim}")
    return dim, size // (4 + 4 * dim)


def read(spark: SparkSession, path: str, kind: str = "fvecs", max_rows: int | None = None) -> DataFrame:
    """(row, vec): rows by position.  Every record must have the first one's dimension, or the read fails."""
    dtype, sql = KINDS[kind]
    dim, rows = dimension(spark, path)
    width = 4 + 4 * dim
    records = spark.sparkContext.binaryRecords(path, width)
    # positions: the number of records before each partition, then the place in it
    counts = records.mapPartitionsWithIndex(lambda i, it: [(i, sum(1 for _ in it))]).collect()
    start, total = {}, 0
    for i, n in sorted(counts):
        start[i] = total
        total += n

    def numbered(i: int, it: Iterator[bytes]):
        return ((start[i] + k, bytearray(b)) for k, b in enumerate(it))

    raw = spark.createDataFrame(records.mapPartitionsWithIndex(numbered), "row bigint, raw binary")
    if max_rows is not None:
        raw = raw.where(F.col("row") < max_rows)

    def decode(batches):
        for b in batches:
            data = np.frombuffer(b"".join(b["raw"].to_pylist()), np.uint8).reshape(-1, width)
            dims = data[:, :4].copy().view("<i4").ravel()
            if (dims != dim).any():
                raise VectorFileError(f"{path}: a record has another dimension than {dim}")
            values = np.ascontiguousarray(data[:, 4:]).view(dtype).astype(dtype[1:]).ravel()
            off = np.arange(len(data) + 1, dtype=np.int32) * dim
            yield pa.RecordBatch.from_arrays([b["row"], pa.ListArray.from_arrays(pa.array(off), pa.array(values))], names=["row", "vec"])

    return raw.mapInArrow(decode, f"row bigint, vec array<{sql}>")


def write(df: DataFrame, path: str, kind: str = "fvecs", row: str = "row", vec: str = "vec") -> int:
    """Write (row, vec) in order of `row` as one local file, partition by partition; returns the number of rows.

    One file in one order is what the format asks for, so rows stream through the driver, a partition at a time.
    """
    dtype = KINDS[kind][0]
    n, dim = 0, None
    with open(path, "xb") as out:
        for r in df.select(row, vec).orderBy(row).toLocalIterator():
            a = np.asarray(r[1], dtype)
            if dim is None:
                dim = len(a)
            if len(a) != dim or dim == 0:
                raise VectorFileError("rows of unlike dimension")
            out.write(struct.pack("<i", dim) + a.tobytes())
            n += 1
    return n


TRACE = ("query_id", "step", "dists", "inserts", "first_nn", "nearest", "farthest", "mean", "variance", "p25", "p50", "p75", "recall")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Rows of 13 float64 values: a query and its observations."""
    width = 8 * len(TRACE)
    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width).map(lambda b: (bytearray(b),)), "raw binary")

    def decode(batches):
        for b in batches:
            a = np.frombuffer(b"".join(b["raw"].to_pylist()), "<f8").reshape(-1, len(TRACE))
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].astype(np.int64))] + [pa.array(np.ascontiguousarray(a[:, i])) for i in range(1, len(TRACE))], names=list(TRACE))

    return raw.mapInArrow(decode, ", ".join(["query_id bigint"] + [f"{c} double" for c in TRACE[1:]]))


def write_trace(df: DataFrame, path: str) -> int:
    n = 0
    with open(path, "xb") as out:
        for r in df.select(*TRACE).toLocalIterator():
            out.write(np.asarray(r, "<f8").tobytes())
            n += 1
    return n
