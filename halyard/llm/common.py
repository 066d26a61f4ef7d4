"""What the operators share: tables in the shared folder, slices of Arrow batches, connected components.

Tables that cut lineage are Parquet files under the folder that the cluster names in
spark.checkpoint.dir, which every executor sees; a lost executor costs no more than rereading
them.  They stay until ``release`` or until the owner of that folder clears it, because lazy results read them.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = getattr(spark, "_halyard_shared", None)
        if own is None:
            own = spark._halyard_shared = "file://" + tempfile.mkdtemp(prefix="halyard-")
        folder = own
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the table that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/halyard/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._halyard_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that `stash` has written and nothing reads any more."""
    spark, path = table.sparkSession, table._halyard_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.remove((spark, path))


def release(spark: SparkSession) -> None:
    """Delete the tables this process has written; results that still read them become unreadable."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for owner, path in list(_WRITTEN):
        if owner is spark:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _WRITTEN.remove((owner, path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and the executor needs it for others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def text_slices(batches, text: str = "text", most: int = 1 << 20):
    """Cut Arrow batches into slices of about `most` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(t[text]), 0).to_numpy())
        at = 0
        while at < t.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield t.slice(at, to - at)
            at = to
    give_back()


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column (null: empty) as one byte array and the offsets of each."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a, "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset:]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def components(edges: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in edges (a, b): the smallest id reachable.

    Alternating large-star and small-star rounds: each is one combinable minimum per vertex and
    an equi-join.  The minima are written before they are joined, as a join on the exchange of an aggregate could not be split
    where a hub has very many links.  Every round is written to the shared folder, too, and the one before it deleted.  Null ends and loops link nothing; repeated edges count once.
    """
    spark = edges.sparkSession
    e = stash(edges.where("a is not null and b is not null and a <> b")
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(e)
    if not seen[0]:
        return spark.createDataFrame([], "id bigint, component_id bigint")
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, stash(small, name)
        for old in (before, least, low):
            discard(old)
        now = mark(e)
        if now == seen:
            roots = e.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
        seen = now
    raise RuntimeError("components: no fixed point; raise most_rounds")


def whole_groups(batches, keys: list[str], rows: int = 20_000):
    """Regroup sorted Arrow batches into tables of about `rows` rows that cut no group of equal `keys`."""
    held: list[pa.Table] = []
    n = 0

    def last_change(t: pa.Table) -> int:
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            c = t[k].combine_chunks()
            change |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(change)
        return int(at[-1]) + 1 if len(at) else 0

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n >= rows:
            t = pa.concat_tables(held).combine_chunks()
            to = last_change(t)
            if to:
                yield t.slice(0, to).combine_chunks()
            held, n = [t.slice(to)], t.num_rows - to
    if n:
        yield pa.concat_tables(held).combine_chunks()
    give_back()


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the end."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def binary_rows(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column of packed numbers, and the offset of each row (null: empty)."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a, b"").cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset:]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    size = np.dtype(dtype).itemsize
    return data.view(dtype) if len(data) else np.zeros(0, dtype), (off - off[0]) // size


BITMAP_BITS = 27


class Bits:
    """2**BITMAP_BITS bits; as long as most 64-bit words of them are 0, only the others are sent to the tasks."""

    def __init__(self, at: np.ndarray, words: np.ndarray):
        self.at, self.words, self._all = at.astype(np.int32), words.astype(np.uint64), None

    def all(self) -> np.ndarray:
        if self._all is None:
            self._all = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
            self._all[self.at] = self.words
            self.at = self.words = None  # a task's copy, which is sent nowhere
        return self._all


def bitmap(hashes: DataFrame, column: str) -> Bits:
    """2**27 bits (16 MB, whatever the number of rows): two for each 64-bit hash, at its first and its next 27 bits.

    A filter that lets every member through and, the fuller it is, more of the rest; what follows it must be exact.
    At most 2**21 words reach the driver.
    """
    at = lambda skip: F.shiftrightunsigned(F.shiftleft(F.col(column), skip), 64 - BITMAP_BITS)
    both = hashes.select(F.explode(F.array(at(0), at(BITMAP_BITS))).alias("p"))
    cells = both.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    got = cells.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    return Bits(got["w"].to_numpy(), got["b"].to_numpy().view(np.uint64))


def in_bitmap(filled: Bits, h: np.ndarray) -> np.ndarray:
    bits = filled.all()

    def has(p: np.ndarray) -> np.ndarray:
        return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0

    h = h.view(np.uint64)
    out = has(h >> np.uint64(64 - BITMAP_BITS))
    some = np.flatnonzero(out)
    out[some] = has((h[some] << np.uint64(BITMAP_BITS)) >> np.uint64(64 - BITMAP_BITS))
    return out
