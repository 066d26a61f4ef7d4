"""Index files as the public C++ library of the small-world graph paper saves them: a header, one fixed record for each node, then the links of upper levels.

Records of the base level are read in byte ranges, a task each.  Upper links have no directory, so that one task
walks them in order; it holds one piece of the file at a time, and most nodes have four bytes there.  Paths are
what `pyarrow.fs` opens on every executor (mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import pickle
import struct
from dataclasses import dataclass
from os import path as ospath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

# Fixed values of the format: the header's fields in order (little-endian, no padding), and the bit that marks a deleted node.
HEADER = "<QQQQQQiIQQQdQ"
FIELDS = ("offset_level0", "capacity", "count", "record_bytes", "label_offset", "data_offset", "max_level", "entry", "max_upper", "max_base", "m", "level_factor", "build_effort")
DELETED = 1

#: Bytes of records that a task reads at once, and bytes of upper links that are held at once.
RANGE_BYTES, PIECE_BYTES = 16 << 20, 4 << 20


class IndexFileError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    offset_level0: int
    capacity: int
    count: int
    record_bytes: int
    label_offset: int
    data_offset: int
    max_level: int
    entry: int
    max_upper: int
    max_base: int
    m: int
    level_factor: float
    build_effort: int

    @property
    def dim(self) -> int:
        return (self.label_offset - self.data_offset) // 4

    @property
    def upper_start(self) -> int:
        return struct.calcsize(HEADER) + self.count * self.record_bytes


def _opened(path: str):
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), ospath.abspath(path))


def header(path: str) -> Header:
    """The header alone, checked against itself and the file's size; `capacity` and `count` are its peek."""
    system, p = _opened(path)
    with system.open_input_file(p) as f:
        size, raw = f.size(), f.read(struct.calcsize(HEADER))
    if len(raw) < struct.calcsize(HEADER):
        raise IndexFileError(f"{path}: no header")
    h = Header(*struct.unpack(HEADER, raw))
    if h.offset_level0 or h.count > h.capacity or h.data_offset != 4 + 4 * h.max_base or h.record_bytes != h.label_offset + 8 or h.dim <= 0 or (h.label_offset - h.data_offset) % 4:
        raise IndexFileError(f"{path}: fields of the header contradict each other: {h}")
    if size < h.upper_start + 4 * h.count:
        raise IndexFileError(f"{path}: {size} bytes do not hold {h.count} nodes")
    if h.count and not (0 <= h.max_level and h.entry < h.count):
        raise IndexFileError(f"{path}: no entry among {h.count} nodes")
    return h


def _lists(counts: np.ndarray, table: np.ndarray, most: int, where: str) -> pa.ListArray:
    """Rows of a table of links, each cut to its count."""
    if (counts > most).any():
        raise IndexFileError(f"{where}: more than {most} links")
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(table[np.arange(table.shape[1]) < counts[:, None]].astype(np.int64)))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec_id, deleted, links, embedding) of the base level, by byte ranges; an empty index has no rows."""
    h = header(path)
    step = max(1, RANGE_BYTES // h.record_bytes)
    ranges = spark.range(0, -(-h.count // step), 1, max(1, -(-h.count // step))).select((F.col("id") * step).alias("first"))

    def run(batches):
        system, p = _opened(path)
        for b in batches:
            for first in b["first"].to_pylist():
                n = min(step, h.count - first)
                with system.open_input_file(p) as f:
                    f.seek(struct.calcsize(HEADER) + first * h.record_bytes)
                    raw = f.read(n * h.record_bytes)
                if len(raw) != n * h.record_bytes:
                    raise IndexFileError(f"{path}: truncated")
                a = np.frombuffer(raw, np.uint8).reshape(n, h.record_bytes)
                cut = lambda i, j, kind: np.ascontiguousarray(a[:, i:j]).view(kind)  # noqa: B023, E731
                off = np.arange(n + 1, dtype=np.int32) * h.dim
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n)), pa.array(cut(h.label_offset, h.label_offset + 8, "<u8").ravel().astype(np.int64)), pa.array((a[:, 2] & DELETED).astype(bool)),
                     _lists(cut(0, 2, "<u2").ravel().astype(np.int64), cut(4, h.data_offset, "<u4"), h.max_base, path),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(cut(h.data_offset, h.label_offset, "<f4").ravel().astype(np.float32)))], names=["node", "vec_id", "deleted", "links", "embedding"])

    return ranges.mapInArrow(run, "node bigint, vec_id bigint, deleted boolean, links array<bigint>, embedding array<float>")


def upper(spark: SparkSession, path: str) -> DataFrame:
    """(node, level, links) of the levels above the base; fails unless the blocks end where the file does."""
    h = header(path)
    block = 4 + 4 * h.max_upper

    def run(batches):
        for _ in batches:
            system, p = _opened(path)
            with system.open_input_stream(p, buffer_size=PIECE_BYTES) as f:
                left = h.upper_start
                while left:
                    got = len(f.read(min(left, PIECE_BYTES)))
                    if not got:
                        raise IndexFileError(f"{path}: truncated")
                    left -= got
                rows: list[tuple[int, int, list[int]]] = []
                for node in range(h.count):
                    raw = f.read(4)
                    size = struct.unpack("<I", raw)[0] if len(raw) == 4 else -1
                    if size < 0 or size % block or size // block > h.max_level:
                        raise IndexFileError(f"{path}: node {node} has no whole levels")
                    raw = f.read(size) if size else b""
                    if len(raw) != size:
                        raise IndexFileError(f"{path}: truncated")
                    for level in range(size // block):
                        a = raw[level * block:(level + 1) * block]
                        n = struct.unpack_from("<H", a)[0]
                        if n > h.max_upper:
                            raise IndexFileError(f"{path}: more than {h.max_upper} links")
                        rows.append((node, level + 1, list(struct.unpack_from(f"<{n}I", a, 4))))
                    if len(rows) >= 4096 or (rows and node == h.count - 1):
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["node", "level", "links"])
                        rows = []
                if f.read(1):
                    raise IndexFileError(f"{path}: bytes after the last node")

    return spark.range(0, 1, 1, 1).mapInArrow(run, "node bigint, level int, links array<bigint>")


def links(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """All links as `graph.to_table` has them: (seed, node, vec_id, level, links)."""
    base = nodes(spark, path)
    above = upper(spark, path).join(base.select("node", "vec_id"), "node")
    both = base.select("node", "vec_id", F.lit(0).alias("level"), "links").unionByName(above)
    return both.select(F.lit(seed).alias("seed"), "node", "vec_id", "level", "links")


def load(spark: SparkSession, path: str, seed: int = 42) -> bytes:
    """The graph of a file, as the searches of `operators.graph` take it, with its deletions and its own entry and capacity."""
    h, base = header(path), nodes(spark, path)
    if not h.count:
        return pickle.dumps(graph.Graph(h.m, h.build_effort, seed, capacity=h.capacity))
    g: graph.Graph = pickle.loads(graph.from_table(links(spark, path, seed), base, h.m, h.build_effort))
    if len(g.links[h.entry]) - 1 != h.max_level:
        raise IndexFileError(f"{path}: the entry is not on the highest level")
    g.entry, g.capacity = h.entry, h.capacity
    g.delete(r["vec_id"] for r in base.where("deleted").select("vec_id").toLocalIterator())
    return pickle.dumps(g)


def save(blob: bytes, path: str) -> Header:
    """Write a graph as such a file; vectors are stored in single precision.  An existing file is not overwritten."""
    g: graph.Graph = pickle.loads(blob)
    if not g.ids:
        raise IndexFileError("the graph is empty")
    dim, base = len(g.vectors[0]), 2 * g.m
    data = 4 + 4 * base
    h = Header(0, len(g.ids) if g.capacity is None else g.capacity, len(g.ids), data + 4 * dim + 8, data + 4 * dim, data, len(g.links[g.entry]) - 1, g.entry, g.m, base, g.m, 1 / np.log(g.m), g.build_effort)
    packed = lambda at, most, mark=0: struct.pack(f"<HH{most}I", len(at), mark, *at, *[0] * (most - len(at)))
    with open(path, "xb") as out:
        out.write(struct.pack(HEADER, *[getattr(h, n) for n in FIELDS]))
        for ident, vector, levels in zip(g.ids, g.vectors, g.links, strict=True):
            out.write(packed(levels[0], base, DELETED * (ident in g.deleted)) + np.asarray(vector, "<f4").tobytes() + struct.pack("<Q", ident))
        for levels in g.links:
            out.write(struct.pack("<I", (len(levels) - 1) * (4 + 4 * g.m)) + b"".join(packed(at, g.m) for at in levels[1:]))
    return h
