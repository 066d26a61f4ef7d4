"""Saved index files: round trips through the graph, headers, truncation, and a hand-written file."""

import pickle
import struct

import numpy as np
import pytest

from halyard.operators import graph
from halyard.sources import index_file


@pytest.fixture(scope="module")
def saved(tmp_path_factory):
    x = np.random.default_rng(5).integers(0, 50, (400, 6)).astype(float)
    g = graph.Graph(4, 40, 7)
    g.add(range(1000, 1400), x)
    g.delete([1003, 1390])
    path = str(tmp_path_factory.mktemp("index") / "a.idx")
    return g, path, index_file.save(pickle.dumps(g), path)


def test_round_trip(spark, saved, monkeypatch):
    g, path, h = saved
    monkeypatch.setattr(index_file, "RANGE_BYTES", 64 * h.record_bytes)  # several ranges
    assert index_file.header(path) == h and (h.capacity, h.count, h.dim) == (400, 400, 6)
    rows = {r["node"]: r for r in index_file.nodes(spark, path).collect()}
    assert [rows[n]["vec_id"] for n in range(400)] == g.ids and all(rows[n]["links"] == g.links[n][0] for n in range(400))
    assert {r["vec_id"] for r in rows.values() if r["deleted"]} == {1003, 1390}
    got = {(r["node"], r["level"]): r["links"] for r in index_file.upper(spark, path).collect()}
    assert got == {(n, i): at for n, levels in enumerate(g.links) for i, at in enumerate(levels) if i} and got
    again = pickle.loads(index_file.load(spark, "file://" + path, 7))
    assert again.links == g.links and again.entry == g.entry and again.deleted == g.deleted
    for q in np.random.default_rng(6).normal(25, 10, (20, 6)):
        assert again.search(q, 5, 30) == g.search(q, 5, 30)


def test_written_by_hand(spark, tmp_path):
    """Two nodes of one dimension with a link each, and an upper level on the second, byte by byte."""
    node = lambda link, value, label, mark: struct.pack("<HH2If", 1, mark, link, 0, value) + struct.pack("<Q", label)
    path = tmp_path / "b.idx"
    path.write_bytes(struct.pack("<QQQQQQiIQQQdQ", 0, 9, 2, 24, 16, 12, 1, 1, 1, 2, 1, 1.0, 10) + node(1, 0.5, 70, 0) + node(0, 2.0, 71, 1) + struct.pack("<I", 0) + struct.pack("<IHHI", 8, 0, 0, 0))
    assert [tuple(r) for r in index_file.nodes(spark, str(path)).orderBy("node").collect()] == [(0, 70, False, [1], [0.5]), (1, 71, True, [0], [2.0])]
    assert sorted(tuple(r) for r in index_file.links(spark, str(path)).collect()) == [(42, 0, 70, 0, [1]), (42, 1, 71, 0, [0]), (42, 1, 71, 1, [])]
    g = pickle.loads(index_file.load(spark, str(path)))
    assert (g.entry, g.capacity, g.deleted) == (1, 9, {71}) and g.search([0.0], 1, 5)["labels"] == [70]


def test_broken_files(spark, saved, tmp_path):
    _, path, h = saved
    data = open(path, "rb").read()
    for name, bad in (("short", data[:50]), ("records", data[:h.upper_start]), ("size", data[:24] + struct.pack("<Q", 7) + data[32:])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(index_file.IndexFileError):
            index_file.header(str(tmp_path / name))
    for name, bad in (("cut", data[:-2]), ("longer", data + b"x")):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="truncated|whole levels|after the last"):
            index_file.upper(spark, str(tmp_path / name)).collect()
    with pytest.raises(FileExistsError):
        index_file.save(pickle.dumps(saved[0]), path)


def test_empty_index(spark, tmp_path):
    path = tmp_path / "c.idx"
    path.write_bytes(struct.pack("<QQQQQQiIQQQdQ", 0, 5, 0, 24, 16, 12, -1, 2**32 - 1, 1, 2, 1, 1.0, 10))
    assert index_file.nodes(spark, str(path)).count() == index_file.upper(spark, str(path)).count() == 0
    assert pickle.loads(index_file.load(spark, str(path))).capacity == 5


def test_capacity():
    g = graph.Graph(4, 20, 1, capacity=3)
    x = np.arange(10.0).reshape(5, 2)
    g.add([0, 1, 2], x[:3])
    before = g.search([0.0, 0.0], 2, 5)
    with pytest.raises(ValueError, match="exceed"):
        g.add([3, 4], x[3:])
    with pytest.raises(ValueError, match="fit"):
        g.resize(2)
    g.resize(5)
    assert g.search([0.0, 0.0], 2, 5) == before
    g.add([3, 4], x[3:])
    assert len(g.ids) == 5
