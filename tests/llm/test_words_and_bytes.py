"""Near-duplicates and repeated passages against brute force; odd inputs."""

import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest

from halyard.llm import blocks, common, kernel, minhash, repeats, suffix

TEXT = "doc_id bigint, text string"


def test_words_kernel():
    rng = random.Random(0)
    for _ in range(50):
        texts = ["".join(rng.choice("ab é\t\n\x0b\x1c") for _ in range(rng.randint(0, 30))) for _ in range(5)]
        raw = [t.encode() for t in texts]
        off = np.append(0, np.cumsum([len(b) for b in raw]))
        start, end, h, first = kernel.words(np.frombuffer(b"".join(raw), np.uint8), off)
        joined = b"".join(raw)
        got = [[joined[a:b].decode() for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert got == [brute.words(t) for t in texts]
        by = {}
        for a, b, x in zip(start, end, h.tolist(), strict=True):
            assert by.setdefault(joined[a:b], x) == x
        assert len(set(by.values())) == len(by)


def test_components(spark):
    rng = random.Random(1)
    for n in (1, 30, 200):
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(n)] + [(None, 1), (2, None)]
        u = brute.Sets()
        for a, b in edges:
            if a is not None and b is not None and a != b:
                u.join(a, b)
        got = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == {i: u.find(i) for i in list(u.up)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r["component_id"] for r in common.components(chain).collect()} == {0}
    assert common.components(chain.limit(0)).count() == 0


def test_bitmap_lets_members_through(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) h")
    bits = common.bitmap(df, "h")
    mine = np.array([r[0] for r in df.collect()])
    assert common.in_bitmap(bits, mine).all()
    assert common.in_bitmap(bits, np.random.default_rng(0).integers(-2**63, 2**63 - 1, 10_000)).mean() < 0.01


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(15)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice((" ", "  ", "\n")).join(w) if rng.random() > 0.05 else rng.choice((None, "", " \t"))))
    return rows


@pytest.mark.parametrize("seed, size, percent", [(0, 3, 85), (1, 5, 80), (2, 1, 85)])
def test_near_duplicates(spark, seed, size, percent):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXT).repartition(5), size, percent).collect()}
    assert got == brute.near(rows, size, percent)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    rows = corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXT), 3, 85).collect()}
    assert got == brute.near(rows, 3, 85)


def test_near_duplicates_with_few_common_sketch_values(spark):
    words = [f"w{i}" for i in range(200)]
    h, _ = minhash.shingles(pa.array(words), 1)
    order = [words[i] for i in np.argsort(h)]
    rows = [(1, " ".join(order)), (2, " ".join(order[:11] + order[32:]))]  # J = 0.895, 11 of 32 values in common
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, TEXT), 1, 80).collect()}
    assert got == brute.near(rows, 1, 80) and got[2][1] == 1


def test_missed_links_are_rare():
    for j in (0.8, 0.85):
        need = (j - minhash.SLACK) * minhash.SKETCH
        odds = {(0, 0, 0): 1.0}  # (last value shared, two neighbours shared, values shared)
        for _ in range(minhash.SKETCH):
            step = {}
            for (last, pair, n), p in odds.items():
                for key, q in (((0, pair, n), p * (1 - j)), ((1, pair | last, n + 1), p * j)):
                    step[key] = step.get(key, 0.0) + q
            odds = step
        assert sum(p for (_, pair, n), p in odds.items() if not pair or n < need) < 4e-9


def test_near_duplicates_odd_inputs(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b", 1), (4, "A  B", 2), (4, "A  B", 2), (None, "a b", 3), (8, "x y z w", 1), (9, "x y z W", 2)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int"), 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (8, 2, 8, True), (9, 2, 8, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], TEXT)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words(spark, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 50)}" for _ in range(rng.randint(10, 200))] for _ in range(5)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(bases)
            k = rng.randint(0, len(x))
            w += x[k: k + rng.randint(0, 120)] + [f"u{rng.random()}" for _ in range(rng.randint(0, 3))]
        rows.append((rng.choice([i, i, i, None, i // 2]), " ".join(w) if rng.random() > 0.05 else None))
    got = blocks.remove_repeats(spark.createDataFrame(rows, TEXT).repartition(4), 20, 8).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_words(rows, 20)


def test_repeated_words_keep_what_they_say(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "start " + text, 7), (2, text + " end", 7), (3, "é " + " ".join(text.split()[:49]), 7), (4, "é " + " ".join(text.split()[9:60]), 7)]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in blocks.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, n_removed int")).collect()}
    assert got[1] == (0, "start " + text) and got[2] == (80, "end") and got[3][0] == 0 and got[4] == (51, "é")
    with pytest.raises(ValueError):
        blocks.repeated_words(spark.createDataFrame(rows, "doc_id bigint, text string, x int"), 20, 20)
    assert blocks.remove_repeats(spark.createDataFrame([], TEXT)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_repeated_bytes(spark, seed, monkeypatch):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("ab ") for _ in range(rng.randint(10, 300))) for _ in range(5)] + ["a" * 300, "é" * 80]
    rows = []
    for i in range(60):
        w = ""
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(bases)
            k = rng.randint(0, len(x))
            w += x[k: k + rng.randint(0, 250)] + "".join(rng.choice("xyzabc") for _ in range(rng.randint(0, 3)))
        rows.append((rng.choice([i, i, i, None]), w if rng.random() > 0.05 else None))
    monkeypatch.setattr(suffix, "MOST_STRINGS", 3 if seed % 2 else 256)
    got = suffix.remove_repeats(spark.createDataFrame(rows, TEXT).repartition(4), 40, 12).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_bytes(rows, 40)
    assert suffix.remove_repeats(spark.createDataFrame([], TEXT)).count() == 0


def test_repeated_bytes_take_one_worker_a_task(spark, monkeypatch):
    """No stage runs a Python function on what another one of it returns, as that takes two workers a task."""
    plans = []

    def seen(f):
        return lambda df, *rest: (plans.append(df), f(df, *rest))[1]

    for module in (suffix, repeats):
        for name in ("stash", "bitmap"):
            monkeypatch.setattr(module, name, seen(getattr(module, name)))
    rows = [(i, f"{i % 7} " * 100 + str(i) * 40) for i in range(30)]
    plans.append(suffix.remove_repeats(spark.createDataFrame(rows, TEXT), 40, 12))
    maps = 0
    for df in plans:
        above = []
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            deep = re.search(r"[A-Za-z]", line)
            if not deep:
                continue
            above = [x for x in above if x[0] < deep.start()] + [(deep.start(), re.match(r"\w+", line[deep.start():])[0])]
            if above[-1][1] == "MapInArrow":
                maps += 1
                stage = []
                for _, name in reversed(above[:-1]):
                    if "Exchange" in name:
                        break
                    stage.append(name)
                assert "MapInArrow" not in stage, line
    assert maps >= 10


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for k in range(200):
        n, letters = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        s = rng.integers(0, letters, n).astype(np.uint16)
        s = np.tile(s, 4) if k % 3 == 0 else s
        a = s.tolist()
        order = suffix.suffix_array(s, letters)
        assert order.tolist() == sorted(range(len(a)), key=lambda i: a[i:])
        shared = suffix.common_prefixes(s, order, 10)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            m = 0
            while m < min(len(a) - max(i, j), 10) and a[i + m] == a[j + m]:
                m += 1
            assert shared[i] == m
