"""Mixing, packing and vectors against plain versions; the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import corpus_pipeline
from halyard.llm import mixing, packing, pq, queries
from halyard.llm.common import stash

DOCS = "doc_id bigint, text string, source string"


def water(sizes, epochs=3, weights=(1, 2, 3)):
    """Clamp and reshare until none is above its cap."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / max(1, sum(w[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "z", None, "c", "empty"]
    rows = [(i, " ".join("x" for _ in range(rng.randint(0, 40 if s != "a" else 4))) if s != "empty" else None, s) for i, s in ((i, rng.choice(sources[:3] * 4 + sources)) for i in range(200))]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want = water(dict(sizes))
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7), buckets=4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    whole = mixing.mix(spark.createDataFrame(rows, DOCS), cut=False).collect()
    assert all(r["taken"] == r["repeats"] * r["size"] for r in whole)


def test_mixing_odd_inputs(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b", "s", 1), (1, None, "s", 1), (2, "c", None, 1), (2, "c", None, 1), (3, "", "s", 1)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, target int"), carry=()).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 4
    blank = mixing.mix(spark.createDataFrame([(1, "", "s")], DOCS)).first()
    assert (blank["size"], blank["target"], blank["taken"]) == (0, 0.0, 0)


def verified(table, counts, capacity):
    """The number of sequences of a plan that gives every piece one place, without gaps or overlaps."""
    places, given = defaultdict(list), Counter()
    for length, a, b, first, offset in table.tolist():
        given[length] += b - a
        for j in range(b - a):
            places[first + j].append((offset, length))
    assert given == +Counter(counts)
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("n, most", [(1, 64), (2, 64), (40, 64), (500, 64), (500, 20), (3000, 40)])
def test_plans(n, most):
    counts = Counter(np.random.default_rng(n + most).integers(1, most + 1, n).tolist())
    least = -(-sum(k * v for k, v in counts.items()) // 64)
    used = min(verified(packing.plan(counts, 64, share, k), counts, 64) for share in (4, 2) for k in (16, 24, 32))
    big = sum(v for k, v in counts.items() if k > 32)
    assert used <= 1.06 * max(least, big) + 2
    assert len(packing.plan({}, 64)) == 0


def test_plan_size_does_not_follow_the_corpus():
    lengths = np.random.default_rng(0).lognormal(6.5, 1.2, 20_000).astype(int).clip(1, 4096).tolist()
    few, many = Counter(lengths), Counter({k: 100_000 * v for k, v in Counter(lengths).items()})
    assert len(packing.plan(many)) < 4 * len(packing.plan(few)) + 10_000


def test_encoder_gives_the_tokenizers_ids():
    e = packing.Encoder(queries.tokenizer_file())
    texts = ["Hello, world. It's  a\ttest\n\nof 123. things, x..", "a\x85b c d\x1cE'S x's <|endoftext|> foo ﬁ İ Σας", "a\x1cb c\x1d, d. it's. a.b 3.", "ÀÉ µ. ß, ÿ. \xa0x", "", "é ́a"]
    assert [i.tolist() for i in e.ids(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(("cat", "dog.", "Zebra,", "été")) for _ in range(rng.choice((0, 1, 30, 200, 900))))) for i in range(120)] + [(7, None), (None, "a b"), (500, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(packing.pieces(docs.repartition(4), queries.tokenizer_file(), 512), 512).collect()
    e = packing.Encoder(queries.tokenizer_file())
    want = Counter()
    for i, t in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k: k + 512], "<u4")
            want[i, k // 512, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in rooms.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 512
    assert len(rooms) <= 1.05 * sum(r["length"] for r in got) / 512 + 2
    assert packing.pack(packing.pieces(docs.limit(0), queries.tokenizer_file())).count() == 0


def vectors(seed, n=400, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(30, dim))
    x = base[r.integers(0, 30, n)] + r.normal(size=(n, dim)) * r.choice([0, 0.02, 0.1, 1.0], (n, 1))
    return [(i, [float(v) for v in row.astype(np.float32)], int(r.integers(0, 3))) for i, row in enumerate(x)]


@pytest.mark.parametrize("seed, block", [(0, 1024), (1, 16)])
def test_near_vectors(spark, seed, block, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", block)
    rows = vectors(seed)
    x = np.array([v for _, v, _ in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([a for _, _, a in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    u = brute.Sets()
    for a, b in zip(*np.nonzero(linked), strict=True):
        u.join(int(a), int(b))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)).collect()}
    assert got == {i: (int(linked[i].sum()), u.find(i), u.find(i) == i) for i in range(len(rows))}  # recall 1 against brute force


def test_near_vectors_odd_inputs(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.001], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (10, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), None: (0, None, True)} | {i: (0, i, True) for i in range(3, 11)}
    assert pq.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_many_lengths(spark, monkeypatch):
    flat = lambda entries, dim, lists, sample: {"dim": dim, "coarse": np.zeros((1, dim)), "parts": [], "books": []}
    monkeypatch.setattr(pq, "train", flat)
    rows = [(2 * n + k, [1.0] + [0.0] * (n - 1) if k else [2.0] + [0.0] * (n - 1), 1) for n in range(1, 1006) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.near_vectors(df).collect()}
    assert got == {i: (1, i - i % 2) for i, _, _ in rows}


def test_pipeline_stages(spark):
    made = [(1, "the cat and the dog sat on the mat all day", "en", "a", 5), (2, "The cat and the dog sat on the mat all day", "en", "a", 5), (3, "12 !!", "en", "a", 5), (4, None, None, None, None),
            (5, "my password = hunter2hunter2 ok then", "en", "b", 5), (6, "der hund und die katze schlafen heute", "de", "b", 5), (None, "ein kleiner satz ohne kennung", "de", "b", 5)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, ""), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
        seen.append({r["doc_id"]: r for r in docs.collect()})
    assert set(seen[0]) == {1, 2, 5, 6, None} and set(seen[1]) == {1, 5, 6, None}
    assert seen[2][5]["text"] == "my <assign> ok then" and seen[2][5]["n_chars"] == len(seen[2][5]["text"]) and seen[2][1]["text"] == made[0][1]
    assert set(seen[3]) <= set(seen[2]) and set(seen[4]) == set(seen[3])
    empty = docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
        empty = docs


def test_pipeline_keeps_documents_that_no_model_knows(spark):
    made = [(1, "the cat sat", None, "a", 11), (2, "12 !!", None, "a", 5), (3, None, None, "a", 0), (None, "été", None, "a", 3), (5, "", None, "a", 0)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    unlabelled = corpus_pipeline.language(spark, spark.createDataFrame(made, kind), "")
    assert sorted(r["text"] for r in unlabelled.collect()) == ["the cat sat", "été"]
    nameless = spark.createDataFrame([(None, t, "en", s, n) for _, t, _, s, n in made], kind)
    assert sorted(r["text"] for r in corpus_pipeline.language(spark, nameless, "").collect()) == ["the cat sat", "été"]
    undetermined = spark.createDataFrame([(i, t, "und", s, n) for i, t, _, s, n in made], kind)
    assert sorted(r["text"] for r in corpus_pipeline.language(spark, undetermined, "").collect()) == ["the cat sat", "été"]


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    made = [(1, "a quite plain sentence about cats", "en", "b", 5), (1, "another text with other words entirely", "en", "a", 5), (1, "a quite plain sentence about cats", "en", "a", 5),
            (2, "A quite plain sentence about cats", "en", "a", 5), (None, "no id here", "en", "b", 5), (None, "no id here", "en", "a", 5)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for parts in (1, 5):
        got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()]
        assert sorted(got, key=repr) == sorted([made[1], made[2], made[5]], key=repr)


def test_pipeline_mixes_rows_without_id(spark):
    made = [(None, f"{s} {i} three four five six seven eight", "en", s, 5) for s in "ab" for i in range(10)]
    made += [(7, "one row twice", "en", None, n) for n in (1, 1, 2)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    goal = {r["source"]: (r["target"], r["size"]) for r in mixing.mix(docs, cut=False).collect()}
    times = {(r["doc_id"], r["source"], r["size"]): 0 for r in mixing.mix(docs, cut=False).collect()}
    for r in mixing.mix(docs, cut=False).collect():
        times[r["doc_id"], r["source"], r["size"]] += r["repeats"]
    got = corpus_pipeline.mixing_sources(spark, docs.repartition(3), "").collect()
    for s, (target, size) in goal.items():
        words = sum(len(r["text"].split()) for r in got if r["source"] == s)
        assert abs(words - target) <= size / 2 + 1
    assert sum(times.values()) == len(got) and {tuple(r) for r in got} <= set(made)
    assert times[7, None, 3] == sum(r["doc_id"] == 7 for r in got)
