"""Texts made to mislead hashes, texts longer than a slice, hot keys."""

import random

import brute
import numpy as np
import pytest

from halyard.llm import blocks, common, kernel, minhash, repeats, suffix

TEXT = "doc_id bigint, text string"


def thue_morse(n, a="a", b="b"):
    """A word and its complement, which sums of powers modulo 2**64 can't tell apart for any odd base."""
    x = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[v] for v in x), "".join((b, a)[v] for v in x)


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_words_that_collide_in_sums(n):
    x, y = (w.encode() for w in thue_morse(n))
    data = np.frombuffer(x + b" " + y, np.uint8)
    _, _, h, _ = kernel.words(data, np.array([0, len(data)]))
    assert h[0] != h[1]


@pytest.mark.parametrize("n", [1024, 4096])
def test_unlike_words_remove_and_link_nothing(spark, n):
    x, y = thue_morse(n)
    plain = [f"w{i}" for i in range(60)]
    first, second = plain[:], plain[:]
    for i in range(0, 60, 5):  # in every window and every shingle
        first[i], second[i] = x, y
    for i in range(60):
        if i % 5 == 2:
            first[i], second[i] = x + "q", y + "q"
    rows = [(1, " ".join(first)), (2, " ".join(second))]
    docs = spark.createDataFrame(rows, TEXT)
    assert [r["n_removed"] for r in blocks.remove_repeats(docs).collect()] == [0, 0]
    assert sorted(r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()) == [1, 2]


def test_runs_of_words_that_collide_in_sums(spark):
    x, y = thue_morse(1024, "up ", "down ")
    rows = [(1, x), (2, y), (3, "some other start " + x)]
    got = blocks.remove_repeats(spark.createDataFrame(rows, TEXT)).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_words(rows, 50)


def test_bytes_that_collide_in_sums(spark):
    x, y = thue_morse(2048)
    rows = [(1, x), (2, y), (3, "c" * 150 + x[:1500])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, TEXT)).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_bytes(rows, 100)


def test_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rng = random.Random(5)
    bases = [[f"w{rng.randint(0, 50)}" for _ in range(rng.randint(10, 200))] for _ in range(5)]
    made = []
    for i in range(20):
        w = []
        for _ in range(rng.randint(1, 8)):
            x = rng.choice(bases)
            k = rng.randint(0, len(x))
            w += x[k: k + rng.randint(0, 120)] + [f"u{rng.random()}" for _ in range(rng.randint(0, 3))]
        made.append((i, rng.choice((" ", "  ", " \n ")).join(w) + rng.choice(("", " "))))
    made.append((50, "x" * 2000 + " " + made[3][1]))
    monkeypatch.setattr(blocks, "text_slices", lambda batches: common.text_slices(batches, most=1))
    monkeypatch.setattr(suffix, "text_slices", lambda batches, most: common.text_slices(batches, most=1))
    docs = spark.createDataFrame(made, TEXT).repartition(3)
    got = blocks.repeated_words(docs, 20, 8)
    got = repeats.cut_out(docs, got, blocks._cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string").drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_words(made, 20)
    got = suffix.remove_repeats(docs, 40, 12).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_bytes(made, 40)


def test_pieces_hold_every_window_once(monkeypatch):
    import pyarrow as pa

    text = "ab  c\nde " * 40
    t = pa.table({"doc_id": pa.array([7]), "t": pa.array([1]), "text": pa.array([text])})
    found = [(int(base[0]) + k, bytes(data[k: k + 10])) for _, _, base, data, off in repeats.pieces(t, 10, False, 50) for k in range(len(data) - 9)]
    assert found == [(k, text.encode()[k: k + 10]) for k in range(len(text) - 9)]
    words = text.split()
    found = [(int(base[0]) + k, w[k: k + 4]) for _, _, base, data, off in repeats.pieces(t, 4, True, 50) for w in [bytes(data).decode().split()] for k in range(len(w) - 3)]
    assert found == [(k, words[k: k + 4]) for k in range(len(words) - 3)]


def test_equal_windows_have_equal_anchors_in_slices_of_any_length():
    rng = np.random.default_rng(0)
    piece = rng.integers(97, 123, 150).astype(np.uint8)
    seen = set()
    for n in (0, 1000, 70_000, 400_000):
        data = np.concatenate([rng.integers(97, 123, n).astype(np.uint8), piece])
        text, a, lo, m = suffix._runs_of(data, np.array([0, n, n + 150]), 100, 32)
        seen.add(tuple(a[text == 1].tolist()))
    assert len(seen) == 1


def test_suffix_arrays_over_many_names():
    rng = np.random.default_rng(1)
    for letters, n in ((200, 12_000), (3, 20_000), (60, 5_000)):
        s = rng.integers(0, letters, n).astype(np.uint16)
        s = np.concatenate([s, s[: n // 2]])
        assert suffix.suffix_array(s, letters).tolist() == sorted(range(len(s)), key=lambda i: s[i:].astype(">u2").tobytes())


def test_versions_of_one_document(spark):
    a, b = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120)), "-".join(str(i * i) for i in range(60))
    rows = [(1, a), (1, b), (1, a + b[:150]), (2, b + a[5:200]), (2, a)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, TEXT).repartition(3), 40, 12).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute.cut_bytes(rows, 40)
