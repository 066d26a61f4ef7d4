"""Packing token sequences: the linear grouping scheme, then best fit for the small pieces.

The lengths of all pieces are counted first; there are at most `capacity` of them, so the counts have a size
bound that does not depend on the corpus, and the packing is planned on counts alone:

1. lengths above a share (a quarter or a half) of the capacity are sorted and cut into groups of equal cardinality, each rounded up to its largest;
2. a linear programme over configurations of these few sizes, solved by column generation with a knapsack
   for pricing, says how many sequences of each configuration to open; what its rounding down leaves is packed first-fit;
3. actual lengths take the places of the rounded ones, so every gap is known exactly;
4. the small lengths go, longest first, where they fit best.

Steps 3 and 4 work on runs of like sequences, never on single ones.  The plan says, for each length, which
ranks among the pieces of that length go to which sequences and at what offset; pieces find their rank by counts of buckets.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stash, text_slices

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
WORDS_KEPT = 1 << 17


class Encoder:
    """Token ids of whole texts.

    The tokenizer drops white space, lets no token cross it, lower-cases, and parts letters from a mark that stands alone,
    so a text's ids are those of its lower-cased words and marks.  These are kept for reuse: at most WORDS_KEPT of them
    after a task, the earliest met, which are the commonest, and five times as many within one.  Texts beyond Latin-1 are only parted at spaces, as their lower case depends on normal forms.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # lower-case words of Latin-1 letters are what normalising and splitting would make of them
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        plain: list[str] = []
        rest: list[str] = []
        for w in words:
            (plain if _PLAIN(w) else rest).append(w)
        for at in range(0, len(plain), 8192):
            part = plain[at: at + 8192]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):  # a vocabulary without word ends
                rest += part
                continue
            raw, cut = ids.tobytes(), [0, *(cut * 4).tolist()]
            self.known.update((w, raw[i:j]) for w, i, j in zip(part, cut[:-1], cut[1:], strict=True))
        for at in range(0, len(rest), 8192):
            part = rest[at: at + 8192]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            cut = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), ends) * 4
            ids = np.array(got.ids, "<u4").tobytes()
            cut = [0, *cut.tolist()]
            self.known.update((w, ids[i:j]) for w, i, j in zip(part, cut[:-1], cut[1:], strict=True))

    def trim(self) -> None:
        if len(self.known) > WORDS_KEPT:
            self.known = dict(islice(self.known.items(), WORDS_KEPT))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [parted(s) for s in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > 5 * WORDS_KEPT:
            self.trim()
            new = set().union(*split).difference(self.known)
        self.learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]


_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
_LONE_MARK = re.compile("(?<=[a-z\xdf-\xf6\xf8-\xff])[,.](?=[ \n]|$)")


def parted(s: str) -> list[str]:
    try:
        s.encode("latin-1")
    except UnicodeEncodeError:
        return s.replace("\n", " ").split(" ")
    return _LONE_MARK.sub(r" \g<0>", s.lower()).replace("\n", " ").split(" ")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every document with `end` after them, cut at `capacity`.

    Null and empty text: the end id alone.  Null doc_id stays null.  Repeated rows give repeated pieces.
    """

    def run(batches):
        coder = encoder(tokenizer)
        for t in text_slices(batches):
            rows = defaultdict(list)
            texts = [s or "" for s in t["text"].to_pylist()]
            for doc, ids in zip(t["doc_id"].to_pylist(), coder.ids(texts), strict=True):
                a = np.append(ids, np.array([end], "<u4"))
                for k, at in enumerate(range(0, len(a), capacity)):
                    part = a[at: at + capacity]
                    for name, v in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        rows[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32())] + [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        coder.trim()

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


# --- planning on counts -------------------------------------------------------------------------------------------


def groups(counts: dict[int, int], large: list[int], how_many: int) -> dict[int, int]:
    """For each large length the length that it is rounded up to: the largest of its group of equal cardinality."""
    total = sum(counts[x] for x in large)
    out, seen, top, group = {}, 0, None, -1
    for x in sorted(large, reverse=True):
        g = min(how_many - 1, seen * how_many // max(1, total))
        if g != group:
            group, top = g, x
        out[x] = top
        seen += counts[x]
    return out


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value: an unbounded knapsack over capacities."""
    best = np.zeros(capacity + 1)
    layers = []  # by number of items: the last item put in at each room, -1 for none
    for _ in range(capacity // int(sizes.min())):
        new, last = best.copy(), np.full(capacity + 1, -1)
        for i, (s, v) in enumerate(zip(sizes.tolist(), value.tolist(), strict=True)):
            got = best[: capacity + 1 - s] + v
            better = got > new[s:] + 1e-12
            new[s:][better] = got[better]
            last[s:][better] = i
        if (last < 0).all():
            break
        layers.append(last)
        best = new
    take, c = np.zeros(len(sizes), int), capacity
    for last in reversed(layers):
        if last[c] >= 0:
            take[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), take


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 400) -> list[tuple[np.ndarray, int]]:
    """(configuration, how often), rounded down from the optimum of the configuration programme."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * (capacity // int(sizes[i])) for i in range(k)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, demand.astype(float))
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = best_configuration(sizes, np.maximum(price, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ok = way > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, way, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * way
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = column
        columns[out] = column
    return [(columns[i], int(np.floor(x[i] + 1e-9))) for i in range(k) if x[i] >= 1 - 1e-9]


def plan(counts: dict[int, int], capacity: int = 4096, share: int = 4, how_many: int = 24) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset), by length and rank."""
    left = {int(x): int(n) for x, n in counts.items() if n > 0}
    assert all(0 < x <= capacity for x in left), "a piece is longer than a sequence or empty"
    used: dict[int, int] = defaultdict(int)  # ranks of each length given away so far
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many, offset)
    sequences = 0

    def give(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n

    large = [x for x in left if x > capacity // share]
    if left.get(capacity):  # whole sequences need no plan
        n = left.pop(capacity)
        give(capacity, n, 0, 0)
        sequences = n
        large.remove(capacity)
    if large:
        up = groups(left, large, how_many)
        sizes = np.array(sorted(set(up.values()), reverse=True))
        at = {s: i for i, s in enumerate(sizes.tolist())}
        members: list[list[list[int]]] = [[] for _ in sizes]  # by size: [actual length, how many are left], longest first
        for x in sorted(large, reverse=True):
            members[at[up[x]]].append([x, left.pop(x)])
        demand = np.array([sum(n for _, n in m) for m in members])

        def open_run(config: list[int], n: int) -> None:
            """Substitute actual lengths for the sizes of n sequences, in runs that hold the same lengths."""
            nonlocal sequences
            while n > 0:
                need: dict[int, int] = defaultdict(int)
                for i in config:
                    need[i] += 1
                # as many alike sequences as the front lengths last for
                m = min([n] + [max(1, members[i][0][1] // c) for i, c in need.items()])
                offset = 0
                taken: dict[int, list[int]] = defaultdict(list)
                for i in config:
                    while members[i][0][1] < m and m > 1:  # pragma: no cover - m was chosen to fit
                        m = members[i][0][1]
                    x = members[i][0]
                    give(x[0], m, sequences, offset)
                    offset += x[0]
                    x[1] -= m
                    taken[i].append(x[0])
                    if x[1] == 0:
                        members[i].pop(0)
                if offset < capacity:
                    gaps[capacity - offset].append((sequences, m, offset))
                sequences += m
                n -= m

        for column, n in configurations(sizes, demand, capacity):
            config = [i for i in range(len(sizes)) for _ in range(column[i])]
            while n > 0:
                have = [sum(c for _, c in members[i]) // int(column[i]) for i in range(len(sizes)) if column[i]]
                m = min([n, *have])
                if m <= 0:
                    break
                open_run(config, m)
                n -= m
        for m in members:  # what rounding down has left goes with the small ones, by actual length
            for x, n in m:
                left[x] = left.get(x, 0) + n

    for x in sorted(left, reverse=True):  # longest first, each into the tightest gap
        n = left[x]
        while n > 0:
            g = min((g for g in gaps if g >= x), default=None)
            if g is None:
                per = capacity // x
                m = max(1, n // per)
                gaps[capacity].append((sequences, m, 0))
                sequences += m
                continue
            first, m, offset = gaps[g].pop()
            each = min(g // x, max(1, n // m))
            m2 = min(m, n)
            if m2 < m:
                gaps[g].append((first + m2, m - m2, offset))
            for _ in range(each):
                give(x, m2, first, offset)
                offset += x
            n -= m2 * each
            rest = g - each * x
            if rest:
                gaps[rest].append((first, m2, offset))
            if not gaps[g]:
                del gaps[g]
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def sequences_of(table: np.ndarray) -> int:
    return int((table[:, 3] + table[:, 2] - table[:, 1]).max(initial=0))


def pack(cut: DataFrame, capacity: int = 4096, bucket_rows: int = 50_000) -> DataFrame:
    """Pieces with sequence_id and offset; every column of `cut` (as `pieces` returns it) is kept.

    Pieces of one length are interchangeable: they are ranked by bucket of a hash, then by (doc_id, piece, crc).
    """
    cut = stash(cut, "pieces")
    spark = cut.sparkSession
    # counts by length: at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # planning is cheap, so several bounds of what is large and numbers of groups are tried; the fewest sequences win
    table = min((plan(counts, capacity, share, k) for share in (4, 2) for k in (16, 24, 32)), key=sequences_of)
    buckets = max(16, -(-sum(counts.values()) // bucket_rows))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = cut.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_n").over(upto), F.lit(0).cast("bigint"))).drop("_n")
    inner = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_in", F.row_number().over(inner) - 1).join(cells, ["length", "_b"])
    ranked = ranked.select(*[c for c in cut.columns if c != "_b"], (F.col("_in") + F.col("_ahead")).alias("_rank"))
    # the plan's size follows the number of lengths and of configurations, not the number of pieces
    key, sequence, first, offset = table[:, 0] * (1 << 44) + table[:, 1], table[:, 3], table[:, 1], table[:, 4]
    shipped = spark.sparkContext.broadcast((key, sequence, first, offset))

    def place(batches):
        k, s, f, o = shipped.value
        for b in batches:
            at = np.searchsorted(k, b["length"].to_numpy() * (1 << 44) + b["_rank"].to_numpy(), "right") - 1
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [b[n] for n in names] + [pa.array(s[at] + b["_rank"].to_numpy() - f[at]), pa.array(o[at])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("_rank").dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
