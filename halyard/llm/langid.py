"""Language identification in two levels: the family first, then the languages within it.

A text is the square roots of its hashed letter bigram and trigram counts, scaled to length one.  Linear
one-versus-rest machines choose the family; within a family a linear support vector machine for each pair of
languages votes.  All are fitted with a squared hinge on a bounded sample of labelled texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, give_back, only, text_slices

#: Families of languages; one that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
DIM = 4096
_KEEP = np.zeros(256, bool)
_KEEP[128:] = True
_KEEP[97:123] = True
_GRAM = np.arange(256, dtype=np.uint32)
_GRAM[~_KEEP] = 32


def _features(texts) -> np.ndarray:
    """One row of DIM values for each text (null: empty)."""
    data, off = bytes_of(pc.utf8_lower(pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")))
    n = len(off) - 1
    b = _GRAM[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off)) * DIM
    out = np.zeros(n * DIM)
    for k, mult in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(b) < k:
            continue
        code = b[: len(b) - k + 1].copy()
        for i in range(1, k):
            code = code * np.uint32(257) + b[i: len(b) - k + 1 + i]
        same = doc[: len(code)] == doc[k - 1:]
        letters = (b[: len(code)] != 32).astype(np.int8)
        for i in range(1, k):
            letters += b[i: len(code) + i] != 32
        ok = same & (letters >= 2)
        slot = ((code[ok] * np.uint32(mult)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount(doc[: len(code)][ok] + slot, minlength=n * DIM)
    x = np.sqrt(out.reshape(n, DIM))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _pieces(text: str) -> list[str]:
    """The text and two short passages from its middle, so that short texts are learned as well."""
    w = text.split(" ")
    return [text, " ".join(w[len(w) // 2: len(w) // 2 + 6]), " ".join(w[len(w) // 3: len(w) // 3 + 20])]


def _to_vectors(batches):
    """The language and the non-zero features (places and values) of every piece."""
    for t in text_slices(batches, most=1 << 19):
        for lang, text in zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True):
            x = _features(pa.array(_pieces(text), pa.string())).astype(np.float32)
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], names=["lang", "at", "x"])


def _svm(x1: np.ndarray, y: np.ndarray, strength: float = 30.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge, classes weighted alike; the last column of x1 is 1."""
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * strength
    w = v = np.zeros(x1.shape[1], x1.dtype)
    step = 1.0 / (1.0 + 4 * strength)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - step * (v - 2 * (x1.T @ (c * y * slack)))
        v, w = new + (t / (t + 3)) * (new - w), new
    return w.astype(np.float64)


def train(labelled: DataFrame, per_lang: int = 200, families: dict[str, str] | None = None) -> dict:
    """Fit on (doc_id, text, lang): at most `per_lang` documents of each language, those with the least hash of id and text.

    Rows alike in id, text and language teach once, however many there are; a language with fewer than `per_lang` different rows
    is learned from all of them.  Rows without text, lang or doc_id teach nothing.  Without any, the model predicts `und` for every text.
    """
    families = FAMILIES if families is None else families
    rows = labelled.where("text is not null and lang is not null and doc_id is not null")
    keyed = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 32))
    counts = {r[0]: max(1, r[1]) for r in keyed.groupBy("lang").agg(F.approx_count_distinct("_h")).collect()}
    if not counts:
        return {"langs": [], "family": {}, "heads": {}, "pairs": {}}
    # a threshold on the hash first, so that no more than about three times the sample is ever sorted; it is far above the
    # share needed, so that it leaves too few with no probability that matters
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(3.0 * max(per_lang, 100) / n, 1.0) * 2**32) + 1))])
    few = keyed.where(F.col("_h") < limit[F.col("lang")]).groupBy("lang", "_h", "doc_id").agg(F.min("text").alias("text"))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))).where(F.col("_r") <= per_lang)
    got = few.orderBy("lang", "_r").select("lang", "text").mapInArrow(_to_vectors, "lang string, at binary, x binary").toArrow()
    x = np.zeros((got.num_rows, DIM + 1), np.float32)  # at most three pieces for each sampled document
    for i, (at, v) in enumerate(zip(got["at"].to_pylist(), got["x"].to_pylist(), strict=True)):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
    use = np.flatnonzero(x.any(1))
    x[:, DIM] = 1
    y = np.array(got["lang"].to_pylist(), object)
    langs = sorted(set(y[use].tolist()))
    fam = {a: families.get(a, a) for a in langs}
    f = np.array([fam.get(a, "") for a in y], object)
    names = sorted(set(fam.values()))
    sign = lambda mine: np.where(mine, 1.0, -1.0).astype(np.float32)
    if len(names) == 2:  # the second machine is the first one's mirror image
        w = _svm(x[use], sign(f[use] == names[0]))
        heads = {names[0]: w, names[1]: -w}
    else:
        heads = {n: _svm(x[use], sign(f[use] == n)) if len(names) > 1 else None for n in names}
    pairs = {}
    for a, b in combinations(langs, 2):
        if fam[a] == fam[b]:
            two = use[(y[use] == a) | (y[use] == b)]
            pairs[a, b] = _svm(x[two], sign(y[two] == a))
    del x, got
    give_back()
    return {"langs": langs, "family": fam, "heads": heads, "pairs": pairs}


def predict(model: dict, texts) -> tuple[list[str], np.ndarray]:
    """The language and a score from 0 to 1 of each text; `und` and 0 for null or without a letter."""
    n = len(texts)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model["langs"] or not n:
        return ["und"] * n, np.zeros(n)
    x = _features(texts)
    names = sorted(model["heads"])
    if len(names) > 1:
        s = np.stack([x @ model["heads"][k][:-1] + model["heads"][k][-1] for k in names], 1)
        best = s.argmax(1)
        top = np.sort(s, 1)
        margin = top[:, -1] - top[:, -2]
    else:
        best, margin = np.zeros(n, int), np.full(n, np.inf)
    out = np.empty(n, object)
    for i, name in enumerate(names):
        rows = np.flatnonzero(best == i)
        langs = [a for a in model["langs"] if model["family"][a] == name]
        votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
        for (a, b), w in model["pairs"].items():
            if model["family"][a] == name:
                d = x[rows] @ w[:-1] + w[-1]
                ia, ib = langs.index(a), langs.index(b)
                votes[:, ia] += d >= 0
                votes[:, ib] += d < 0
                sums[:, ia] += d
                sums[:, ib] -= d
        order = np.lexsort((-sums, -votes), axis=1)[:, 0] if len(langs) > 1 else np.zeros(len(rows), int)
        out[rows] = np.array(langs, object)[order]
        if len(langs) > 1 and len(rows):
            margin[rows] = np.minimum(margin[rows], np.maximum(sums[np.arange(len(rows)), order] / (len(langs) - 1), 0))
    score = 1 / (1 + np.exp(-2 * np.minimum(margin, 30)))
    out[~lettered] = "und"
    return out.tolist(), np.where(lettered, score, 0.0)


def identify(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with lang_pred and score for every row; only the text is used to predict.

    Null text and text without letters, the empty one too: `und` with score 0.  Equal texts get equal results.
    Columns of docs beyond `carry` are not read; one that is called lang_pred or score gives way to the prediction.
    """
    carry = tuple(c for c in carry if c not in ("lang_pred", "score"))
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = list(dict.fromkeys([*carry, "text"]))

    def run(batches):
        for t in text_slices(batches, most=1 << 20):
            for at in range(0, t.num_rows, 256):
                part = t.slice(at, 256).combine_chunks()
                lang, score = predict(model, part["text"].combine_chunks())
                cols = [part[c].combine_chunks() for c in carry] + [pa.array(lang, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, "lang_pred", "score"])

    return only(docs, *names).mapInArrow(run, schema)


def held_out():
    """Whether a document is kept from training: CRC-32 of its id as text is a multiple of 5 (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
