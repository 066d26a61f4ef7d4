"""Personal data by a semi-Markov conditional random field beside fixed base rules.

The base rules' spans always stay.  The field scores whole spans: every run of up to MOST_TOKENS tokens is a candidate segment of
each type that it can be at all (an email has one @ or its spelling; the others have only digits and separators, an IP four
groups of digits, a card 12 to 19 digits, a phone number 7 to 15), whatever its boundaries.  Features of the whole span (its
digits, groups, check sum, separators, edges, the word before it) are looked up in one table of weights, and dynamic programming
over boundaries and types together picks the best segmentation, in which base spans are fixed and a token outside scores 0.
Spans that no type can be score nothing, so texts are only looked at where enough digits or an @ stand.  Everything takes time
linear in the text.  The weights maximise the conditional likelihood of sentences made from a seed.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_right
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import only, text_slices

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24

_ANY = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules' spans in code points, by start and then kind; every rule takes time linear in the text."""
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k: k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append(("ip", at, stop))
                at = stop + 1
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if m.end() - m.start() >= 9 and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- candidates and features of whole spans ------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_STRETCH = re.compile(r"[(+]*[0-9][0-9 .\-/()+]*")
_MARK = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_DOT_WORD = re.compile(r"[\[(] ?dot ?[\])]", re.I)
_CUES = {
    "email": frozenset({"email", "mail", "contact", "write", "reach"}),
    "ip": frozenset({"ip", "host", "address", "server", "from"}),
    "card": frozenset({"card", "visa", "mastercard", "credit", "payment"}),
    "phone": frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "cell"}),
}
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,6}$")
CHUNK = 4096  # starts of candidates that are looked at together

#: How many values each feature of a kind has; every value of every feature has a weight of its own.
FEATURES = {
    "email": (1, 2, 2, 2, 2, 4, 4, 3, 2, 2),
    "ip": (1, 2, 2, 2, 3, 3, 2, 2, 2),
    "card": (1, 2, 2, 2, 2, 7, 2, 2, 2, 2),
    "phone": (1, 2, 2, 4, 7, 2, 2, 3, 2, 2, 2, 2, 2),
}
_AT = {k: np.cumsum([0, *v])[:-1] + sum(sum(FEATURES[x]) for x in KINDS[: KINDS.index(k)]) for k, v in FEATURES.items()}
SIZE = sum(map(sum, FEATURES.values()))


def _rows(kind: str, columns) -> np.ndarray:
    """Places in the table of weights, a row for each candidate."""
    return np.stack([np.asarray(c, np.int64) + at for c, at in zip(np.broadcast_arrays(*columns), _AT[kind], strict=True)], 1)


def _cue(text: str, at: int) -> str:
    m = _WORD_BEFORE.search(text[max(0, at - 24): at])
    return m[1].lower() if m else ""


def _glued(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] in ".-+/@_")


def _numbers(text: str, lo: int, hi: int):
    """Candidates (kind, starts, ends, features) in a stretch of digits and separators; it has no letters, so a cue stands before it."""
    cuts = np.array([m.start() for m in _TOKEN.finditer(text, lo, hi)] + [hi])
    n = len(cuts) - 1
    char = np.frombuffer(text[lo:hi].encode("ascii"), np.uint8)
    head, long = char[cuts[:-1] - lo], np.diff(cuts)
    digit = (head >= 48) & (head <= 57)
    three = np.where(digit & (long <= 3), [int(text[a:b]) if b - a <= 3 and text[a].isdigit() else 0 for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], 0)
    sums = lambda x: np.append(0, np.cumsum(x))
    digits, groups, large, not4, short = sums(long * digit), sums(digit), sums(digit & ((long > 3) | (three > 255))), sums(digit & (long != 4)), sums(digit & (long == 1))
    space, dot, dash, slash, open_, close, plus = (sums(head == ord(c)) for c in " .-/()+")
    apart = ~digit
    triple = sums(apart & np.append(False, apart[:-1]) & np.append([False, False], apart[:-2])[:n])
    d = (char - 48).astype(np.int64)[(char >= 48) & (char <= 57)]
    twice = np.where(d > 4, 2 * d - 9, 2 * d)
    even = np.arange(len(d)) % 2 == 0
    check = np.stack([sums(np.where(even, d, twice)), sums(np.where(even, twice, d))])  # plain digits at even places, at odd ones
    last_group = np.maximum.accumulate(np.where(digit, np.arange(n), -1))
    word = _cue(text, lo)
    year = digit & (((long == 4) & np.isin(three, 0) & np.isin(head, (49, 50))) | ((long == 2) & np.isin(three, (19, 20))))
    begins = np.flatnonzero(digit | (head == ord("(")) | (head == ord("+")))
    ends_well = digit | (head == ord(")"))
    before = np.array([_glued(text, lo - 1)]) if n else np.zeros(0, bool)
    for at in range(0, len(begins), CHUNK):
        i, j = (x.ravel() for x in np.broadcast_arrays(begins[at: at + CHUNK, None], begins[at: at + CHUNK, None] + np.arange(1, MOST_TOKENS + 1)))
        i, j = i[j <= n], j[j <= n]
        nd = digits[j] - digits[i]
        ok = ends_well[j - 1] & (nd >= 4) & (nd <= 19)
        i, j, nd = i[ok], j[ok], nd[ok]
        ng = groups[j] - groups[i]
        first = groups[i] == 0  # nothing but separators between the cue and the span
        glued = np.where(i == 0, before[0], np.isin(head[np.maximum(i - 1, 0)], [ord(c) for c in ".-+/"]) | digit[np.maximum(i - 1, 0)])
        after = np.array([_glued(text, hi)])
        glued_after = np.where(j == n, after[0], np.isin(head[np.minimum(j, n - 1)], [ord(c) for c in ".-+/"]) | digit[np.minimum(j, n - 1)])
        # a mark that ends a sentence or a list glues nothing
        glued_after &= (j == n) | digit[np.minimum(j + 1, n - 1)] | digit[np.minimum(j, n - 1)]
        a, b = digits[i], digits[j]
        sound = np.where((b - 1) % 2 == 0, check[0][b] - check[0][a], check[1][b] - check[1][a]) % 10 == 0
        has = lambda c: c[j] - c[i]
        cues = lambda k: (first & (word in _CUES[k]), first & any(word in v for x, v in _CUES.items() if x != k))
        trip = has(triple) > 0
        odd = (has(open_) != has(close)) | (has(plus) > (head[i] == ord("+")))
        pick = np.flatnonzero((ng == 4) & digit[i] & digit[j - 1])
        if len(pick):
            f = [0, *cues("ip"), has(large) == 0, np.clip(np.abs(has(dot) - 3), 0, 2), np.clip(has(space), 0, 2), (has(dash) + has(slash) + has(open_)) > 0, glued, glued_after]
            yield "ip", cuts[i[pick]], cuts[j[pick]], _rows("ip", np.broadcast_arrays(*f))[pick]
        pick = np.flatnonzero((nd >= 12) & digit[i] & digit[j - 1])
        if len(pick):
            stop = last_group[j - 1]
            f = [0, *cues("card"), sound, (ng > 2) & (not4[stop] - not4[i] == 0), np.minimum(ng, 6), trip, odd | (has(open_) > 0), glued, glued_after]
            yield "card", cuts[i[pick]], cuts[j[pick]], _rows("card", np.broadcast_arrays(*f))[pick]
        pick = np.flatnonzero((nd >= 7) & (nd <= 15))
        if len(pick):
            f = [0, *cues("phone"), np.where(nd < 9, 0, np.where(nd <= 12, 1, np.where(nd == 13, 2, 3))), np.minimum(ng, 6), head[i] == ord("("), has(slash) > 0, np.minimum(has(dot), 2),
                 year[i], trip, odd, glued, glued_after]
            yield "phone", cuts[i[pick]], cuts[j[pick]], _rows("phone", np.broadcast_arrays(*f))[pick]


def _mails(text: str, mark: int, stop: int):
    """Candidates around one @ or its spelling at text[mark:stop]: every local part and every end of the domain within the bound."""
    ends, dots, seen = [], 0, stop
    for m in islice(_TOKEN.finditer(text, stop, min(len(text), stop + 120)), MOST_TOKENS):
        a, b = m.span()
        c = text[a]
        if a < seen:
            continue
        if m := _DOT_WORD.match(text, a):
            dots, seen = dots + 1, m.end()
        elif c == ".":
            dots += 1
        elif c.isascii() and c.isalnum():
            if dots and not (b < len(text) and text[b].isalnum()):
                ends.append((b, b - a if c.isalpha() else 0, dots))
        elif c not in " -":
            break
    if not ends:
        return
    starts = []
    for at in reversed([m.start() for m in _TOKEN.finditer(text, max(0, mark - 80), mark)][-MOST_TOKENS:]):
        c = text[at]
        if not (c in _LOCAL or (c == " " and at >= mark - 8)):
            break
        if c.isalnum() and not (at and text[at - 1].isalnum()):
            starts.append(at)
    if not starts:
        return
    spaces_left = np.array([text.count(" ", a, mark - (text[mark - 1] == " ")) for a in starts])
    from_ = stop + (text[stop: stop + 1] == " ")
    f_end = np.array([(0 if k == 0 else 1 if k < 2 else 2 if k <= 4 else 3, min(dots, 3), min(_loose(text, from_, b), 2)) for b, k, dots in ends])
    cue = np.array([_cue(text, a) for a in starts])
    mine = np.array([c in _CUES["email"] for c in cue])
    other = np.array([any(c in v for k, v in _CUES.items() if k != "email") for c in cue])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(starts)), np.arange(len(ends)), indexing="ij"))
    gap = (text[mark - 1] == " ") or from_ != stop
    before = np.array([a > 0 and (text[a - 1].isalnum() or text[a - 1] in _LOCAL or text[a - 1] in "/@") for a in starts])
    after = np.array([_glued(text, b) and (text[b].isalnum() or (b + 1 < len(text) and text[b + 1].isalnum())) for b, _, _ in ends])
    f = [0, mine[x], other[x], text[mark] != "@", gap, f_end[y, 0], np.minimum(f_end[y, 1], 3), f_end[y, 2], (spaces_left > 0)[x], before[x] | after[y]]
    yield "email", np.array(starts)[x], np.array([b for b, _, _ in ends])[y], _rows("email", np.broadcast_arrays(*f))


def _loose(text: str, a: int, b: int) -> int:
    """Spaces in a domain that don't stand beside a dot or its spelling."""
    return sum(c == " " and not (text[k - 1] in ".)]" or text[k + 1: k + 2] in (".", "(", "[") or text[k - 1] in "([") for k, c in enumerate(text[a:b], a))


def candidates(text: str, fixed: list[tuple[str, int, int]]):
    """(kinds, starts, ends, features) of all candidate segments of a text that touch no fixed span."""
    held = sorted((a, b) for _, a, b in fixed)
    begin, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    parts = []
    for m in _STRETCH.finditer(text):
        lo, hi = m.span()
        if hi - lo < 7:
            continue
        # a candidate touches no fixed span, so it lies between two of them
        k = max(0, bisect_right(begin, lo) - 1)
        while lo < hi:
            while k < len(begin) and reach[k] <= lo:
                k += 1
            free = hi if k == len(begin) else min(hi, begin[k])
            if free - lo >= 7:
                inside = text[lo:free].rstrip(" .-/(+")
                digits = sum(map(inside.count, "0123456789"))
                if digits >= 7 or (digits >= 4 and len(re.findall("[0-9]+", inside)) >= 4):
                    parts += _numbers(text, lo, lo + len(inside))
            lo = max(free, reach[k]) if k < len(begin) else hi
    for m in _MARK.finditer(text):
        k = bisect_right(begin, m.start()) - 1
        if m.start() and (k < 0 or reach[k] <= m.start()):
            parts += _mails(text, m.start(), m.end())
    if not parts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), ([], np.zeros(0, bool))
    kinds = np.concatenate([np.full(len(p[1]), KINDS.index(p[0])) for p in parts])
    lo, hi = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    free = np.ones(len(lo), bool)
    if held:
        k = np.searchsorted(begin, hi, "left") - 1
        free = (k < 0) | (np.array(reach)[np.maximum(k, 0)] <= lo)
    return kinds, lo, hi, ([p[3] for p in parts], free)


def scores(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[r].sum(1) for r in rows])


def segment(weights: np.ndarray, text: str, fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The best segmentation's entities: boundaries and types chosen jointly.

    A token outside scores 0, so segments that score no more are in no best segmentation and only the others are followed.
    """
    kinds, lo, hi, more = candidates(text, fixed)
    if not len(lo):
        return []
    rows, free = more
    s = scores(weights, rows)
    use = np.flatnonzero(free & (s > 1e-9))
    use = use[np.lexsort((kinds[use], lo[use], hi[use]))]
    ends = hi[use].tolist()
    best, back = [0.0], []
    for k, x in enumerate(use.tolist()):
        j = bisect_right(ends, int(lo[x]), 0, k)  # segments that end where this one starts, or before
        got = best[j] + float(s[x])
        back.append(j if got > best[k] + 1e-12 else -1)
        best.append(max(best[k], got))
    out, k = [], len(use)
    while k:
        if back[k - 1] >= 0:
            x = use[k - 1]
            out.append((KINDS[kinds[x]], int(lo[x]), int(hi[x])))
            k = back[k - 1]
        else:
            k -= 1
    return out[::-1]


# --- training ------------------------------------------------------------------------------------------------------


def _made(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with entities in forms that the base rules miss, and with numbers that are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = "4" + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((". ", "/", ".")).join(body[i: i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), (" [at] ", ".")))
            return kind, f"{w()}.{w()}{at}{w()}{dot}com"
        if kind == "ip":
            return kind, " . ".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        return kind, rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"))

    text, spans = "", []
    for _ in range(rng.randint(2, 5)):
        text += w() + " "
        r = rng.random()
        if r < 0.4:
            kind, e = entity()
            if kind == "phone" or rng.random() < 0.7:
                text += rng.choice(sorted(_CUES[kind])) + rng.choice((": ", " "))
            spans.append((kind, len(text), len(text) + len(e)))
            text += e + rng.choice((" ", " ", " ", ". ", ", ", f" {d(1)} ", f" {rng.randint(1900, 2030)} ", f", {d(2)} "))
        elif r < 0.9:
            text += rng.choice((d(16), d(8), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}", f"{d(3)}.{d(3)}", d(7), f"{d(2)}/{d(2)}/{d(4)}",
                                f"{d(3)}.{d(2)}.{d(1)}", f"{w()} @ {w()}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(5)} {d(5)}", d(10), f"{d(3)} {d(3)} {d(4)}")) + " "
        text += w() + rng.choice((". ", ", ", " "))
    return text, spans


@functools.lru_cache(maxsize=4)
def train(sentences: int = 500, epochs: int = 8, seed: int = 5) -> np.ndarray:
    """Weights that maximise the conditional log-likelihood (AdaGrad, L2), by forward and backward sums over all segmentations."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _made(rng)
        kinds, lo, hi, more = candidates(text, [])
        if not len(lo):
            continue
        places = np.unique(np.concatenate([lo, hi]))
        a, b = np.searchsorted(places, lo), np.searchsorted(places, hi)
        gold = set(spans)
        right = np.array([(KINDS[k], x, y) in gold for k, x, y in zip(kinds, lo.tolist(), hi.tolist(), strict=True)])
        by_end, by_start = ([np.flatnonzero(c == p) for p in range(len(places))] for c in (b, a))
        data.append((more[0], a, b, by_end, by_start, right, len(places)))
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-8)
    for _ in range(epochs):
        rng.shuffle(data)
        for rows, a, b, by_end, by_start, right, n in data:
            s = scores(w, rows)
            fore, back = np.zeros(n), np.zeros(n)
            for p in range(1, n):
                k = by_end[p]
                fore[p] = np.logaddexp.reduce(np.append(fore[a[k]] + s[k], fore[p - 1]))
            for p in range(n - 2, -1, -1):
                k = by_start[p]
                back[p] = np.logaddexp.reduce(np.append(back[b[k]] + s[k], back[p + 1]))
            off = right - np.exp(fore[a] + s + back[b] - fore[-1])
            grad, at = -0.002 * w, 0
            for r in rows:
                np.add.at(grad, r, off[at: at + len(r), None])
                at += len(r)
            seen += grad * grad
            w = w + 0.5 * grad / np.sqrt(seen)
    return w


def added_spans(weights: np.ndarray, text: str, fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the model adds beside the fixed ones."""
    return segment(weights, text, fixed)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), weights: np.ndarray | None = None) -> DataFrame:
    """The columns `carry` with n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of docs.

    Null and empty text: no spans.  Equal texts get equal spans.  A column of docs that is called like a result gives
    way to it; columns beyond `carry` are not read.
    """
    carry = tuple(c for c in carry if c not in FOUND)
    weights = train() if weights is None else weights
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
                          + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for t in text_slices(batches):
            rows = {n: [] for n in FOUND}
            for text in t["text"].to_pylist():
                base: list[tuple[str, int, int]] = []
                more: list[tuple[str, int, int]] = []
                if text and _ANY.search(text):
                    base = base_spans(text)
                    more = added_spans(weights, text, base)
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in carry] + [pa.array(rows[n], pa.int64() if n[:2] == "n_" else pa.string()) for n in FOUND], names=[*carry, *FOUND])

    return only(docs, *dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
