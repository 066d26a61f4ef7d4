"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate({k: k + 32 for k in range(65, 91)}) if lower else text)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(docs, size, percent):
    """{doc_id: (n_shingles, component_id)} of documents with distinct ids."""
    sets = {}
    for i, t in docs:
        w = words(t, True)
        sets[i] = {tuple(w[k: k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    shared = Counter()
    lists = {}
    for i, s in sets.items():
        for g in s:
            for j in lists.setdefault(g, []):
                shared[j, i] += 1
            lists[g].append(i)
    u = Sets()
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def without_windows(items, size, first, own, later):
    """Which items windows cover whose first place `first` precedes the window's own."""
    gone = [False] * len(items)
    for k in range(len(items) - size + 1):
        if later(first[tuple(items[k: k + size])], (own, k)):
            gone[k: k + size] = [True] * size
    return gone


def cut_words(rows, size):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k: k + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w) if i is None else without_windows(w, size, first, i, lambda f, o: f < o[0])
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def cut_bytes(rows, size):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - size + 1):
                g = tuple(b[k: k + size])
                first[g] = min(first.get(g, (i, k)), (i, k))
    out = []
    for i, b in raw:
        gone = [False] * len(b) if i is None else without_windows(b, size, first, i, lambda f, o: f < o)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


SECRETS = {"assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
           "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return "".join(c for c in m[0] if c in "0123456789")


PRIVATE = {"email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
           "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
           "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
           "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15)}


def spans(text, rules):
    kinds = list(rules)
    out = [(k, *m.span()) for k, (rule, ok) in rules.items() for m in rule.finditer(text or "") if ok(m)]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def said(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)
