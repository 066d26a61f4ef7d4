"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is a text, addressed by its SHA-256.  The ledger holds one row for each blob and rule version that has
been scanned, found or not, with its findings.  A scan takes the blobs of all versions of all documents, leaves
out the pairs that the ledger has, scans the rest once, appends them, and joins the findings back to every
path (document version) that holds the blob.  Blobs are told apart by their addresses, so that only texts with several
paths are shuffled; the others are scanned where they are read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, only, shared_dir, stash, text_slices

#: The base kinds in their order, and the kinds that this operator adds.
BASE = ("assign", "access", "hex")
ADDED = ("pem", "jwt", "github", "slack")
RULES = "2"

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_SLACK = re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")


def _jwt(text: str) -> list[tuple[str, int, int]]:
    """Three parts joined by dots, the first two from `eyJ` on, each with ten further characters at least; in linear time."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at, k = m.start(), 0
        while k < len(parts):
            head = parts[k].find("eyJ")
            if k + 2 < len(parts) and head >= 0 and len(parts[k]) - head >= 13 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 13 and len(parts[k + 2]) >= 10:
                end = at + sum(map(len, parts[k: k + 3])) + 2
                out.append(("jwt", at + head, end))
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text in code points, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += _jwt(text)
    for kind, sign, rule in (("pem", "-----BEGIN", _PEM), ("github", "gh", _GITHUB), ("slack", "xox", _SLACK)):
        if sign in text:
            out += [(kind, *m.span()) for m in rule.finditer(text)]
    rank = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


FOUND = "blob string, rules string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scan(batches):
    for t in text_slices(batches):
        rows = {k: [] for k in ("blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for blob, text in zip(t["blob"].to_pylist(), t["text"].to_pylist(), strict=True):
            found = find(text)
            base = [s for s in found if s[0] in BASE]
            rows["blob"].append(blob)
            rows["rules"].append(RULES)
            for k in BASE:
                rows[f"n_{k}"].append(sum(s[0] == k for s in base))
            rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            rows["spans"].append(written(found))
        yield pa.RecordBatch.from_pydict(rows)


def _picked(once, several, alone: bool):
    """Texts of blobs that have one path, or the others."""

    def run(batches):
        for b in batches:
            h = b["h"].to_numpy()
            more = in_bitmap(several.value, h)
            yield b.filter(pa.array(in_bitmap(once.value, h) & ~more if alone else more)).select(["blob", "text"])
    return run


def _picked_scan(once, several):
    """Texts of one path are picked and scanned by one worker: two operators would keep two of them for each core."""
    pick = _picked(once, several, True)
    return lambda batches: _scan(pick(batches))


def ledger_folder(spark) -> str:
    """The ledger of the cluster: it stays in the shared folder from run to run."""
    return f"{shared_dir(spark)}/halyard/secret-ledger"


def entries(spark, folder: str) -> DataFrame:
    """The ledger's rows of this rule version, one for each blob, also where overlapping runs have scanned it twice."""
    return spark.read.schema(FOUND).parquet(folder).where(F.col("rules") == RULES).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: str | None = None, carry_text: bool = True) -> DataFrame:
    """Findings for every row of docs(doc_id, text, ...): all its columns and those of the ledger's findings.

    `ledger` is the folder of the ledger, read if it exists and appended to (that of the shared folder if
    None).  `text` is left out of the result without `carry_text`.  Null and empty text: no findings.  Rows that repeat are paths of their own and get the same findings.
    Clashing names: columns of docs that are named like a finding are left out of the result.
    """
    spark = docs.sparkSession
    folder = ledger or ledger_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.sha2(text, 256)
    new = only(docs, "text").select(blob.alias("blob")).groupBy("blob").agg(F.count("*").alias("paths"))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(entries(spark, folder).select("blob"), "blob", "left_anti")
    new = stash(new, "unseen-blobs")
    if new.head(1):
        keyed = only(docs, "text").select(blob.alias("blob"), text.alias("text")).withColumn("h", F.xxhash64("blob"))
        once, several = (spark.sparkContext.broadcast(bitmap(new.where(p).select(F.xxhash64("blob").alias("h")), "h")) for p in ("paths = 1", "paths > 1"))
        copies = keyed.mapInArrow(_picked(once, several, False), "blob string, text string").groupBy("blob").agg(F.first("text").alias("text"))  # combined in each task before the shuffle
        found = keyed.mapInArrow(_picked_scan(once, several), FOUND).unionByName(copies.mapInArrow(_scan, FOUND))
        # the filters of fixed size let some others through
        found.join(new, "blob", "left_semi").write.mode("append").parquet(folder)
    elif not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], FOUND).write.mode("append").parquet(folder)
    found = entries(spark, folder)
    names = [c for c in docs.columns if c not in found.columns and (carry_text or c != "text")]
    paths = docs.select(*[F.col(f"`{c}`") for c in names], blob.alias("blob"))
    return paths.join(found, "blob")
