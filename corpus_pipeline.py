"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one; all but
the last return the columns of documents.  Every decision is about whole rows or whole spans; nothing is capped or sampled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from halyard.llm import langid, minhash, mixing, packing, secrets
from halyard.llm.common import stash, text_slices
from halyard.llm.queries import tokenizer_file


def language(spark, docs, sf_dir):
    """Documents without any letter (or text) are rejected; all others stay as they are, those too for which nothing was learned."""
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.identify(docs, model, tuple(docs.columns)).where(F.expr("lang_pred <> 'und'") | F.col("text").rlike(r"\p{L}")).select(docs.columns)


def _one_each(docs):
    """One row of each doc_id and text, the one whose further columns are least."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.groupBy("doc_id", F.sha2("text", 256).alias("_t")).agg(F.min(F.struct(*rest, "text")).alias("_row"))
    return rows.select("doc_id", "_row.*").select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group stays: the one with the smallest id, with each of its texts where an id has several.

    Of rows alike in id and text one stays (the least by the further columns); of rows without id, one for each text.
    """
    kept = minhash.near_duplicates(docs, size=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = _one_each(docs.where("doc_id is not null").join(kept, "doc_id", "left_semi"))
    return named.unionByName(_one_each(docs.where("doc_id is null"))).select(docs.columns)


def _redact(names):
    def run(batches):
        for t in text_slices(batches):
            texts = t["text"].to_pylist()
            for i, spans in enumerate(t["spans"].to_pylist()):
                if spans:
                    out, at = [], 0
                    for kind, a, b in (s.split(":") for s in spans.split(",")):
                        if int(b) > at:
                            out += [texts[i][at: max(at, int(a))], f"<{kind}>"] if int(a) >= at else []
                            at = int(b)
                    texts[i] = "".join([*out, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else t[c].combine_chunks() for c in names], names=names)
    return run


def secret_scan(spark, docs, sf_dir):
    """Every span found is replaced by the name of its kind; n_chars follows.  Documents without spans stay as they are."""
    names = docs.columns
    found = stash(secrets.scan(docs, carry_text=True), "scanned")  # read twice below
    clean = found.where("spans = ''").select(names)
    dirty = found.where("spans <> ''").select(*names, "spans").mapInArrow(_redact(names), docs.schema)
    return clean.unionByName(dirty.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(names))


def mixing_sources(spark, docs, sf_dir):
    """Documents are repeated as often as the mix takes them; those it doesn't take go.

    Rows are alike only in id, source and text together; such rows share out their repetitions, none is lost or added.
    """
    of = lambda c: F.coalesce(F.sha2(c, 256), F.lit(""))
    keyed = docs.withColumn("_k", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), of("source"), of("text")), 256))
    taken = mixing.mix(keyed, cut=False, carry=("_k",)).groupBy("_k").agg(F.sum("repeats").alias("_sum"), F.count("*").alias("_rows")).where("_sum > 0")
    alike = Window.partitionBy("_k").orderBy(*[c for c in docs.columns if c not in ("doc_id", "source", "text")], "_k")
    rows = keyed.withColumn("_n", F.row_number().over(alike)).join(taken, "_k")
    times = F.expr("cast(_sum div _rows + if(_n <= _sum % _rows, 1, 0) as int)")
    return rows.withColumn("_r", times).where("_r > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), "_r"))).select(docs.columns)


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of all documents, each with its sequence and its place there."""
    return packing.pack(packing.pieces(docs, tokenizer_file()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # learned, hashed and planned decisions; tests compare each stage with a brute-force version


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
