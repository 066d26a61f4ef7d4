"""The queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations


from . import blocks, langid, minhash, mixing, oracles, packing, pii, pq, secrets, suffix, webp
from .common import stash, table


def op1_mixing(spark, sf_dir):
    """The words that the mix takes of every document, by capped water-filling."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark, sf_dir):
    """The findings of every document; blobs that the cluster's ledger has are not scanned again."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op3_language(spark, sf_dir):
    """The language of every document, by machines fitted on the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op4_media(spark, sf_dir):
    """Every text stored as lossless WebP files in the shared folder, then decoded from there."""
    return webp.read_back(stash(webp.encode(table(spark, sf_dir, "documents")), "media"))


def op5_suffix(spark, sf_dir):
    """What repeats of 100 bytes leave of every document."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_pii(spark, sf_dir):
    """Personal data of every document: base rules and the field's added spans."""
    return pii.find(table(spark, sf_dir, "documents"))


def op7_pq(spark, sf_dir):
    """The links of every vector with a cosine of 0.98 or more within its label, and its component."""
    return pq.near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_minhash(spark, sf_dir):
    """The component of every document by three-word shingles and a similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_blocks(spark, sf_dir):
    """What repeats of 50 words leave of every document."""
    return blocks.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def tokenizer_file() -> str:
    """The default tokenizer; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir):
    """The pieces of every document, packed into sequences of 4096 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_file()))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_secrets, op3_language, op4_media, op5_suffix, op6_pii, op7_pq, op8_minhash, op9_blocks, op10_packing)}
ORACLE_SQL = {"op1_mixing": mixing.ORACLE, "op5_suffix": oracles.OP5, "op7_pq": oracles.OP7, "op8_minhash": oracles.OP8, "op9_blocks": oracles.OP9}
