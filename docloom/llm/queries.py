"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, fingerprints, html_text, mixing, pii, quality, sharding, simhash, toxicity, webp
from .common import table


def held_out(folds: int, fold: int):
    """True for rows of the fold that labels are never learned from; rows without an id are in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)).alias("held_out")


def op1_simhash(spark, sf_dir):
    return simhash.simhash_clusters(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents")
    return bpe.encode_documents(documents, path, public_tokenizers.PATTERN, decode=True).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_sharding(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(3, 1),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        "toxic_tokens",
        F.to_json("toxic_spans").alias("spans"),
    )


def op5_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    mixed, name = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", *(F.col(name[k]).alias(k) for k in ("epoch", "tokens", "position")))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(5, 0), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted")
    )


def op8_webp(spark, sf_dir):
    return webp.store_texts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_html(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op10_pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(pii.count_of("spans", kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_webp": op8_webp,
    "op9_html": op9_html,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {"op3_sharding": sharding.ORACLE_SQL}
