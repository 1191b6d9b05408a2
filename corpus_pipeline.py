"""Corpus preparation as a chain of stages over the documents.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and gives a
DataFrame; all but the last give the columns of documents.  run() applies them in turn, each written to
the shared folder before the next reads it.

In every stage null texts count as empty ones, texts of any length are taken whole, rows without a doc_id are kept
and treated like others, an empty table stays empty, and columns beyond those of documents are handed on, whatever
their names; only the last stage returns columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, pii, simhash, toxicity
from docloom.llm.common import bound_batches, materialize, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the random field scores 0.7 or more go; it learns outside the held-out third of the labels.

    Repeated rows are scored one by one; with labels of one class
    alone every score is the smoothed share of toxic ones among them."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    It is the one of the least doc_id (null last), of equal ids that of the least hash of the text; rows alike in both
    count as one.  Empty texts are copies of each other."""
    return simhash.drop_near_copies(docs)


def mask_personal_data(spark, docs, sf_dir):
    """Personal data in the texts becomes the name of its kind; n_chars follows the text, null for a null text.

    Where spans overlap their union is replaced, named by the first."""
    bound_batches(spark)
    masked = docs.withColumn("text", pii.masked_column(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark, docs, sf_dir):
    """Rarer sources are repeated up to the mixture's weights; every document stays at least once.

    Rows without a source are a source of their own; ties in the order of a source are broken by a hash of id and text."""
    return mixing.mix_sources(docs)[0].select(*docs.columns)


def encode_tokens(spark, docs, sf_dir):
    """Token ids of the texts (packed), and whether they decode to the same bytes.

    Rows stay one by one; other columns than doc_id, lang, source are left out here."""
    bound_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = docs.select(
        "doc_id",
        "lang",
        "source",
        "text",
        bpe.round_trip_column(F.coalesce("text", F.lit("")), path, public_tokenizers.PATTERN).alias("made"),
    )
    return made.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("made.token_ids") / 4).cast("long").alias("n_tokens"),
        F.col("made.token_ids").alias("token_ids"),
        (F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("made.decoded")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The random field and the byte pairs have no counterpart in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
