"""Document cards: what a document holds, without reading it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_CHARS, SINGLE_PASS_CHARS, CARD_CHARS, KEYWORDS = 6000, 14000, 14000, 15


def list_sources(chunks: DataFrame) -> DataFrame:
    """One row for each document, attributes of its first chunk."""
    return chunks.groupBy("root", "path").agg(F.min_by("title", "seq").alias("title"), F.min_by("doc_type", "seq").alias("doc_type"), F.count("*").alias("chunks"))


def structural_cards(chunks: DataFrame, summarised: DataFrame | None = None) -> DataFrame:
    """Tables and images of each document in order, with counts; stale if a summary is of another content.

    summarised: root, path, file_hash; hashes are of the texts in order."""
    ordered = lambda kind, *fields: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("chunk_type") == kind, F.struct("seq", *fields)))), lambda s: F.struct(*(s[f] for f in fields))
    )
    cards = chunks.groupBy("root", "path").agg(
        F.min_by("title", "seq").alias("title"),
        ordered("table_stub", "asset_id", "caption", "table_number", "row_count", "section_id").alias("tables"),
        ordered("image_stub", "asset_id", "asset_path", "caption").alias("images"),
        F.count_if(F.col("chunk_type") == "text").alias("text_chunks"),
        F.sum("char_count").alias("chars"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n\n"), 256).alias("file_hash"),
    )
    if summarised is None:
        return cards.withColumn("stale", F.lit(True))
    old = summarised.select("root", "path", F.col("file_hash").alias("_old"))
    return cards.join(old, ["root", "path"], "left").withColumn("stale", ~F.coalesce(F.col("_old") == F.col("file_hash"), F.lit(False))).drop("_old")


def joined_text(chunks: DataFrame) -> DataFrame:
    """Texts of each document in order, parted by empty lines."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    return chunks.groupBy("root", "path").agg(F.array_join(texts, "\n\n").alias("text"))


def greedy_groups(texts: Column, most: int = GROUP_CHARS) -> Column:
    """Consecutive texts of an array in groups of at most `most` characters; a longer text stands alone."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))
    closed = lambda s: F.when(F.size(s["open"]) == 0, s["out"]).otherwise(F.concat(s["out"], F.array(s["open"])))

    def step(s, t):
        fits = (F.size(s["open"]) > 0) & (s["size"] + F.length(t) <= most)
        return F.when(fits, F.struct(s["out"].alias("out"), F.concat(s["open"], F.array(t)).alias("open"), (s["size"] + F.length(t)).alias("size"))).otherwise(
            F.struct(closed(s).alias("out"), F.array(t).alias("open"), F.length(t).alias("size"))
        )

    return F.aggregate(texts, start, step, closed)


def summarise(texts: list[str], generate, single_pass: int = SINGLE_PASS_CHARS, most: int = GROUP_CHARS) -> str:
    """One call of generate for a short document, else one for each group and one over their results."""
    whole = "\n\n".join(texts)
    if len(whole) <= single_pass:
        return generate("single", whole)
    groups: list[list[str]] = []
    for t in texts:
        if groups and sum(map(len, groups[-1])) + len(t) <= most:
            groups[-1].append(t)
        else:
            groups.append([t])
    return generate("reduce", "\n\n".join(generate("map", "\n\n".join(g)) for g in groups))
