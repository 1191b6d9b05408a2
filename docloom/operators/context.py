"""From hits to the bounded rows a prompt is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X

from . import markdown

CAP, CAP_LEAST, PER_DOC_LEAST, FEW_DOCS = 24, 6, 4, 3
PER_SECTION, EXPANDED = 4, 16
GRADE_AT = 0.5


def ordered_union(branches: list[DataFrame], key: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows of the branches one after the other, each key once at its first place; rows without a key all stay."""
    rows = None
    for i, branch in enumerate(branches):
        part = branch.withColumns({"_branch": F.lit(i), "_order": F.col(order).cast("double")})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy(key).orderBy("_branch", "_order"))
    kept = rows.withColumn("_first", first).where((F.col("_first") == 1) | F.col(key).isNull()).drop("_first")
    kept = kept.orderBy("_branch", "_order", key)
    return (kept if limit is None else kept.limit(limit)).drop("_branch", "_order")


def document_budget(documents: Column, top_k: int) -> Column:
    """Rows each focused document may give of its sections; beyond FEW_DOCS documents room is kept for top_k other rows."""
    cap = F.when(documents > FEW_DOCS, F.lit(max(CAP - top_k, CAP_LEAST))).otherwise(CAP)
    return F.greatest(F.lit(PER_DOC_LEAST), F.floor(cap / F.least(documents, F.lit(FEW_DOCS)))).cast("int")


def budgeted(rows: DataFrame, top_k: int, of: str = "root", limit: int = CAP) -> DataFrame:
    """Of each set `of`: rows (path, seq, chunk_id) of its first FEW_DOCS paths in document order, each document
    within its budget, limit in all; n is their place in the set."""
    paths = rows.groupBy(of, "path").agg(F.lit(1).alias("_one"))
    documents = paths.groupBy(of).agg(F.count("*").alias("_documents"))
    focus = paths.withColumn("_doc", F.row_number().over(W.partitionBy(of).orderBy("path"))).where(F.col("_doc") <= FEW_DOCS).join(documents, of)
    place = F.row_number().over(W.partitionBy(of, "path").orderBy("seq", "chunk_id"))
    kept = rows.join(focus.drop("_one"), [of, "path"]).withColumn("_place", place).where(F.col("_place") <= limit)
    kept = kept.where(F.col("_place") <= document_budget(F.col("_documents"), top_k))
    kept = kept.withColumn("n", F.row_number().over(W.partitionBy(of).orderBy("_doc", "_place")))
    return kept.where(F.col("n") <= limit).drop("_doc", "_place", "_documents")


def expand(hits: DataFrame, chunks: DataFrame, per_section: int = PER_SECTION, limit: int = EXPANDED, of: str | None = None) -> DataFrame:
    """ord, chunk_id, rank, near: hits (chunk_id, rank, root, path, section_id) by rank, each followed by those of the
    first per_section + 1 chunks of its section that do not stand there yet, per_section of them at most.

    A hit that already stands there is passed over with its section.  near is 0 for a hit, else the place in the section.
    of: column of the question that hits belong to; each question has its own limit."""
    keys = ["root", "path", "section_id"]
    of_ = of or "_question"
    hits = hits if of else hits.withColumn(of_, F.lit(1))
    asked = hits.groupBy(of_, "chunk_id").agg(F.min_by(F.struct("rank", *keys), "rank").alias("h")).select(of_, "chunk_id", "h.*")
    asked = asked.withColumn("_at", F.row_number().over(W.partitionBy(of_).orderBy("rank", "chunk_id"))).where(F.col("_at") <= limit).drop("_at")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("seq", "chunk_id"))
    beside = chunks.join(asked.select(*keys).distinct(), keys, "left_semi").select(*keys, "chunk_id", place.alias("near")).where(F.col("near") <= per_section + 1)
    beside = beside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("near", "chunk_id"))).alias("beside"))
    nothing = F.array().cast("array<struct<near:int,chunk_id:string>>")
    # at most limit hits with per_section + 1 chunks each come together here
    row = asked.join(beside, keys, "left").groupBy(of_).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("beside", nothing).alias("beside")))).alias("hits"))
    known = lambda out, c: F.exists(out, lambda o: o["chunk_id"] == c)
    entry = lambda c, rank, near: F.struct(c.alias("chunk_id"), rank.alias("rank"), near.alias("near"))

    def step(out, h):
        new = F.filter(h["beside"], lambda s: (s["chunk_id"] != h["chunk_id"]) & ~known(out, s["chunk_id"]))
        more = F.transform(F.slice(new, 1, per_section), lambda s: entry(s["chunk_id"], h["rank"].cast("int"), s["near"]))
        longer = F.concat(out, F.array(entry(h["chunk_id"], h["rank"].cast("int"), F.lit(0))), more)
        return F.when(known(out, h["chunk_id"]), out).otherwise(F.slice(longer, 1, limit))

    start = F.array().cast("array<struct<chunk_id:string,rank:int,near:int>>")
    return row.select(of_, F.posexplode(F.aggregate("hits", start, step)).alias("at", "c")).select(*([of] if of else []), (F.col("at") + 1).alias("ord"), "c.*")


def hydrate_tables(stubs: DataFrame, tables: DataFrame, max_rows: int = 40, max_chars: int = 6000) -> DataFrame:
    """Table stubs with the rows of their table below the text; others, and stubs without rows, as they are."""
    whole = tables.select(F.col("table_id").alias("asset_id"), F.col("rows").alias("_rows"))
    joined = stubs.join(whole, "asset_id", "left")
    full = (F.col("chunk_type") == "table_stub") & (F.coalesce(F.size("_rows"), F.lit(0)) > 0)
    text = F.when(full, F.concat("text", F.lit("\n\n"), markdown.truncated_table(F.col("_rows"), max_rows, max_chars, F.col("asset_id")))).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("_rows")


def hydrate_images(stubs: DataFrame, assets: DataFrame) -> DataFrame:
    """Image stubs with image_path, width and height of their asset: by id, else by path; unresolved ones stay."""
    known = assets.select("asset_id", "image_path", "width", "height") if "asset_id" in assets.columns else assets.select(F.lit(None).cast("string").alias("asset_id"), "image_path", "width", "height")
    by_id = known.where("asset_id IS NOT NULL").select("asset_id", *(F.col(c).alias(f"_{c}") for c in ("image_path", "width", "height")))
    by_path = known.select(F.col("image_path").alias("asset_path"), *(F.col(c).alias(f"_p_{c}") for c in ("image_path", "width", "height"))).dropDuplicates(["asset_path"])
    joined = stubs.join(by_id, "asset_id", "left") if "asset_id" in stubs.columns else stubs.withColumns({f"_{c}": F.lit(None) for c in ("image_path", "width", "height")})
    joined = joined.join(by_path, "asset_path", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", f"_p_{c}") for c in ("image_path", "width", "height")}).drop(*(f"{p}{c}" for p in ("_", "_p_") for c in ("image_path", "width", "height")))


def locked_and_open(rows: DataFrame, locked_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that were asked for by name, and the others, which alone are graded."""
    locked = F.coalesce(F.col("chunk_id").isin(locked_ids), F.lit(False)) if locked_ids else F.lit(False)
    return rows.where(locked), rows.where(~locked)


def grade_gate(rows: DataFrame) -> DataFrame:
    """One row, skip: whether the best of the rows needs no grading; semantic_score, or score where that is 0."""
    return rows.agg(F.coalesce(F.max(F.coalesce(F.nullif("semantic_score", F.lit(0.0)), "score")) >= GRADE_AT, F.lit(False)).alias("skip"))


def format_context(rows: DataFrame, order: str = "rank", of: str | None = None) -> DataFrame:
    """Numbered blocks (n, block) of the rows of one prompt, or of one for each value of the column of: title, url, section_heading, score, text, and where there
    are such columns section_title_clean (before the heading) and section_titles."""
    numbered = rows.withColumn("n", F.row_number().over(W.partitionBy(*([of] if of else [])).orderBy(order)))
    section = F.col("section_heading")
    if "section_title_clean" in rows.columns:
        section = X.or_default(F.col("section_title_clean"), section)
    crumbs = F.col("section_titles") if "section_titles" in rows.columns else F.array().cast("array<string>")
    block = X.context_block(F.col("n"), F.col("title"), F.col("url"), section, crumbs, F.col("score"), F.col("text"))
    return numbered.select(*([of] if of else []), "n", block.alias("block"))
