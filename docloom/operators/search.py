"""Filtered top-k search: cosine, BM25, rank fusion, and scans of sections and tables.

Queries come as a DataFrame, so many are answered at once; every ranking breaks ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vector

FETCH_TIMES, FETCH_EXTRA, PREFETCH_LEAST = 3, 10, 20
REFERENCE_PENALTY = 0.4
BROADCAST_ROWS = 10_000
SECTION_LIMIT, TABLE_LIMIT = 20, 8
# Columns of a result, with the value of those that a chunk lacks.
RESULT = {
    "score": None, "semantic_score": None, "keyword_score": 0.0, "chunk_id": None, "file_id": None, "doc_type": None, "root": None, "path": None,
    "url": None, "title": None, "file_name": None, "breadcrumbs": [], "section_heading": None, "section_level": 1, "section_depth": 1,
    "breadcrumb_levels": [], "section_id": None, "section_ancestors": [], "section_titles": [], "section_depths": [], "section_numbers": [],
    "section_title_clean": None, "section_number": "", "raw_heading": None, "chunk_type": "text", "context_header": None, "char_count": 0,
    "text": None, "caption": None, "table_number": None, "asset_id": None, "asset_path": None, "headers": None, "row_count": None,
}
_RESULT_TYPES = {"score": "double", "semantic_score": "double", "breadcrumbs": "array<string>", "breadcrumb_levels": "array<int>", "section_ancestors": "array<string>",
                 "section_titles": "array<string>", "section_depths": "array<int>", "section_numbers": "array<string>", "headers": "array<string>", "row_count": "int"}


def fetch_sizes(k: int) -> tuple[int, int]:
    """(rows kept after fusion, rows asked of each ranking) for a result of k."""
    fetch = max(FETCH_TIMES * k, k + FETCH_EXTRA)
    return fetch, max(2 * fetch, PREFETCH_LEAST)


def in_scope(root: str | None = None, paths: list[str] | None = None) -> Column:
    """Filter on the partition column root and on path; None or empty does not filter."""
    condition = F.lit(True) if root is None else F.col("root") == root
    wanted = list(dict.fromkeys(p for p in paths or [] if p))
    return condition & F.col("path").isin(wanted) if wanted else condition


def dense_topk(points: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "dense", where: Column | None = None) -> DataFrame:
    """The k nearest rows of points by cosine, with semantic_score; filtered before ranking, never sorted as a whole."""
    rows = points if where is None else points.where(where)
    scored = rows.withColumn("semantic_score", F.round(vector.cosine(F.col(vector_col), F.lit(query)), 6))
    return scored.where("semantic_score IS NOT NULL").orderBy(F.desc("semantic_score"), id_col).limit(k)


def checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dense_topk_batch(points: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "dense") -> DataFrame:
    """query_id, id, semantic_score, rank for a stated set of queries (query_id, query_vector).

    The queries are sent to every task, if they are few; each keeps k rows for a query before the shuffle.  Lengths
    are computed once for each vector."""
    asked = queries.select("query_id", F.col("query_vector").alias("_q"), vector.norm(F.col("query_vector")).alias("_m"))
    own = points.select(id_col, F.col(vector_col).alias("_v"), vector.norm(F.col(vector_col)).alias("_n"))
    size = F.col("_n") * F.col("_m")
    scored = own.crossJoin(checked(asked)).select("query_id", id_col, F.round(F.when(size > 0, vector.dot(F.col("_v"), F.col("_q")) / size), 6).alias("semantic_score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("semantic_score"), id_col))
    return scored.where("semantic_score IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k)


def _let(value: Column, f) -> Column:
    """f of value, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def counted(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words, null for none: runs of equal words after sorting, within the row."""

    def of(s):
        size = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda a: F.transform(a, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(a, k + 1), size) - p).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, _let(F.array_sort(words), of))


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores if they lie in fewer parts than there are cores (as in one small file); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def postings(rows: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """(term, id, tf, length): one row for each different term of a row, counted without a shuffle."""
    words = spread(rows.select(id_col, *others, F.col(text_col).alias("_text"))).select(id_col, *others, X.terms(F.col("_text")).alias("w"))
    # explode_outer: explode would add filters that read the words again
    each = words.select(id_col, *others, F.size("w").alias("length"), F.explode_outer(counted(F.col("w"))).alias("c"))
    return each.where("c IS NOT NULL").select(F.col("c.term").alias("term"), id_col, F.col("c.tf").alias("tf"), "length", *others)


def document_frequency(index: DataFrame, id_col: str) -> DataFrame:
    return index.groupBy("term").agg(F.count(id_col).alias("df"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))


def bm25(
    index: DataFrame, queries: DataFrame, total: int, id_col: str, k1: float = 1.2, b: float = 0.75, average_length: float = 256.0
) -> DataFrame:
    """query_id, id, score of every row that shares a term with a query (query_id, query).

    Only the postings of asked terms are kept, once for both readings of them: document frequencies and scores."""
    asked = asked_terms(queries)
    hits = index.join(checked(asked.select("term").distinct()), "term", "left_semi").persist()
    return _weighed(hits, asked, total, id_col, k1, b, average_length)


def _weighed(hits: DataFrame, asked: DataFrame, total: int, id_col: str, k1: float = 1.2, b: float = 0.75, average_length: float = 256.0) -> DataFrame:
    """query_id, id, score by the postings of asked terms alone."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average_length))
    each = checked(asked.join(df, "term"))
    return hits.join(each, "term").groupBy("query_id", id_col).agg(F.round(F.sum(idf * weight), 6).alias("score"))


def top_per_query(scored: DataFrame, k: int, id_col: str, score_col: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score_col), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def term_counts(rows: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, length, c): of every row the number of its terms, and those of the given ones that it has as array<struct<term, tf>>, null for none."""
    words = spread(rows.select(id_col, F.col(text_col).alias("_text"))).select(id_col, X.terms(F.col("_text")).alias("w"))
    return words.select(id_col, F.size("w").alias("length"), counted(F.filter("w", lambda w: w.isin(terms))).alias("c"))


def bm25_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """query_id, id, score, rank: the k best of rows for each query (query_id, query), as top_per_query of bm25 of their postings.

    The texts are read once, here, and of each row only asked terms are counted and kept; the k rows of a query come
    to the driver, so that what is done with them does not rank again.  Beyond BROADCAST_ROWS queries or terms, both
    are left to later and to all postings."""
    asked = asked_terms(queries)
    terms = [r["term"] for r in asked.select("term").distinct().limit(BROADCAST_ROWS + 1).collect()]
    if len(terms) > BROADCAST_ROWS or queries.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return top_per_query(bm25(postings(rows, id_col, text_col), queries, rows.count(), id_col), k, id_col)
    counts = term_counts(rows, terms, id_col, text_col).persist()
    total = counts.count()
    hits = counts.select(id_col, "length", F.explode("c").alias("c")).select("c.term", id_col, "c.tf", "length")
    best = top_per_query(_weighed(hits, asked, total, id_col), k, id_col)
    found = rows.sparkSession.createDataFrame(best.collect(), best.schema)
    counts.unpersist()
    return found


def fuse(rankings: list[DataFrame], id_col: str, rrf_k: int = 2, first_rank: int = 0) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank from 1): sum of 1 / (rrf_k + rank).

    semantic_score, where rankings have it, is kept; ids without one have 0."""
    score = lambda r: (F.col("semantic_score") if "semantic_score" in r.columns else F.lit(None).cast("double")).alias("semantic_score")
    ranked = None
    for r in rankings:
        part = r.select("query_id", id_col, "rank", score(r))
        ranked = part if ranked is None else ranked.unionByName(part)
    rrf = F.round(F.sum(1.0 / (rrf_k + F.col("rank") - 1 + first_rank)), 6)
    return ranked.groupBy("query_id", id_col).agg(rrf.alias("rrf"), F.coalesce(F.max("semantic_score"), F.lit(0.0)).alias("semantic_score"))


def hybrid(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Fused top k: query_id, id, rank, score, semantic_score.

    dense and sparse are rankings of one fetch each (dense with semantic_score); a hit outside the dense
    ranking has semantic_score 0.  Lists of references count for less, and equal scores keep the fused order.
    Of chunks (section_title_clean or section_heading, text) only those fused are looked into."""
    fetch, _ = fetch_sizes(k)
    fused = fuse([dense, sparse.select("query_id", id_col, "rank")], id_col)
    fused = fused.withColumn("fused_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), id_col))).where(F.col("fused_rank") <= fetch)
    heading = F.col("section_heading")
    if "section_title_clean" in chunks.columns:
        heading = X.or_default(F.col("section_title_clean"), heading)
    rows = fused.join(chunks.select(id_col, heading.alias("_heading"), F.col("text").alias("_text")), id_col, "left")
    is_reference = X.reference_like(F.col("_heading"), F.col("_text"))
    score = F.round(F.col("rrf") * F.when(is_reference, REFERENCE_PENALTY).otherwise(1.0), 6)
    rows = rows.select("query_id", id_col, score.alias("score"), "semantic_score", "fused_rank")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("fused_rank")


def results(rows: DataFrame, *others: str) -> DataFrame:
    """rows with the columns of RESULT, defaults where rows lack a column or it is null, and others."""
    given = {"breadcrumbs": "section_titles", "breadcrumb_levels": "section_depths"}  # derived columns

    def column(name: str, default):
        source = given.get(name, name)
        known = F.col(source) if source in rows.columns else F.lit(None)
        kind = _RESULT_TYPES.get(name)
        value = F.array() if default == [] else F.lit(default)
        filled = known if default is None else F.coalesce(known.cast(kind) if kind else known, value.cast(kind) if kind else value)
        return (filled.cast(kind) if kind else filled.cast("string") if source not in rows.columns and default is None else filled).alias(name)

    return rows.select(*others, *(column(n, d) for n, d in RESULT.items()))


def in_sections(section_ids: list[str], descendants: bool = True) -> Column:
    """Filter on sections, with those below them; none for no ids."""
    ids = list(dict.fromkeys(section_ids))
    if not ids:
        return F.lit(False)
    return F.arrays_overlap("section_ancestors", F.array(*map(F.lit, ids))) if descendants else F.col("section_id").isin(ids)


def section_scan(chunks: DataFrame, root: str, path: str, section_ids: list[str], limit: int = SECTION_LIMIT, descendants: bool = True) -> DataFrame:
    """Chunks of sections, with those below them, in document order."""
    return chunks.where(in_scope(root, [path]) & in_sections(section_ids, descendants)).orderBy("seq").limit(limit)


def table_scan(chunks: DataFrame, numbers: list[str], root: str | None = None, paths: list[str] | None = None, limit: int = TABLE_LIMIT) -> DataFrame:
    """Table stubs by the number of their caption, in document order."""
    wanted = list(dict.fromkeys(numbers))
    return chunks.where(in_scope(root, paths) & (F.col("chunk_type") == "table_stub") & F.col("table_number").isin(wanted)).orderBy("path", "seq").limit(limit)
