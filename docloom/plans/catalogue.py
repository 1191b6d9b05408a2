"""Named queries over the test tables, each with the SQL that gives the same rows where SQL can.

The tables stand in for a folder of documents: source is the root, doc-<id>.md the path, lang a label.
Floats are rounded to six digits, ties broken by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import ids
from docloom.functions import text as X
from docloom.operators import assets, cards, chunking, context, evaluate, markdown, search, state, structure, sync
from docloom.sources import decoders
from docloom.streaming import changes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, sf_dir) -> DataFrame:
    """documents as files: root, path, and the columns of documents."""
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("root"), path.alias("path"), "doc_id", "text", "lang")


FILES = "SELECT source AS root, 'doc-' || CAST(doc_id AS VARCHAR) || '.md' AS path, doc_id, text, lang FROM documents"


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src3' AND lang IN ('en', 'de')")
def scan_filter_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnsRenamed({"source": "root", "lang": "path"})
    kept = docs.where(search.in_scope("src3", ["en", "de", "en"]))
    return kept.select("doc_id", F.col("root").alias("source"), F.col("path").alias("lang"), "n_chars")


@query(f"""
SELECT doc_id, sha256(text) AS content_hash, md5(root || chr(10) || path) AS file_id, md5(root || chr(10) || path) || ':1' AS chunk_id,
       substr(md5(root), 1, 8) || '_' || substr(md5(path), 1, 8) AS cache_key FROM ({FILES})""")
def content_hash_ids(spark, sf_dir):
    file = ids.file_id(F.col("root"), F.col("path"))
    return files(spark, sf_dir).select(
        "doc_id",
        ids.content_hash(F.col("text")).alias("content_hash"),
        file.alias("file_id"),
        ids.chunk_id(file, F.lit(1)).alias("chunk_id"),
        ids.short_key(F.col("root"), F.col("path")).alias("cache_key"),
    )


@query("""
SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, count(*) AS copies
FROM documents GROUP BY sha256(text)""")
def dedup_first_wins(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .groupBy(ids.content_hash(F.col("text")).alias("h"))
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"), F.min_by("lang", "doc_id").alias("lang"), F.count("*").alias("copies"))
        .drop("h")
    )


_TAGS = ("script", "style", "noscript", "nav", "footer", "header", "aside")
_STRIP = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in _TAGS)


@query(f"""
SELECT page_id, length(html) AS chars, length(t) AS kept, md5(t) AS hash
FROM (SELECT page_id, html, regexp_replace(html, '{_STRIP}', '', 'gis') AS t FROM pages)""")
def html_boilerplate_strip(spark, sf_dir):
    stripped = F.regexp_replace("html", "(?is)" + _STRIP, "")
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("chars"), F.length(stripped).cast("long").alias("kept"), F.md5(stripped).alias("hash"))


@query()
def html_to_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    blocks = decoders.blocks_of(F.lit(".html"), F.col("content"))
    return markdown.exploded(pages, blocks, "content").select("page_id", "pos", "type", "level", "text", "rows")


def _region_table(spark, sf_dir) -> DataFrame:
    """A pipe table of the nations of each region: r_regionkey, r_name, text."""
    nation = table(spark, sf_dir, "nation")
    line = F.format_string("| %d | %s |", "n_nationkey", "n_name")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda s: s["line"])
    text = F.concat(F.lit("| key | name |\n|---|:--|\n"), F.array_join(lines, "\n"))
    return nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(text.alias("text"))


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, pos, type, level, text, cells FROM (
  SELECT n_nationkey, 0 AS pos, 'heading' AS type, 2 AS level, n_name AS text, NULL AS cells FROM nation
  UNION ALL SELECT n_nationkey, 1, 'text', 0, 'Part of ' || r_name || '.', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_nationkey, 2, 'table', 0, NULL, 'key,name;' || n_nationkey || ',' || n_name FROM nation)""")
def markdown_blocks(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.format_string("## %s\r\n<!-- note -->\nPart of %s.  \n\n\n\n| key | name |\n|---|---|\n| %d | %s |", "n_name", "r_name", "n_nationkey", "n_name")
    rows = markdown.block_rows(nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), text.alias("text")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return rows.select("n_nationkey", "pos", "type", F.coalesce("level", F.lit(0)).alias("level"), "text", cells.alias("cells"))


@query("""
SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
       || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text, count(*) AS body_rows
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_parse_render(spark, sf_dir):
    rows = _region_table(spark, sf_dir).withColumn("rows", markdown.table_cells(F.col("text")))
    return rows.select("r_regionkey", markdown.table_markdown(F.col("rows")).alias("text"), (F.size("rows") - 1).cast("long").alias("body_rows"))


@query("""
SELECT md5('regions' || chr(10) || r_name || '.md') || '_x1_t0' AS asset_id,
       '[Table: ' || md5('regions' || chr(10) || r_name || '.md') || '_x1_t0]' || chr(10) || 'Caption: Table with columns: key, name. Rows: ' || count(*) || '.' || chr(10)
       || 'Columns: key, name' || chr(10) || 'Row entities: ' || string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) || chr(10)
       || 'Total rows: ' || count(*) AS stub, CAST(count(*) AS INTEGER) AS row_count
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def table_stub(spark, sf_dir):
    docs = _region_table(spark, sf_dir).select(
        F.lit("regions").alias("root"), F.concat("r_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "text").alias("text")
    )
    stubs = chunking.chunk_frame(docs).where("chunk_type = 'table_stub'")
    return stubs.select("asset_id", F.expr("substring(text, length(context_header) + 3)").alias("stub"), "row_count")


@query("SELECT n_regionkey AS r_regionkey, 1 AS blocks, CAST(count(*) + 1 AS INTEGER) AS rows FROM nation GROUP BY n_regionkey")
def page_break_merge(spark, sf_dir):
    """The table of each region, broken by a page number before each nation."""
    broken = F.regexp_replace("text", r"\n(\| \d)", "\n\n7\n\n| key | name |\n$1")
    blocks = markdown.blocks_of(broken)
    return _region_table(spark, sf_dir).select("r_regionkey", structure.on_blocks(blocks, structure.merge_page_breaks).alias("blocks")).select(
        "r_regionkey", F.size("blocks").alias("blocks"), F.size(F.col("blocks")[0]["rows"]).alias("rows")
    )


@query("""
SELECT r_regionkey, 1 AS blocks, 'Table ' || r_regionkey || ': nations of ' || r_name AS caption, CAST(r_regionkey AS VARCHAR) AS table_number FROM region""")
def caption_attach(spark, sf_dir):
    captioned = F.format_string("%s\n\nTable %d: nations of %s", "text", "r_regionkey", "r_name")
    blocks = structure.on_blocks(markdown.blocks_of(captioned), structure.attach_captions)
    rows = _region_table(spark, sf_dir).select("r_regionkey", blocks.alias("b"))
    return rows.select("r_regionkey", F.size("b").alias("blocks"), F.col("b")[0]["caption"].alias("caption"), F.col("b")[0]["table_number"].alias("table_number"))


def _numbered_chunks(spark, sf_dir) -> DataFrame:
    """One document: regions and nations as numbered headings, a line of text under each."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    tops = region.select(F.struct(F.col("r_regionkey").alias("a"), F.lit(-1).alias("b"), F.format_string("# %d %s\n\nRegion.", F.col("r_regionkey") + 1, "r_name").alias("t")).alias("s"))
    subs = nation.select(F.struct(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.format_string("## %d.%d %s\n\nNation.", F.col("n_regionkey") + 1, "n_nationkey", "n_name").alias("t")).alias("s"))
    whole = tops.union(subs).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("text"))
    return chunking.chunk_frame(whole.select(F.lit("atlas").alias("root"), F.lit("atlas.md").alias("path"), "text"))


_SECTIONS = """
SELECT 's' || (r_regionkey + 1) AS section_id, NULL AS parent_id, 1 AS depth, r_name AS title, CAST(r_regionkey + 1 AS VARCHAR) AS number, r_regionkey AS a, -1 AS b FROM region
UNION ALL
SELECT 's' || (n_regionkey + 1) || '.' || n_nationkey, 's' || (n_regionkey + 1), 2, n_name, (n_regionkey + 1) || '.' || n_nationkey, n_regionkey, n_nationkey FROM nation"""


@query(f"SELECT section_id, parent_id, depth, title, number, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS ord FROM ({_SECTIONS})")
def section_tree_ids(spark, sf_dir):
    return structure.outline(_numbered_chunks(spark, sf_dir)).select("section_id", "parent_id", "depth", "title", "number", "ord")


@query(f"""
SELECT 'atlas.md' AS path, string_agg(repeat('  ', depth - 1) || '- ' || number || ' ' || title, chr(10) ORDER BY a, b) AS outline FROM ({_SECTIONS})""")
def outline_flatten(spark, sf_dir):
    return structure.render_outline(structure.outline(_numbered_chunks(spark, sf_dir))).select("path", "outline")


#: Documents hold no empty lines, so each is one paragraph: whole up to 1800 characters, else cut.
_PIECES = """
SELECT doc_id, source, lang, k, CASE WHEN length(t) <= 1800 THEN t ELSE substr(t, 1800 * k + 1, 1800) END AS piece
FROM (SELECT doc_id, source, lang, trim(text, ' ') AS t FROM documents), range(0, 100000) AS r(k)
WHERE length(t) > 0 AND 1800 * k < length(t)"""


def _pieces(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    docs = files(spark, sf_dir)
    if of is not None:
        docs = docs.join(F.broadcast(of), ids.file_id(F.col("root"), F.col("path")) == F.col("file_id"), "left_semi")
    # posexplode would add a filter that cuts the texts again
    return search.spread(docs).select("root", "path", "doc_id", "lang", F.posexplode_outer(chunking.split_column(F.col("text"))).alias("k", "piece")).where("k IS NOT NULL")


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS k, piece FROM ({_PIECES})")
def split_text_chunks(spark, sf_dir):
    return _pieces(spark, sf_dir).select("doc_id", "k", "piece")


_CHUNKS = f"""
SELECT doc_id, md5(source || chr(10) || 'doc-' || doc_id || '.md') || ':' || (k + 1) AS chunk_id, source AS root, 'doc-' || doc_id || '.md' AS path,
       'doc-' || doc_id AS title, CAST(k + 1 AS INTEGER) AS seq, lang AS section_heading,
       '[Document: doc-' || doc_id || '.md | Section: ' || lang || ']' || chr(10) || chr(10) || piece AS text FROM ({_PIECES})"""


def _chunks(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """Chunk rows of the documents, without leaving the JVM; of: few file_id, beside which no text is cut."""
    seq = (F.col("k") + 1).cast("int")
    return _pieces(spark, sf_dir, of).select(
        "doc_id",
        ids.chunk_id(ids.file_id(F.col("root"), F.col("path")), seq).alias("chunk_id"),
        "root",
        "path",
        X.stem(F.col("path")).alias("title"),
        seq.alias("seq"),
        F.col("lang").alias("section_heading"),
        F.format_string("[Document: %s | Section: %s]\n\n%s", "path", "lang", "piece").alias("text"),
    )


@query(f"SELECT *, CAST(length(text) AS INTEGER) AS char_count FROM ({_CHUNKS})")
def chunk_records(spark, sf_dir):
    return _chunks(spark, sf_dir).withColumn("char_count", F.length("text"))


def _postings_sql(rows: str, key: str) -> str:
    return rf"""
SELECT term, {key}, count(*) AS tf, len AS length FROM (
  SELECT {key}, len(w) AS len, unnest(w) AS term FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {rows}))
GROUP BY term, {key}, len"""


_POSTINGS = _postings_sql("documents", "doc_id")


@query(f"SELECT term, doc_id, tf, CAST(length AS INTEGER) AS length FROM ({_POSTINGS})")
def postings(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term")
def doc_frequency(spark, sf_dir):
    return search.document_frequency(search.postings(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


_ASKED = [(1, "the thing that is of"), (2, "der die und lich"), (3, "que para los ment"), (4, "une dans les eau"), (5, "idiot clown moron stupid loser")]
_ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _ASKED) + ") AS q(query_id, query)"


def _bm25_sql(rows: str, key: str) -> str:
    postings = _postings_sql(rows, key)
    return rf"""
SELECT query_id, {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256.0))), 6) AS score
FROM ({postings}) JOIN (SELECT term, count(*) AS df FROM ({postings}) GROUP BY term) USING (term)
JOIN (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM {_ASKED_SQL}) USING (term),
(SELECT count(*) AS n FROM {rows}) GROUP BY query_id, {key}"""


def _ranked_sql(k: int, rows: str = "documents", key: str = "doc_id") -> str:
    return f"""
SELECT * FROM (SELECT query_id, {key}, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM ({_bm25_sql(rows, key)}))
WHERE rank <= {k}"""


def _bm25(spark, sf_dir, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame(_ASKED, "query_id int, query string")
    return search.bm25_topk(docs, asked, k, "doc_id", "text")


@query(_ranked_sql(10))
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


_FIRST = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6)"


def _first_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query(f"SELECT vec_id, label, {_COSINE} AS semantic_score FROM embeddings, {_FIRST} ORDER BY 3 DESC, 1 LIMIT 10")
def dense_topk(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return search.dense_topk(points, _first_vector(spark, sf_dir), 10, "vec_id", "embedding").drop("embedding")


@query(f"SELECT vec_id, label, {_COSINE} AS semantic_score FROM embeddings, {_FIRST} WHERE label IN (1, 3) ORDER BY 3 DESC, 1 LIMIT 10")
def dense_topk_filtered(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return search.dense_topk(points, _first_vector(spark, sf_dir), 10, "vec_id", "embedding", F.col("label").isin(1, 3)).drop("embedding")


#: One query for each label: its vector with the least id.
_LABEL_QUERIES = "(SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)"


def _dense_sql(k: int) -> str:
    return f"""
SELECT query_id, vec_id, semantic_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT query_id, vec_id, {_COSINE} AS semantic_score, row_number() OVER (PARTITION BY query_id ORDER BY {_COSINE} DESC, vec_id) AS rank
  FROM embeddings, {_LABEL_QUERIES}) WHERE rank <= {k}"""


def _dense(spark, sf_dir, k: int) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    asked = points.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    return search.dense_topk_batch(points, asked, k, "vec_id", "embedding")


@query(_dense_sql(5))
def dense_topk_per_group(spark, sf_dir):
    return _dense(spark, sf_dir, 5)


_REFERENCE = (
    "(coalesce(regexp_matches(lang, '(?i)\\b(references|bibliography|works\\s+cited|acknowledg|tài\\s+liệu\\s+tham\\s+khảo)'), false)"
    " OR (length(text) >= 200 AND len(regexp_extract_all(text, '(?i)(?:\\(?\\b(?:19|20)\\d{2}\\b\\)?|\\bet\\s+al\\b|https?://|\\bdoi\\b|\\bpp\\.\\s*\\d|\\bvol\\.\\s*\\d)'))"
    " / (length(text) / 500.0) >= 2.0))"
)


@query(f"""
WITH dense AS ({_dense_sql(30)}), sparse AS ({_ranked_sql(30)}),
fused AS (SELECT query_id, id, round(sum(1.0 / (1 + rank)), 6) AS rrf FROM (
  SELECT query_id, vec_id AS id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM sparse) GROUP BY query_id, id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS fr FROM fused) WHERE fr <= 15),
scored AS (SELECT k.query_id, k.id, fr, round(rrf * CASE WHEN r.is_ref THEN 0.4 ELSE 1.0 END, 6) AS score, coalesce(d.semantic_score, 0.0) AS semantic_score
  FROM kept k LEFT JOIN dense d ON d.query_id = k.query_id AND d.vec_id = k.id LEFT JOIN (SELECT doc_id, {_REFERENCE} AS is_ref FROM documents) r ON r.doc_id = k.id)
SELECT query_id, id, score, semantic_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr) AS rank FROM scored) WHERE rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    _, prefetch = search.fetch_sizes(5)
    dense = _dense(spark, sf_dir, prefetch).withColumnRenamed("vec_id", "id")
    sparse = _bm25(spark, sf_dir, prefetch).withColumnRenamed("doc_id", "id")
    told = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("section_heading"), "text")
    return search.hybrid(dense, sparse, told, 5)


@query(f"SELECT doc_id, {_REFERENCE} AS is_reference FROM documents")
def reference_penalty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.reference_like(F.col("lang"), F.col("text")).alias("is_reference"))


#: Headings and texts that tell the rules of lists of references apart.
_REFERENCE_CASES = [
    (1, "7 References", "short", True), (2, "Acknowledgements and References", "short", True), (3, "Selected bibliography", "x", True), (4, "Preferences", "x", False),
    (5, "Tài liệu tham khảo", "x", True), (6, "Results", "Smith et al 2019, doi 10. " * 12, True), (7, "Results", "[1] [2, 3] words and words. " * 12, False),
    (8, "Results", "See https://a.example/x and vol. 3, pp. 7. " * 8, True), (9, "Results", "et al 2020", False), (10, "Results", "In 1999 and 12345 words of other things went by. " * 5, True),
    (11, "Results", "A year, 2001. " + "Then a text that goes on for a while with no mark of any citation at all. " * 6, False),
]
_REFERENCE_CASES_SQL = ", ".join(f"({i}, {'true' if w else 'false'})" for i, _, _, w in _REFERENCE_CASES)


@query(f"SELECT * FROM (VALUES {_REFERENCE_CASES_SQL}) AS c(case_id, is_reference)")
def reference_cases(spark, sf_dir):
    """Headings and texts for which the rule is known."""
    rows = spark.createDataFrame([c[:3] for c in _REFERENCE_CASES], "case_id int, heading string, text string")
    return rows.select("case_id", X.reference_like(F.col("heading"), F.col("text")).alias("is_reference"))


#: What questions name: tables, sections, and whether they speak of sections; ids of cases, and the answers by the rules.
_NAMED_CASES = [
    (1, "See Table 3a and table A1, Table2.", "3a,3A,A1,a1,2", "", False), (2, "bang 4 or Bảng B.2", "4,B.2,b.2", "4", False), (3, "stable 4, table-5", "", "4", False),
    (4, "sections 3.2 and subsection B2", "", "3.2,B2", True), (5, "a cross-section of parts", "", "", False), (6, "第4章", "", "4", False),
    (7, "GPT-4 against model4", "", "", False), (8, "what is in 4.1, then 7?", "", "4.1,7", True), (9, "part two", "", "", False), (10, "chương 5", "", "5", True),
]
_NAMED_SQL = ", ".join(f"({i}, '{t}', '{n}', {'true' if c else 'false'})" for i, _, t, n, c in _NAMED_CASES)


@query(f"SELECT * FROM (VALUES {_NAMED_SQL}) AS c(case_id, tables, sections, cue)")
def named_in_questions(spark, sf_dir):
    rows = spark.createDataFrame([c[:2] for c in _NAMED_CASES], "case_id int, q string")
    return rows.select(
        "case_id", F.array_join(X.table_references(F.col("q")), ",").alias("tables"), F.array_join(X.section_references(F.col("q")), ",").alias("sections"), X.section_cue(F.col("q")).alias("cue")
    )


#: Pages as chunks: the site is the path, each folder of a URL an ancestor of what is below it.
_PAGE_CHUNKS = r"""
SELECT page_id, url, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS path,
  list_slice(string_split(regexp_replace(url, '^https?://[^/]*/?', ''), '/'), 1, -2) AS folders FROM pages"""


def _page_chunks(spark, sf_dir) -> DataFrame:
    parts = F.split(F.regexp_replace("url", r"^https?://[^/]*/?", ""), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.lit("web").alias("root"), F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)).alias("path"),
        F.col("page_id").alias("seq"), F.coalesce(F.element_at(folders, -1), F.lit("s0")).alias("section_id"), folders.alias("section_ancestors"),
    )


@query(f"SELECT page_id, url FROM ({_PAGE_CHUNKS}) WHERE list_has_any(folders, ['en', 'fr'])")
def section_subtree_scan(spark, sf_dir):
    """Pages below folders en and fr, at any depth: each folder of a URL is an ancestor."""
    pages = _page_chunks(spark, sf_dir)
    return pages.where(search.in_sections(["en", "fr", "en"])).select("page_id", "url")


@query(f"""
SELECT page_id, url FROM ({_PAGE_CHUNKS}) WHERE path = (SELECT min(path) FROM ({_PAGE_CHUNKS})) AND list_has_any(folders, ['en', 'de', 'fr', 'es']) ORDER BY page_id LIMIT 20""")
def section_scan(spark, sf_dir):
    """The section scan of one document: the first site, its sections and what is below them, in order, 20 at most."""
    pages = _page_chunks(spark, sf_dir)
    site = pages.agg(F.min("path")).first()[0]
    return search.section_scan(pages, "web", site, ["en", "de", "fr", "es"]).select("page_id", "url")


@query("""
SELECT 'Table ' || r_regionkey || ': nations of ' || r_name AS caption, CAST(r_regionkey AS VARCHAR) AS table_number, r_name || '.md' AS path
FROM region WHERE r_regionkey IN (1, 3)""")
def table_number_scan(spark, sf_dir):
    docs = _region_table(spark, sf_dir).select(
        F.lit("regions").alias("root"), F.concat("r_name", F.lit(".md")).alias("path"), F.format_string("%s\n\nTable %d: nations of %s", "text", "r_regionkey", "r_name").alias("text")
    )
    asked = spark.range(1).select(X.table_references(F.lit("What do table 3 and Table 1. say?")).alias("n")).first()["n"]
    return search.table_scan(chunking.chunk_frame(docs), asked, "regions").select("caption", "table_number", "path")


@query(r"""
SELECT conv_id, turn,
  regexp_matches(text, '(?i)(^|[^\w-])(section|sections|subsection|chapter|mục|phần|chương)($|[^\w-])') OR regexp_matches(text, '(^|[^A-Za-z0-9_-])[A-Za-z]?\d+(\.\d+)+($|[^A-Za-z0-9])') AS cue,
  regexp_matches(text, '(^|[^A-Za-z0-9_.-])(1|2|3)($|[^A-Za-z0-9_])') AS known_number,
  contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 'doc 1') AS names_doc
FROM conversations""")
def section_query_gate(spark, sf_dir):
    """What makes a turn a question about sections of an outline with sections 1 to 3."""
    asked = table(spark, sf_dir, "conversations")
    known = F.arrays_overlap(X.bare_numbers(F.col("text")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return asked.select("conv_id", "turn", X.section_cue(F.col("text")).alias("cue"), known.alias("known_number"), X.mentions_document(F.col("text"), F.lit("doc-1.md")).alias("names_doc"))


#: Sets of documents: each root, and of each root the two documents with the least ids.
_SETS = f"""
SELECT root AS set_id, chunk_id, path, seq FROM ({_CHUNKS}) UNION ALL
SELECT root || '/two', chunk_id, path, seq FROM ({_CHUNKS}) WHERE doc_id IN (
  SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 2)"""


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY set_id, path ORDER BY seq, chunk_id) AS p, dense_rank() OVER (PARTITION BY set_id ORDER BY path) AS d FROM ({_SETS})),
n AS (SELECT set_id, count(DISTINCT path) AS n FROM c GROUP BY set_id),
k AS (SELECT set_id, chunk_id, path, seq, row_number() OVER (PARTITION BY set_id ORDER BY d, p) AS place FROM c JOIN n USING (set_id)
  WHERE d <= 3 AND p <= greatest(4, floor((CASE WHEN n > 3 THEN greatest(24 - 8, 6) ELSE 24 END) / least(n, 3))))
SELECT set_id, chunk_id, path, seq, CAST(place AS INTEGER) AS n FROM k WHERE place <= 24""")
def budgeted_union(spark, sf_dir):
    rows = _chunks(spark, sf_dir).select(F.col("root").alias("set_id"), "chunk_id", "path", "seq", "doc_id")
    first = W.partitionBy("source").orderBy("doc_id")
    two = table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(first).alias("r")).where("r <= 2").select("doc_id")
    sets = rows.unionByName(rows.join(two, "doc_id", "left_semi").withColumn("set_id", F.concat("set_id", F.lit("/two"))))
    return context.budgeted(sets.drop("doc_id"), 8, "set_id")


_HITS = f"SELECT h.query_id, h.rank, h.score, c.* FROM ({_ranked_sql(5, f'({_CHUNKS})', 'chunk_id')}) h JOIN ({_CHUNKS}) c USING (chunk_id)"


def _hit_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The five chunks that answer each asked query best, by rank; and all chunks of their files."""
    asked = spark.createDataFrame(_ASKED, "query_id int, query string")
    best = search.bm25_topk(_chunks(spark, sf_dir), asked, 5, "chunk_id", "text")
    near = _chunks(spark, sf_dir, best.select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).alias("file_id")).distinct())
    return F.broadcast(best).join(near, "chunk_id"), near


@query(f"""
WITH RECURSIVE hits AS ({_HITS}), placed AS (
  SELECT h.query_id, h.rank, h.chunk_id AS hit, c.chunk_id, row_number() OVER (PARTITION BY h.query_id, h.rank ORDER BY c.seq, c.chunk_id) AS near
    FROM hits h JOIN ({_CHUNKS}) c ON c.root = h.root AND c.path = h.path AND c.section_heading = h.section_heading),
sides AS (SELECT query_id, rank, hit, list(chunk_id ORDER BY near) FILTER (near <= 5) AS beside FROM placed GROUP BY query_id, rank, hit),
r AS (SELECT DISTINCT query_id, 0 AS i, CAST([] AS VARCHAR[]) AS ids FROM sides
  UNION ALL SELECT r.query_id, r.i + 1, CASE WHEN list_contains(ids, hit) THEN ids ELSE list_slice(list_concat(list_append(ids, hit),
      list_slice(list_filter(beside, lambda x: x <> hit AND NOT list_contains(ids, x)), 1, 4)), 1, 16) END
    FROM r JOIN sides s ON s.query_id = r.query_id AND s.rank = r.i + 1),
last AS (SELECT query_id, arg_max(ids, i) AS ids FROM r GROUP BY query_id)
SELECT query_id, CAST(o AS INTEGER) AS ord, ids[o] AS chunk_id FROM last, range(1, 17) AS t(o) WHERE o <= len(ids)""")
def small_to_big(spark, sf_dir):
    hits, chunks = (rows.withColumnRenamed("section_heading", "section_id") for rows in _hit_chunks(spark, sf_dir))
    return context.expand(hits, chunks, of="query_id").select("query_id", "ord", "chunk_id")


#: Hits of one section that are each other's neighbours: the cases that tell the rule apart.
@query("SELECT * FROM (VALUES (1, 'c1'), (2, 'c2'), (3, 'c3'), (4, 'c4'), (5, 'c5'), (6, 'd2'), (7, 'd1')) AS v(ord, chunk_id)")
def small_to_big_cases(spark, sf_dir):
    chunks = spark.createDataFrame([(f"c{i}", "p", i) for i in range(1, 9)] + [("d1", "q", 1), ("d2", "q", 2)], "chunk_id string, path string, seq int")
    chunks = chunks.withColumns({"root": F.lit("r"), "section_id": F.lit("s1")})
    hits = spark.createDataFrame([("c1", 1), ("c3", 2), ("d2", 3)], "chunk_id string, rank int").join(chunks, "chunk_id")
    return context.expand(hits, chunks).select("ord", "chunk_id")


@query("""
SELECT path, row_count, text LIKE '%| 24 | %' AS has_last, length(text) AS chars FROM (
  SELECT r_name || '.md' AS path, CAST(count(*) AS INTEGER) AS row_count,
    '[Document: ' || r_name || '.md | Section: Overview]' || chr(10) || chr(10) || '[Table: ' || md5('regions' || chr(10) || r_name || '.md') || '_s0_t0]' || chr(10)
    || 'Caption: Table with columns: key, name. Rows: ' || count(*) || '.' || chr(10) || 'Columns: key, name' || chr(10)
    || 'Row entities: ' || string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey) || chr(10) || 'Total rows: ' || count(*) || chr(10) || chr(10)
    || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text
  FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)""")
def hydrate_tables(spark, sf_dir):
    docs = _region_table(spark, sf_dir).select(F.lit("regions").alias("root"), F.concat("r_name", F.lit(".md")).alias("path"), "text")
    chunks = chunking.chunk_frame(docs)
    full = context.hydrate_tables(chunks.where("chunk_type = 'table_stub'"), chunking.raw_tables(chunks))
    return full.select("path", "row_count", F.contains("text", F.lit("| 24 | ")).alias("has_last"), F.length("text").cast("long").alias("chars"))


@query(f"""
SELECT query_id, CAST(rank AS INTEGER) AS n, '[Source ' || rank || ']' || chr(10) || 'Title: ' || title || chr(10) || 'URL: ' || path || chr(10) || 'Section: ' || section_heading || chr(10)
  || 'Breadcrumbs: ' || section_heading || chr(10) || 'Score: ' || printf('%.4f', round(CAST(score AS DECIMAL(18, 6)), 4)) || chr(10) || 'Text: ' || text AS block FROM ({_HITS})""")
def context_format(spark, sf_dir):
    """Prompt blocks of the best chunks for each asked query."""
    hits = _hit_chunks(spark, sf_dir)[0].withColumns({"url": F.col("path"), "section_titles": F.array("section_heading")})
    return context.format_context(hits, of="query_id")


#: The state of an earlier run: every seventh document unknown, some changed since, some in error, some gone.
def _disk_and_state(spark, sf_dir):
    docs = files(spark, sf_dir)
    disk = docs.select("root", "path", F.length("text").cast("long").alias("size"), F.col("doc_id").alias("mtime_ns"), ids.content_hash(F.col("text")).alias("content_hash"))
    case = F.col("doc_id") % 7
    state_ = docs.where(case != 0).select(
        "root",
        F.when(case == 6, F.concat(F.lit("old-"), "path")).otherwise(F.col("path")).alias("path"),
        F.length("text").cast("long").alias("size"),
        F.when(case.isin(1, 2), F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("mtime_ns"),
        F.when(case == 1, F.lit("another")).otherwise(ids.content_hash(F.col("text"))).alias("content_hash"),
        F.when(case == 3, "error").otherwise("indexed").alias("status"),
        F.when(case == 4, "0").otherwise(sync.INDEX_VERSION).alias("index_version"),
    )
    return disk, state_


@query(f"""
SELECT root, path, CASE doc_id % 7 WHEN 0 THEN 'added' WHEN 2 THEN 'touched' WHEN 5 THEN 'unchanged' WHEN 6 THEN 'added' ELSE 'modified' END AS change FROM ({FILES})
UNION ALL SELECT root, 'old-' || path, 'deleted' FROM ({FILES}) WHERE doc_id % 7 = 6""")
def file_diff(spark, sf_dir):
    disk, state_ = _disk_and_state(spark, sf_dir)
    return sync.confirm(sync.diff(disk, state_), disk, state_).select("root", "path", "change")


@query(f"""
SELECT status, files FROM (SELECT status, count(*) AS files FROM (
  SELECT CASE WHEN doc_id % 7 = 4 THEN 'error' ELSE 'indexed' END AS status FROM documents) GROUP BY ROLLUP (status)) WHERE status IS NOT NULL
UNION ALL SELECT 'total', count(*) FROM documents""")
def status_counts(spark, sf_dir):
    """Counts after a run in which the files of an older index version failed."""
    disk, state_ = _disk_and_state(spark, sf_dir)
    changed = sync.confirm(sync.diff(disk, state_), disk, state_)
    failed = (F.col("change") == "modified") & (F.col("mtime_ns") % 7 == 4)
    outcome = changed.join(disk.select("root", "path", "mtime_ns"), sync.KEY, "left").select(*sync.KEY, "change", "content_hash", F.when(failed, "cannot read").alias("error"))
    return sync.status_counts(sync.next_state(state_, disk, outcome))


#: Texts embedded earlier: those of documents with an even id.
def _cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").select(F.lit("m").alias("model"), F.sha2("text", 256).alias("text_sha"), "embedding", F.col("doc_id").alias("pos"))


@query("""
SELECT DISTINCT sha256(text) AS text_sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def embed_cache_pending(spark, sf_dir):
    return sync.pending_texts(table(spark, sf_dir, "documents"), _cache(spark, sf_dir), "m").select("text_sha")


@query("""
SELECT sha256(text) AS text_sha, max(doc_id) AS pos FROM documents WHERE doc_id % 2 = 0
AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY 1""")
def cache_prune(spark, sf_dir):
    live = table(spark, sf_dir, "documents").where("lang = 'en'")
    kept = sync.prune_cache(_cache(spark, sf_dir), live)
    return kept.groupBy("text_sha").agg(F.max("pos").alias("pos"))


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version FROM documents")
def upsert_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sync.replace_by_key(docs.withColumn("version", F.lit("old")), docs.where("lang = 'en'").withColumn("version", F.lit("new")), ["doc_id"])


@query("""
SELECT r_name || '.md' AS path, r_name AS title, 1 AS tables, md5('regions' || chr(10) || r_name || '.md') || '_x1_t0' AS asset_id,
  'Table with columns: key, name. Rows: ' || count(*) || '.' AS caption, CAST(count(*) AS INTEGER) AS row_count, 0 AS images, CAST(1 AS BIGINT) AS text_chunks, true AS stale
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def card_structural(spark, sf_dir):
    docs = _region_table(spark, sf_dir).select(F.lit("regions").alias("root"), F.concat("r_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "text").alias("text"))
    made = cards.structural_cards(chunking.chunk_frame(docs))
    first = F.col("tables")[0]
    return made.select(
        "path", "title", F.size("tables").alias("tables"), first["asset_id"].alias("asset_id"), first["caption"].alias("caption"),
        first["row_count"].alias("row_count"), F.size("images").alias("images"), "text_chunks", "stale",
    )


@query(f"""
WITH RECURSIVE c AS (SELECT root, path, seq, length(text) AS n FROM ({_CHUNKS})),
r AS (SELECT root, path, seq, n AS size, 1 AS grp FROM c WHERE seq = 1
  UNION ALL SELECT c.root, c.path, c.seq, CASE WHEN r.size + c.n <= 6000 THEN r.size + c.n ELSE c.n END, CASE WHEN r.size + c.n <= 6000 THEN grp ELSE grp + 1 END
  FROM r JOIN c ON c.root = r.root AND c.path = r.path AND c.seq = r.seq + 1)
SELECT root, path, CAST(max(grp) AS INTEGER) AS groups, string_agg(CAST(members AS VARCHAR), ',' ORDER BY grp) AS sizes
FROM (SELECT root, path, grp, count(*) AS members FROM r GROUP BY root, path, grp) GROUP BY root, path""")
def greedy_group(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    grouped = _chunks(spark, sf_dir).groupBy("root", "path").agg(cards.greedy_groups(texts).alias("groups"))
    sizes = F.array_join(F.transform("groups", lambda g: F.size(g).cast("string")), ",")
    return grouped.select("root", "path", F.size("groups").alias("groups"), sizes.alias("sizes"))


@query("""
SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY t2) FILTER (line IS NOT NULL), '') AS history FROM (
  SELECT a.conv_id, a.turn, b.turn AS t2, CASE WHEN b.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || b.text AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) b
  ON a.conv_id = b.conv_id AND b.p BETWEEN a.p - 6 AND a.p - 1) GROUP BY conv_id, turn""")
def history_window(spark, sf_dir):
    return state.history(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark, sf_dir):
    return state.conversation_list(table(spark, sf_dir, "conversations"))


@query("""
SELECT conv_id, messages, CAST(row_number() OVER (ORDER BY (conv_id IN (3, 5)) DESC, messages DESC, conv_id) AS INTEGER) AS place
FROM (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id) ORDER BY place LIMIT 20""")
def lru_evict(spark, sf_dir):
    listed = state.conversation_list(table(spark, sf_dir, "conversations")).select("conv_id", "messages")
    return state.keep_recent(listed, "messages", [3, 5])


_GOLD = """
SELECT query_id, doc_id FROM (VALUES (1), (2), (3), (4)) AS g(query_id), labels WHERE quality = 1
UNION ALL SELECT 5, doc_id FROM labels WHERE toxic = 1"""
_SCORES = f"""
WITH hits AS ({_ranked_sql(10)}), gold AS ({_GOLD}), cuts AS (SELECT * FROM (VALUES (1), (3), (5), (10)) AS c(k)),
sizes AS (SELECT query_id, count(DISTINCT doc_id) AS gold FROM gold GROUP BY query_id),
found AS (SELECT h.query_id, k, count(*) AS n, count(g.doc_id) AS overlap, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS first
  FROM hits h CROSS JOIN cuts LEFT JOIN gold g ON g.query_id = h.query_id AND g.doc_id = h.doc_id WHERE rank <= k GROUP BY h.query_id, k)
SELECT s.query_id, c.k, CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END AS hit, coalesce(overlap / gold, 0.0) AS recall,
  coalesce(overlap / n, 0.0) AS precision, coalesce(1.0 / first, 0.0) AS mrr FROM sizes s CROSS JOIN cuts c LEFT JOIN found f ON f.query_id = s.query_id AND f.k = c.k"""


def _scores(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = spark.range(1, 5).select(F.col("id").cast("int").alias("query_id")).crossJoin(labels.where("quality = 1").select("doc_id"))
    gold = good.unionByName(labels.where("toxic = 1").select(F.lit(5).alias("query_id"), "doc_id"))
    return evaluate.score_questions(_bm25(spark, sf_dir, 10), gold, id_col="doc_id")


_ROUNDED = ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in ("hit", "recall", "precision", "mrr"))


@query(f"SELECT query_id, k, {_ROUNDED} FROM ({_SCORES})")
def eval_metrics(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "k", *(F.round(m, 6).alias(m) for m in ("hit", "recall", "precision", "mrr")))


_MEANS = ", ".join(f"round(CAST(avg({m}) AS DOUBLE), 6) AS {m}" for m in ("hit", "recall", "precision", "mrr"))
_KINDS_SQL = "CASE WHEN query_id = 5 THEN 'toxic' ELSE 'quality' END AS category, CASE WHEN query_id IN (1, 5) THEN 'easy' ELSE 'hard' END AS difficulty"


@query(f"""
WITH s AS (SELECT *, {_KINDS_SQL} FROM ({_SCORES}))
SELECT k, 'all' AS part, '' AS value, count(*) AS n, {_MEANS} FROM s GROUP BY k
UNION ALL SELECT k, 'category', category, count(*), {_MEANS} FROM s GROUP BY k, category
UNION ALL SELECT k, 'difficulty', difficulty, count(*), {_MEANS} FROM s GROUP BY k, difficulty""")
def eval_breakdown(spark, sf_dir):
    kinds = _scores(spark, sf_dir).withColumns(
        {"category": F.when(F.col("query_id") == 5, "toxic").otherwise("quality"), "difficulty": F.when(F.col("query_id").isin(1, 5), "easy").otherwise("hard")}
    )
    return evaluate.breakdown(kinds, ["category", "difficulty"])


@query("""
SELECT criterion, count(*) AS n, round(avg(score), 3) AS mean FROM (
  SELECT 'faithfulness' AS criterion, 1 + 4.0 * quality AS score FROM labels UNION ALL
  SELECT 'answer_relevance', 5 - 4.0 * toxic FROM labels UNION ALL SELECT 'citation_accuracy', 3.0 + quality - toxic FROM labels) GROUP BY criterion""")
def judge_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    judged = labels.select(
        F.col("doc_id").alias("id"),
        (1 + 4.0 * F.col("quality")).alias("faithfulness"),
        (5 - 4.0 * F.col("toxic")).alias("answer_relevance"),
        (3.0 + F.col("quality") - F.col("toxic")).alias("citation_accuracy"),
    )
    return evaluate.judge_summary(judged, labels.select(F.col("doc_id").alias("id")))


@query("""
SELECT p_partkey, CASE WHEN b < 1024 THEN 'tiny_file' WHEN w < 96 OR h < 96 THEN 'too_small' WHEN w * h < 12000 THEN 'too_small_area'
  WHEN greatest(w, h) / least(w, h) > 8 THEN 'thin' WHEN ink < 0.005 THEN 'blank' WHEN x < 48 OR y < 48 OR x * y < 4000 THEN 'small_on_page'
  WHEN n >= 3 AND w * h < 200000 THEN 'repeated' END AS reason
FROM (SELECT p_partkey, CAST(p_retailprice * 10 AS BIGINT) AS b, p_size * 20 AS w, 40 + p_partkey % 400 AS h, (p_partkey % 50) / 100.0 AS ink,
  p_size * 4.0 AS x, 30.0 + p_partkey % 90 AS y, count(*) OVER (PARTITION BY p_type, p_brand, p_size) AS n FROM part)""")
def asset_reject_case(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("file_id"), F.concat_ws("|", "p_brand", "p_size").alias("sha256"),
        F.round(F.col("p_retailprice") * 10).cast("long").alias("b"), (F.col("p_size") * 20).alias("w"), (40 + F.col("p_partkey") % 400).alias("h"),
        ((F.col("p_partkey") % 50) / 100.0).alias("ink"), (F.col("p_size") * 4.0).alias("x"), (30.0 + F.col("p_partkey") % 90).alias("y"),
    )
    unknown = F.lit(None).cast("double")
    reason = assets.reject_reason(F.col("b"), F.col("w"), F.col("h"), F.col("ink"), (F.col("x"), F.col("y")), (unknown, unknown), F.col("occurrences"))
    return assets.with_occurrences(part).select("p_partkey", reason.alias("reason"))


_REJECTS = ORACLES["asset_reject_case"]


@query(f"""
SELECT p_type AS file_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS rejected FROM (
  SELECT p_type, reason, count(*) AS n FROM ({_REJECTS}) JOIN part USING (p_partkey) WHERE reason IS NOT NULL GROUP BY p_type, reason) GROUP BY p_type""")
def reject_histogram(spark, sf_dir):
    judged = asset_reject_case(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("file_id")), "p_partkey")
    pairs = F.transform(F.array_sort(F.map_entries("rejected")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return assets.reject_histogram(judged).select("file_id", F.array_join(pairs, ",").alias("rejected"))


@query("""
WITH c AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 256 AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT event_type, sum(n) AS total, arg_min(v, (-n, v)) AS mode FROM c GROUP BY event_type)
SELECT event_type, round(sum(-(n / total) * log2(n / total)), 6) AS entropy, round(sum(CASE WHEN abs(v - mode) > 16 THEN n ELSE 0 END) / any_value(total), 6) AS ink
FROM c JOIN t USING (event_type) GROUP BY event_type""")
def pixel_entropy(spark, sf_dir):
    samples = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", (F.floor("value") % 256).alias("value"))
    return assets.pixel_metrics(samples, "event_type")


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, sid""")
def debounce_sessions(spark, sf_dir):
    return changes.debounce(table(spark, sf_dir, "events").select(F.col("user_id"), "ts", "event_id", "event_type"), ["user_id"], "1 hour", "event_type", "event_id").select(
        "user_id", "first_ts", "last_ts", "events"
    )


@query("""
SELECT user_id AS scope, event_type AS path, max(CASE WHEN value < 20 THEN 'delete' ELSE 'upsert' END) AS action, arg_max(CASE WHEN value < 20 THEN 'delete' ELSE 'upsert' END, event_id) AS last_action
FROM events GROUP BY user_id, event_type""")
def coalesce_last_action(spark, sf_dir):
    action = F.when(F.col("value") < 20, "delete").otherwise("upsert")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("path"), action.alias("action"), "event_id")
    last = events.groupBy("scope", "path").agg(F.max_by("action", "event_id").alias("last_action"))
    return sync.collapse_changes(events).join(last, ["scope", "path"])


@query("""
SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS keys FROM events WHERE props LIKE '{%}'""")
def json_extract_tolerant(spark, sf_dir):
    """props wrapped in prose and a fence, as a model would answer."""
    wrapped = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nDone."))
    found = table(spark, sf_dir, "events").where("props LIKE '{%}'").select("event_id", F.from_json(X.json_object(wrapped), "map<string,string>").alias("m"), F.json_object_keys(X.json_object(wrapped)).alias("k"))
    return found.select("event_id", F.try_element_at("m", F.col("k")[0]).alias("first_value"), F.size("k").cast("long").alias("keys"))


#: Customers as documents of many paragraphs: the comments of their orders, in order; some paragraphs are very long.
_ORDERS_TEXT = """
SELECT o_custkey, list(p ORDER BY o_orderkey) AS ps FROM (
  SELECT o_custkey, o_orderkey, repeat(o_orderpriority || ' ' || o_orderkey || '. ', CAST(1 + (CASE WHEN o_orderkey % 17 = 0 THEN 200 ELSE o_orderkey % 50 END) AS BIGINT)) AS p FROM orders) GROUP BY o_custkey"""


@query(rf"""
WITH RECURSIVE t AS (SELECT o_custkey, list_transform(ps, lambda x: trim(x)) AS ps, trim(array_to_string(ps, chr(10) || chr(10))) AS whole FROM ({_ORDERS_TEXT})),
r AS (SELECT o_custkey, 0 AS i, CAST([] AS VARCHAR[]) AS parts, '' AS packed, ps FROM t WHERE length(whole) > 1800
  UNION ALL SELECT o_custkey, i + 1,
    CASE WHEN packed <> '' AND length(packed) + 2 + length(ps[i + 1]) <= 1200 THEN parts
      ELSE list_concat(list_concat(parts, CASE WHEN packed = '' THEN [] ELSE [packed] END),
        CASE WHEN length(ps[i + 1]) > 1800 THEN list_transform(range(0, CAST(ceil(length(ps[i + 1]) / 1800.0) AS BIGINT)), lambda k: substr(ps[i + 1], k * 1800 + 1, 1800)) ELSE [] END) END,
    CASE WHEN packed <> '' AND length(packed) + 2 + length(ps[i + 1]) <= 1200 THEN packed || chr(10) || chr(10) || ps[i + 1]
      WHEN length(ps[i + 1]) > 1800 THEN '' ELSE ps[i + 1] END, ps
  FROM r WHERE i < len(ps)),
done AS (SELECT o_custkey, CASE WHEN packed = '' THEN parts ELSE list_append(parts, packed) END AS pieces FROM r WHERE i = len(ps)
  UNION ALL SELECT o_custkey, [whole] FROM t WHERE length(whole) <= 1800)
SELECT o_custkey, len(pieces) AS pieces, md5(array_to_string(pieces, '|')) AS hash FROM done""")
def pack_paragraphs(spark, sf_dir):
    """Splitting texts of many paragraphs: packed, standing alone, or cut."""
    times = 1 + F.when(F.col("o_orderkey") % 17 == 0, 200).otherwise(F.col("o_orderkey") % 50)
    paragraph = F.repeat(F.format_string("%s %d. ", "o_orderpriority", "o_orderkey"), times.cast("int"))
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", paragraph.alias("p")))).alias("ps"))
    pieces = texts.select("o_custkey", chunking.split_column(F.array_join(F.transform("ps", lambda s: s["p"]), "\n\n")).alias("x"))
    return pieces.select("o_custkey", F.size("x").cast("long").alias("pieces"), F.md5(F.array_join("x", "|")).alias("hash"))


@query(f"""
WITH a AS (SELECT doc_id, 1 AS b, rank FROM ({_ranked_sql(10)}) WHERE query_id = 1), c AS (SELECT doc_id, 2 AS b, rank FROM ({_ranked_sql(10)}) WHERE query_id = 2),
u AS (SELECT doc_id, b, rank, row_number() OVER (PARTITION BY doc_id ORDER BY b, rank) AS f FROM (SELECT * FROM a UNION ALL SELECT * FROM c))
SELECT doc_id, CAST(rank AS INTEGER) AS rank FROM u WHERE f = 1 ORDER BY b, rank LIMIT 24""")
def ordered_union(spark, sf_dir):
    """Hits of two questions one after the other, each document once, at its first place."""
    hits = _bm25(spark, sf_dir, 10)
    return context.ordered_union([hits.where(f"query_id = {i}").select("doc_id", "rank") for i in (1, 2)], "doc_id", "rank", context.CAP)


@query(f"""
SELECT query_id, count(*) FILTER (doc_id % 2 = 0) AS locked, count(*) FILTER (doc_id % 2 <> 0) AS open, coalesce(max(score) FILTER (doc_id % 2 <> 0) >= 0.5, false) AS skip
FROM ({_ranked_sql(10)}) GROUP BY query_id""")
def locked_rows(spark, sf_dir):
    """Locked rows (here: of even ids) are not graded; the gate looks at the others."""
    hits = _bm25(spark, sf_dir, 10).withColumns({"chunk_id": F.col("doc_id").cast("string"), "semantic_score": F.lit(0.0)})
    out = None
    for i, _ in _ASKED:
        mine = hits.where(f"query_id = {i}")
        even = [r[0] for r in mine.where("doc_id % 2 = 0").select("chunk_id").collect()]
        locked, others = context.locked_and_open(mine, even)
        row = context.grade_gate(others).select(F.lit(i).alias("query_id"), F.lit(locked.count()).cast("long").alias("locked"), F.lit(others.count()).cast("long").alias("open"), "skip")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""
SELECT query_id, mean_recall FROM (SELECT query_id, round(CAST(avg(recall) AS DOUBLE), 6) AS mean_recall FROM ({_SCORES}) GROUP BY query_id) ORDER BY mean_recall, query_id LIMIT 5""")
def lowest_recall(spark, sf_dir):
    return evaluate.lowest(_scores(spark, sf_dir), "recall", 5)


@query("""
SELECT r_regionkey, CASE WHEN n > 3 THEN head || chr(10) || '(3 of ' || n || ' rows shown, all by table id t' || r_regionkey || ')' ELSE whole END AS text FROM (
  SELECT n_regionkey AS r_regionkey, count(*) AS n, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS whole,
    '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (i <= 3) AS head
  FROM (SELECT n_regionkey, n_nationkey AS k, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) GROUP BY n_regionkey)""")
def truncated_tables(spark, sf_dir):
    """Tables beyond their cap of rows, with a notice."""
    rows = _region_table(spark, sf_dir).withColumn("rows", markdown.table_cells(F.col("text")))
    whole = F.concat(F.lit("t"), F.col("r_regionkey").cast("string"))
    return rows.select("r_regionkey", markdown.truncated_table(F.col("rows"), 3, 6000, whole).alias("text"))


@query("""
SELECT 'mixed' AS root, count(*) AS files, count(*) FILTER (status = 'error') AS errors FROM (SELECT CASE WHEN doc_id % 7 = 4 THEN 'error' ELSE 'indexed' END AS status FROM documents)""")
def index_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 4, "error").otherwise("indexed").alias("status"))
    counts = sync.status_counts(docs)
    of = lambda k: F.coalesce(F.max(F.when(F.col("status") == k, F.col("files"))), F.lit(0))
    return counts.agg(of("total").alias("files"), of("error").alias("errors")).select(F.lit("mixed").alias("root"), "files", "errors")


@query("""
SELECT r_name || '.md' AS path, seq, kind, asset FROM region, (VALUES (1, 'text', NULL), (2, 'image_stub', 'p0'), (3, 'image_stub', 'p1'), (4, 'text', NULL)) AS v(seq, kind, asset)""")
def image_stubs(spark, sf_dir):
    """A document of each region with two pictures: stubs in the section before any heading, then pointers to them."""
    picture = F.struct(F.lit("a.png").alias("image_path"), F.lit("first").alias("caption")), F.struct(F.lit("b.png").alias("image_path"), F.lit(None).cast("string").alias("caption"))
    docs = table(spark, sf_dir, "region").select(F.lit("r").alias("root"), F.concat("r_name", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "r_name", F.lit("\n\ntext")).alias("text"), F.array(*picture).alias("images"))
    made = chunking.chunk_frame(docs)
    return made.select("path", "seq", F.col("chunk_type").alias("kind"), F.nullif(F.regexp_extract(F.coalesce("asset_id", F.lit("")), r"_s0_(p\d+)$", 1), F.lit("")).alias("asset"))


@query(f"SELECT chunk_id, path, title, section_heading, seq - seq + 1 AS section_level, 'text' AS chunk_type, 0 AS char_count, 34 AS columns FROM ({_CHUNKS})")
def result_columns(spark, sf_dir):
    """The columns of a result, with defaults for those that a chunk lacks."""
    found = search.results(_chunks(spark, sf_dir))
    return found.select("chunk_id", "path", "title", "section_heading", "section_level", "chunk_type", "char_count", F.lit(len(found.columns)).alias("columns"))
