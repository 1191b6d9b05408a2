"""One object for a folder of documents: keep its index current, search it, answer from it.

Tables live below `home` as Parquet, partitioned by root and by a hash of the path, so that a change rewrites the
part of its file alone.  Beside the chunks stand their postings, ordered by term, and, with a model, the vectors of
their texts; a search reads these and never a text it does not give back.  Models are injected: embed (texts to
vectors) and answer (prompt to text); without them search is by BM25 and questions end at the context."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import ids
from docloom.functions import text as X
from docloom.operators import cards, chunking, context, search, structure, sync
from docloom.sources import embedders, files, pictures, stores

from . import graph, turn, watch
from .jobs import WRITER

PARTS = 64
STATE = "root string, part int, path string, size long, mtime_ns long, content_hash string, status string, index_version string, indexed_at long"
POSTINGS = "root string, part int, path string, chunk_id string, term string, tf long, length int"
VECTORS = "root string, part int, path string, chunk_id string, text_sha string, dense array<float>"
CARDS = "root string, part int, path string, summary string, file_hash string, made_at long"
IMAGES = "root string, part int, path string, asset_id string, file_name string, image_path string, width int, height int, entropy double, ink double, sha256 string, caption string, data binary"
_CHUNKS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunking.CHUNK) + ", part int"
TOP_K, ASK_K, FEW_FILES = 5, 8, 1000


def _names(schema: str) -> list[str]:
    return T.StructType.fromDDL(schema).fieldNames()


def _part():
    """The part of a root that a path belongs to."""
    return F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")


class Engine:
    def __init__(
        self, spark: SparkSession, home: str, embed: Callable[[list[str]], list[list[float]]] | None = None, answer: turn.Model | None = None,
        utility: turn.Model | None = None, external: Callable[[str], dict | None] | None = None, trace=None,
    ):
        self.spark, self.home, self.embed, self.model = spark, home.rstrip("/"), embed, answer
        self.graph = graph.Graph(self, answer, utility, external, ASK_K, trace)

    def _load(self, name: str, schema) -> DataFrame:
        """A table without the rows that only hold its parts' places."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows.where("path IS NOT NULL")

    def _replace(self, name: str, rows: DataFrame, parts: DataFrame) -> None:
        """Write the parts (root, part) of a table anew: rows has all their rows.

        A part left without rows gets one that only holds its place.  Rows are written elsewhere first: they may come
        from the table they replace."""
        empty = parts.join(rows.select("root", "part").distinct(), ["root", "part"], "left_anti")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("root", "part") else F.col(f.name) for f in rows.schema]
        staged = f"{self.home}/_staged_{name}"
        rows.unionByName(empty.select(*blank)).write.mode("overwrite").parquet(staged)
        by = "term" if "term" in rows.columns else "path"
        again = self.spark.read.schema(rows.schema).parquet(staged).repartition("root", "part").sortWithinPartitions("root", "part", by)
        stores.write_partitioned(again, f"{self.home}/{name}", "root", "part")

    @property
    def chunks(self) -> DataFrame:
        return self._load("chunks", _CHUNKS)

    @property
    def state(self) -> DataFrame:
        return self._load("state", STATE)

    def images(self, root: str) -> DataFrame:
        return self._load("images", IMAGES).where(F.col("root") == root)

    def image(self, root: str, image_id: str = "", image_path: str = "") -> dict | None:
        """A stored picture with its bytes, by its id or by its path; None if there is none."""
        known = self.images(root).where((F.col("asset_id") == image_id) | (F.col("image_path") == image_path) if image_path else F.col("asset_id") == image_id)
        row = known.drop("part").limit(1).first()
        return None if row is None else row.asDict() | {"data": bytes(row["data"])}

    def sync(self, folder: str) -> DataFrame:
        """Bring the index in line with the folder; gives the counts by kind of change.

        Only new and changed files are read, and only if their content is not the one indexed."""
        with WRITER:
            return self._sync(files.normal_root(folder))

    def _sync(self, root: str) -> DataFrame:
        disk = files.scan(self.spark, root).drop("name", "ext").cache()
        old = self.state.where(F.col("root") == root)
        found = sync.diff(disk, old).cache()
        maybe = found.where("change IN ('added', 'modified')").select("root", "path")
        few = [r["path"] for r in maybe.select("path").limit(FEW_FILES + 1).collect()]
        if len(few) <= FEW_FILES:
            read = files.read_documents(self.spark, root, paths=few) if few else files.read_documents(self.spark, root).limit(0)
        else:
            read = files.read_documents(self.spark, root)
        read = read.join(maybe, sync.KEY, "left_semi").cache()
        changes = sync.confirm(found, read, old).cache()
        fresh = read.join(changes.where("change IN ('added', 'modified')").select(*sync.KEY), sync.KEY, "left_semi")
        outcome = changes.join(read.select(*sync.KEY, "error"), sync.KEY, "left")
        gone = outcome.where("change IN ('added', 'modified', 'deleted') AND error IS NULL").select(*sync.KEY).cache()
        counts = changes.groupBy("change").count().collect()  # before the state is written: that renews what is cached from it
        parts = gone.select("root", _part().alias("part")).distinct().cache()
        if parts.count():
            self._index(root, fresh.where("error IS NULL"), gone, parts)
        if any(r["change"] != "unchanged" for r in counts):
            now = sync.next_state(old.drop("part", "indexed_at"), disk, outcome).withColumns({"part": _part(), "indexed_at": F.lit(time.time_ns())})
            kept = now.join(old.select(*sync.KEY, F.col("indexed_at").alias("_before")), sync.KEY, "left").join(changes.select(*sync.KEY, "change"), sync.KEY, "left")
            kept = kept.withColumn("indexed_at", F.when(F.col("change").isin("added", "modified"), F.col("indexed_at")).otherwise(F.col("_before"))).drop("_before", "change")
            of_all = old.select("root", "part").union(now.select("root", "part")).distinct()
            self._replace("state", kept.select(*_names(STATE)), of_all)
        for df in (disk, found, read, changes, gone, parts):
            df.unpersist()
        return self.spark.createDataFrame([(r["change"], r["count"]) for r in counts], "change string, files long")

    def _index(self, root: str, documents: DataFrame, gone: DataFrame, parts: DataFrame) -> None:
        """Chunks, postings and vectors of documents in place of those of gone; only parts are read and written."""
        inside = lambda df: df.where(F.col("root") == root).join(parts, ["root", "part"], "left_semi")
        file = ids.file_id(F.col("root"), F.col("path"))
        pictured = documents.select("root", "path", "text", pictures.kept(F.col("pictures"), file).alias("pictures"))
        named = F.transform("pictures", lambda x: F.struct(x["image_path"].alias("image_path"), F.lit(None).cast("string").alias("caption")))
        new = chunking.chunk_frame(pictured.select("root", "path", "text", named.alias("images"))).withColumn("part", _part()).cache()
        shots = pictured.select("root", "path", F.posexplode("pictures").alias("k", "x")).select("root", "path", ids.image_id(file, F.col("k")).alias("asset_id"), "x.*")
        shots = shots.withColumns({"part": _part(), "caption": F.lit(None).cast("string")}).select(*_names(IMAGES))
        known_images = inside(self._load("images", IMAGES))
        if known_images.limit(1).count() or shots.limit(1).count():
            self._replace("images", sync.replace_by_key(known_images, shots, sync.KEY, gone).select(*_names(IMAGES)), parts)
        self._replace("chunks", sync.replace_by_key(inside(self.chunks), new, sync.KEY, gone).select(*_names(_CHUNKS)), parts)
        terms = search.postings(new, "chunk_id", "text", "root", "part", "path")
        self._replace("postings", sync.replace_by_key(inside(self._load("postings", POSTINGS)), terms.select(*_names(POSTINGS)), sync.KEY, gone), parts)
        if self.embed is not None:
            known = self._load("vectors", VECTORS)
            cache = known.groupBy("text_sha").agg(F.any_value("dense").alias("dense"))
            needed = new.select(F.sha2("text", 256).alias("text_sha"), "text").dropDuplicates(["text_sha"])
            made = self.embedded(needed.join(cache, "text_sha", "left_anti")).select("text_sha", "dense").unionByName(cache.join(needed.select("text_sha"), "text_sha", "left_semi")).cache()
            rows = new.withColumn("text_sha", F.sha2("text", 256)).join(made, "text_sha").select(*_names(VECTORS))
            self._replace("vectors", sync.replace_by_key(inside(known), rows, sync.KEY, gone), parts)
            made.unpersist()
        new.unpersist()

    def apply(self, root: str, actions: DataFrame) -> dict[str, int]:
        """Apply a batch of actions (path, action: upsert or delete) to the index: deletions first; an upsert of a file
        that is not there deletes; a file that cannot be read is an error of its own.  Gives counts."""
        with WRITER:
            last = sync.collapse_changes(actions.withColumn("scope", F.lit(root))).select("path", "action").cache()
            wanted = [r["path"] for r in last.where("action = 'upsert'").collect()]  # of one batch
            there = files.scan(self.spark, root).where(F.col("path").isin(wanted)).drop("name", "ext") if wanted else files.scan(self.spark, root).limit(0).drop("name", "ext")
            there = there.cache()
            present = [r["path"] for r in there.select("path").collect()]
            read = (files.read_documents(self.spark, root, paths=present) if present else files.read_documents(self.spark, root).limit(0)).cache()
            old = self.state.where(F.col("root") == root)
            dropped = last.select(F.lit(root).alias("root"), "path").join(there.select("path"), "path", "left_anti").select("root", "path")
            outcome = read.select("root", "path", F.lit("modified").alias("change"), "content_hash", "error").cache()
            gone = dropped.union(outcome.where("error IS NULL").select("root", "path")).cache()
            parts = gone.select("root", _part().alias("part")).union(outcome.select("root", _part())).distinct().cache()
            counts = {"deleted": dropped.join(old, sync.KEY, "left_semi").count(), "indexed": outcome.where("error IS NULL").count(), "errors": outcome.where("error IS NOT NULL").count()}
            self._index(root, read.where("error IS NULL"), gone, parts)
            rest = old.join(gone, sync.KEY, "left_anti").join(outcome.select(*sync.KEY), sync.KEY, "left_anti").join(parts, ["root", "part"], "left_semi")
            made = sync.next_state(old.drop("part", "indexed_at"), there, outcome).withColumns({"part": _part(), "indexed_at": F.lit(time.time_ns())})
            self._replace("state", rest.select(*_names(STATE)).unionByName(made.select(*_names(STATE))), parts)
            for df in (last, there, read, outcome, gone, parts):
                df.unpersist()
            return counts

    def watch(self, folder: str, every: float = watch.EVERY) -> watch.Watch:
        """Started watch that keeps the index in line with a folder; stop() ends it."""
        return watch.Watch(lambda: self.sync(folder), every).start()

    def drop_root(self, root: str) -> None:
        """Forget a folder: every part of it is left empty."""
        with WRITER:
            for name, schema in (("chunks", _CHUNKS), ("postings", POSTINGS), ("vectors", VECTORS), ("cards", CARDS), ("images", IMAGES), ("state", STATE)):
                rows = self._load(name, schema).where(F.col("root") == root)
                parts = rows.select("root", "part").distinct().cache()
                if parts.limit(1).count():
                    self._replace(name, rows.limit(0), parts)
                parts.unpersist()

    def sources(self, root: str | None = None) -> DataFrame:
        return cards.list_sources(self.chunks.where(search.in_scope(root)))

    def status(self, root: str) -> DataFrame:
        return sync.status_counts(self.state.where(F.col("root") == root))

    def totals(self, root: str) -> dict[str, int]:
        """Files, chunks, tables, images and embedded chunks of a folder."""
        kinds = {r["chunk_type"]: r["count"] for r in self.chunks.where(search.in_scope(root)).groupBy("chunk_type").count().collect()}
        vectors = self._load("vectors", VECTORS).where(F.col("root") == root).count()
        return {"files": self.state.where(F.col("root") == root).count(), "chunks": sum(kinds.values()), "tables": kinds.get("table_stub", 0), "images": kinds.get("image_stub", 0), "embedded": vectors}

    def outline(self, root: str, path: str) -> DataFrame:
        return structure.outline(self.chunks.where(search.in_scope(root, [path])))

    def section(self, root: str, path: str, section_ids: list[str]) -> DataFrame:
        return search.section_scan(self.chunks, root, path, section_ids)

    def cards(self, root: str) -> DataFrame:
        """Cards of the documents by path, with the summaries kept for them."""
        known = self._load("cards", CARDS).where(F.col("root") == root)
        made = cards.structural_cards(self.chunks.where(search.in_scope(root)), known.select("root", "path", "file_hash"))
        return made.join(known.select("root", "path", "summary"), ["root", "path"], "left").orderBy("path")

    def save_cards(self, root: str, summaries: DataFrame) -> None:
        """Keep summaries (path, summary, file_hash) of documents; those of documents that are gone are dropped."""
        with WRITER:
            new = summaries.select(F.lit(root).alias("root"), "path", "summary", "file_hash").withColumns({"part": _part(), "made_at": F.lit(time.time_ns())})
            old = self._load("cards", CARDS).where(F.col("root") == root)
            live = self.state.where(F.col("root") == root).select(*sync.KEY)
            rows = sync.replace_by_key(old, new.select(*_names(CARDS)), sync.KEY).join(live, sync.KEY, "left_semi").select(*_names(CARDS))
            self._replace("cards", rows, old.select("root", "part").union(new.select("root", "part")).distinct())

    def tables(self, root: str) -> DataFrame:
        return chunking.raw_tables(self.chunks.where(search.in_scope(root)))

    def tree(self, root: str) -> dict:
        return files.tree(self.state.where(F.col("root") == root))

    def read(self, root: str, path: str) -> dict:
        return files.read_content(self.spark, root, path)

    def insight(self, root: str, path: str, generate, cache: dict) -> dict:
        """Summary of a document by generate(kind, text), kept in cache until its content changes."""
        card = self.cards(root).where(F.col("path") == path).first()
        if card is None:
            raise ValueError("no such document")
        known = cache.get((root, path))
        if known is None or known["file_hash"] != card["file_hash"]:
            texts = [r["text"] for r in self.chunks.where(search.in_scope(root, [path])).orderBy("seq").select("text").collect()]
            cache[root, path] = {"summary": cards.summarise(texts, generate), "file_hash": card["file_hash"]}
        return cache[root, path]

    def insights(self, root: str, cache: dict) -> DataFrame:
        """Every document with its summary and whether that is stale; without one: stale."""
        rows = [(r, p, v["summary"], v["file_hash"]) for (r, p), v in cache.items() if r == root]
        known = self.spark.createDataFrame(rows, "root string, path string, summary string, file_hash string")
        made = cards.structural_cards(self.chunks.where(search.in_scope(root)), known).select("root", "path", "title", "stale")
        return made.join(known.drop("file_hash"), ["root", "path"], "left").orderBy("path")

    def embedded(self, rows: DataFrame) -> DataFrame:
        """rows with dense: the vector of their text."""
        embed = embedders.Retrying(self.embed)

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out = []
            for k in range(0, len(texts), 50):
                out += embed(texts[k : k + 50].tolist())
            return pd.Series(out, dtype=object)

        return rows.withColumn("dense", vectors("text"))

    def search(self, question: str, root: str | None = None, paths: list[str] | None = None, k: int = TOP_K) -> DataFrame:
        """The k best chunks: chunk columns with rank, score, semantic_score; none for an empty question.

        Postings of the question's terms and vectors in scope are read, then the chunks found alone."""
        question = question.strip()
        scope = search.in_scope(root, paths) & F.lit(bool(question))
        _, prefetch = search.fetch_sizes(k)
        asked = self.spark.createDataFrame([(1, question)], "query_id int, query string")
        terms = [r["term"] for r in search.asked_terms(asked).collect()]  # of one question
        index = self._load("postings", POSTINGS).where(scope & F.col("term").isin(terms)).select("term", "chunk_id", "tf", "length")
        sparse = search.top_per_query(search.bm25(index, asked, self.chunks.where(scope).count(), "chunk_id"), prefetch, "chunk_id")
        if self.embed is None:
            dense = sparse.select("query_id", "chunk_id", "rank", F.lit(0.0).alias("semantic_score")).limit(0)
        else:
            nearest = self.nearest(question, scope, prefetch)
            dense = search.top_per_query(nearest.withColumn("query_id", F.lit(1)), prefetch, "chunk_id", "semantic_score")
        chunks = self.chunks.where(scope)
        best = search.hybrid(dense, sparse, chunks, k, "chunk_id").drop("query_id")
        return best.join(chunks, "chunk_id").orderBy("rank")

    def nearest(self, question: str, scope, k: int) -> DataFrame:
        """chunk_id and semantic_score of the k stored vectors nearest to a question."""
        vectors = self._load("vectors", VECTORS).where(scope)
        return search.dense_topk(vectors, embedders.Retrying(self.embed)([question])[0], k, "chunk_id").select("chunk_id", "semantic_score")

    def dense_search(self, question: str, root: str | None = None, paths: list[str] | None = None, k: int = TOP_K) -> DataFrame:
        """As search, by vectors alone."""
        question = question.strip()
        scope = search.in_scope(root, paths) & F.lit(bool(question))
        hits = self.nearest(question, scope, k).withColumn("score", F.col("semantic_score"))
        ranked = search.top_per_query(hits.withColumn("query_id", F.lit(1)), k, "chunk_id").drop("query_id")
        return ranked.join(self.chunks.where(scope), "chunk_id").orderBy("rank")

    def results(self, hits: DataFrame) -> DataFrame:
        """Hits of a search with all columns of a result, in order."""
        return search.results(hits, "rank").orderBy("rank").drop("rank")

    def retrieve(self, question: str, root: str, paths: list[str] | None = None, queries: list[str] | None = None, k: int = ASK_K) -> DataFrame:
        """Tables the question names first, then hits of each sub-query, 24 rows at most, in that order."""
        numbers = self.spark.range(1).select(X.table_references(F.lit(question)).alias("n")).first()["n"]
        locked = search.table_scan(self.chunks, numbers, root, paths, context.CAP).withColumn("ord", F.col("seq").cast("long"))
        branches = [locked.withColumns({"score": F.lit(1.0), "semantic_score": F.lit(1.0)})]
        branches += [self.search(q, root, paths, k).withColumn("ord", F.col("rank").cast("long")).drop("rank") for q in queries or [question]]
        return context.ordered_union(branches, "chunk_id", "ord", context.CAP)

    def context(self, rows: DataFrame, root: str) -> str:
        """Prompt text of retrieved rows: expanded to their sections, tables with their rows."""
        hits = rows.withColumn("rank", F.row_number().over(W.orderBy("ord"))).cache()
        chunks = self.chunks.where(search.in_scope(root))
        wide = context.expand(hits, chunks)
        full = wide.select("ord", "chunk_id").join(chunks, "chunk_id").join(hits.select("chunk_id", "score"), "chunk_id", "left")
        full = context.hydrate_tables(full, self.tables(root))
        return "\n\n".join(r["block"] for r in context.format_context(full, "ord").orderBy("n").collect())

    def ask(
        self, question: str, root: str, session: turn.Session | None = None, requested: list[str] | None = None, router: Callable[[], turn.Route] | None = None,
        allow_external: bool = False, notes: list[str] | None = None,
    ) -> dict:
        """Plan a turn and run it; gives plan, context, answer (None without a model), sources, steps, locks and the new session."""
        session = session or turn.Session(scope=root)
        used = {*(requested or []), *session.excluded, *session.last_used}
        known = self.sources(root).select("path")
        if not session.excluded:  # the whole list is needed only to take the excluded from it
            known = known.where(F.col("path").isin(list(used))) if used else known.limit(0)
        plan = turn.decide_turn(requested or [], [r["path"] for r in known.orderBy("path").collect()], list(session.excluded), list(session.last_used), router or turn.Route, router is not None)
        lines = [f"{'User' if role == 'user' else 'Assistant'}: {words}" for role, words in session.messages[-6:]]
        t = self.graph.run(graph.Turn(question, root, plan, "\n".join(lines)), allow_external, notes)
        answered = turn.distinct(s.get("path") for s in t.sources)
        after = session.add(question, t.answer or "").using(answered, plan.paths)
        return {"plan": plan, "context": t.context, "answer": t.answer, "sources": t.sources, "steps": t.steps, "locks": t.locks, "standalone": t.asked, "session": after}
