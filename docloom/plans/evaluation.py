"""Evaluation runs: retrievers by name over a set of questions, their hits kept, and a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import evaluate

from .engine import Engine

HITS = "retriever string, root string, indexed_at long, question string, k int, chunk_ids array<string>"
RUN = "query_id string, rank int, chunk_id string"

#: name -> (engine, question, root, k) -> hits with chunk_id and rank
Retriever = Callable[[Engine, str, str, int], DataFrame]
RETRIEVERS: dict[str, Retriever] = {
    "vector": lambda engine, question, root, k: engine.dense_search(question, root, k=k),
    "hybrid": lambda engine, question, root, k: engine.search(question, root, k=k),
}


class Evaluation:
    """Runs over one folder of an engine.  Hits are kept below the engine's home by retriever, question and state of the
    index: a changed index is asked again.  Questions are a bounded set and asked one by one, as users would."""

    def __init__(self, engine: Engine, root: str, retrievers: dict[str, Retriever] | None = None, clock: Callable[[], float] = time.perf_counter):
        self.engine, self.root, self.clock = engine, root, clock
        self.retrievers = RETRIEVERS if retrievers is None else retrievers
        self.path = f"{engine.home}/evaluated"

    def _kept(self, name: str, stamp: int) -> dict[str, tuple[int, list[str]]]:
        try:
            rows = self.engine.spark.read.schema(HITS).parquet(self.path)
        except AnalysisException:
            return {}
        own = rows.where((F.col("retriever") == name) & (F.col("root") == self.root) & (F.col("indexed_at") == stamp))
        best = own.groupBy("question").agg(F.max(F.struct("k", "chunk_ids")).alias("x"))
        return {r["question"]: (r["x"]["k"], r["x"]["chunk_ids"]) for r in best.collect()}

    def run(self, questions: list[tuple[str, str]], name: str, k: int, use_kept: bool = True) -> tuple[DataFrame, dict[str, float | None]]:
        """Hits (query_id, rank, chunk_id) of the questions (id, text), and milliseconds by id: None where hits were kept."""
        spark = self.engine.spark
        stamp = self.engine.state.where(F.col("root") == self.root).agg(F.max("indexed_at")).first()[0] or 0
        kept = self._kept(name, stamp) if use_kept else {}
        took, rows, new = {}, [], []
        for key, text in questions:
            held, ids = kept.get(text, (0, []))
            took[key] = None
            if held < k:
                start = self.clock()
                ids = [r["chunk_id"] for r in self.retrievers[name](self.engine, text, self.root, k).select("rank", "chunk_id").orderBy("rank").collect()]
                took[key] = (self.clock() - start) * 1000
                new.append((name, self.root, stamp, text, k, ids))
                kept[text] = (k, ids)
            rows += [(key, n, i) for n, i in enumerate(ids[:k], 1)]
        if new:
            spark.createDataFrame(new, HITS).coalesce(1).write.mode("append").parquet(self.path)
        return spark.createDataFrame(rows, RUN), took

    def report(self, questions: DataFrame, names: list[str] | None = None, cuts=evaluate.CUTS, use_kept: bool = True) -> dict:
        """Metrics of each retriever by k, in all and by category and difficulty, and those of each question.

        questions: id, question, category, difficulty, url, section_heading, chunk_ids; gold is looked up by section in the
        present index first.  Latency is the mean over questions really asked, 0 if there are none."""
        spark, cuts = self.engine.spark, sorted(set(cuts))
        sections = self.engine.chunks.where(F.col("root") == self.root).select("url", "section_heading", "chunk_id")
        rows = evaluate.resolve_gold(questions, sections).select("id", "question", "category", "difficulty", "chunk_ids").orderBy("id").collect()
        gold = spark.createDataFrame([(r["id"], c) for r in rows for c in r["chunk_ids"] or []], "query_id string, chunk_id string")
        about = spark.createDataFrame([(r["id"], r["category"], r["difficulty"]) for r in rows], "query_id string, category string, difficulty string")
        out = {}
        for name in names or list(self.retrievers):
            hits, took = self.run([(r["id"], r["question"]) for r in rows], name, cuts[-1], use_kept)
            scores = evaluate.score_questions(hits, gold, cuts).join(F.broadcast(about), "query_id").cache()  # one row a question and k
            real = [t for t in took.values() if t is not None]
            out[name] = {
                "summary": [r.asDict() for r in evaluate.breakdown(scores, ["category", "difficulty"]).orderBy("k", "part", "value").collect()],
                "latency_ms": sum(real) / len(real) if real else 0.0,
                "per_question": [r.asDict() | {"latency_ms": took[r["query_id"]]} for r in scores.orderBy("query_id", "k").collect()],
            }
            scores.unpersist()
        return {"created_at": datetime.now(UTC).isoformat(), "cuts": cuts, "questions": len(rows), "results": out}
