"""Retrieval metrics and judged answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)
CRITERIA = ("faithfulness", "answer_relevance", "citation_accuracy")


def resolve_gold(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """questions (url, section_heading, chunk_ids) with the ids of the present corpus; unmatched keep theirs."""
    now = sections.groupBy("url", "section_heading").agg(F.sort_array(F.collect_set("chunk_id")).alias("_now"))
    return questions.join(now, ["url", "section_heading"], "left").withColumn("chunk_ids", F.coalesce("_now", "chunk_ids")).drop("_now")


def score_questions(hits: DataFrame, gold: DataFrame, cuts=CUTS, id_col: str = "chunk_id") -> DataFrame:
    """query_id, k, hit, recall, precision, mrr from hits (query_id, id, rank) and gold (query_id, id).

    Precision divides by what was retrieved, which may be less than k; without gold recall is 0."""
    sizes = gold.groupBy("query_id").agg(F.count_distinct(id_col).alias("gold"))
    marked = hits.join(gold.select("query_id", id_col, F.lit(1).alias("right")).distinct(), ["query_id", id_col], "left")
    marked = marked.withColumn("k", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= k")
    found = marked.groupBy("query_id", "k").agg(F.count("*").alias("n"), F.count("right").alias("overlap"), F.min(F.when(F.col("right") == 1, F.col("rank"))).alias("first"))
    asked = sizes.withColumn("k", F.explode(F.array(*map(F.lit, cuts))))
    rows = asked.join(found, ["query_id", "k"], "left")
    return rows.select(
        "query_id",
        "k",
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.col("overlap") / F.col("gold"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("overlap") / F.col("n"), F.lit(0.0)).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def breakdown(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean metrics by k, in all and for each column of by, from one pass with grouping sets; part names the column."""
    view = scores.groupingSets([["k"], *(["k", c] for c in by)], "k", *by)
    means = view.agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("hit", "recall", "precision", "mrr")))
    part, value = F.lit("all"), F.lit("")
    for i, c in enumerate(by):
        own = F.col("_g").bitwiseAND(F.lit(1 << (len(by) - 1 - i))) == 0
        part, value = F.when(own, F.lit(c)).otherwise(part), F.when(own, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise(value)
    return means.select("k", part.alias("part"), value.alias("value"), "n", "hit", "recall", "precision", "mrr")


def lowest(scores: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """The n questions with the least mean of a metric."""
    return scores.groupBy("query_id").agg(F.round(F.avg(metric), 6).alias(f"mean_{metric}")).orderBy(f"mean_{metric}", "query_id").limit(n)


def judge_summary(judgements: DataFrame, questions: DataFrame) -> DataFrame:
    """criterion, n, mean (3 digits) over judged questions."""
    joined = judgements.join(questions.select("id"), "id")
    long = joined.unpivot(["id"], [c for c in CRITERIA if c in judgements.columns], "criterion", "score")
    return long.where("score IS NOT NULL").groupBy("criterion").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"))


def parse_scores(answer: str) -> dict[str, float]:
    """Scores of a judge's answer: JSON, flat or {"criterion": {"score": n}}, fenced or not, else "name: n".

    Raises ValueError if a criterion has no score from 1 to 5."""
    text = re.sub(r"^\s*```\w*|```\s*$", "", answer or "", flags=re.M)
    try:
        found = json.loads(re.search(r"\{.*\}", text, re.S).group())
    except (AttributeError, ValueError):
        found = {}
    plain = lambda name: re.sub(r"[^a-z]", "", str(name).lower())
    if len(found) == 1 and isinstance(inner := next(iter(found.values())), dict) and plain(next(iter(found))) not in map(plain, CRITERIA):
        found = inner
    known = {plain(k): v.get("score") if isinstance(v, dict) else v for k, v in found.items()}
    out = {}
    for c in CRITERIA:
        value = known.get(plain(c))
        if value is None and (m := re.search(c.replace("_", r"[\W_]*") + r"\W+(\d(?:\.\d+)?)", text, re.I)):
            value = m.group(1)
        try:
            value = float(value)
        except (TypeError, ValueError):
            raise ValueError(f"no score for {c}") from None
        if not 1 <= value <= 5:
            raise ValueError(f"score for {c} is out of range")
        out[c] = value
    return out
