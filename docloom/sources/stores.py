"""Tables the engine keeps: embedding cache, raw tables, questions, reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.sync import last_embeddings

CACHE_SCHEMA = "model string, text string, embedding array<float>, appended_ns long"
QUESTION = (
    "id string, question string, category string, difficulty string, reference_answer string,"
    " gold struct<url:string, section_heading:string, chunk_ids:array<string>>"
)


def load_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Embeddings of a model from JSON lines; of equal texts the line appended last counts, in one file the last line."""
    lines = spark.read.schema(CACHE_SCHEMA).json(path).where(F.col("model") == model)
    lines = lines.withColumns({"text_sha": F.sha2("text", 256), "pos": F.struct(F.coalesce("appended_ns", F.lit(0)), F.input_file_name(), F.monotonically_increasing_id())})
    return last_embeddings(lines)


def append_cache(embedded: DataFrame, path: str) -> None:
    embedded.select("model", "text", "embedding", F.lit(time.time_ns()).alias("appended_ns")).write.mode("append").json(path)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("multiLine", True).schema(f"questions array<struct<{_as_struct(QUESTION)}>>").json(path)
    return read.select(F.explode("questions").alias("q")).select("q.*").select("*", "gold.url", "gold.section_heading", "gold.chunk_ids").drop("gold")


def _as_struct(ddl: str) -> str:
    """Top-level "name type" pairs as "name:type"."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ", ".join(out)


def write_partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that rows has are replaced; each is written as a whole or not at all."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ("root",))).parquet(path)


def raw_table(tables: DataFrame, table_id: str) -> dict | None:
    row = tables.where((F.col("file_id") == table_id[:32]) & (F.col("table_id") == table_id)).first()
    return row.asDict(recursive=True) if row else None


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
