"""What changed on disk, and bringing the index in line with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_VERSION = "1"
KEY = ["root", "path"]


def diff(disk: DataFrame, state: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """root, path, change (added, modified, deleted, unchanged) from disk (size, mtime_ns) and state.

    A file is modified if its size, time or index version differs, or if its state is not indexed."""
    d = disk.select(*KEY, F.col("size").alias("d_size"), F.col("mtime_ns").alias("d_mtime"), F.lit(True).alias("on_disk"))
    s = state.select(*KEY, "size", "mtime_ns", "status", "index_version", F.lit(True).alias("in_state"))
    same = (F.col("size") == F.col("d_size")) & (F.col("mtime_ns") == F.col("d_mtime")) & (F.col("index_version") == version) & (F.col("status") == "indexed")
    change = (
        F.when(F.col("in_state").isNull(), "added")
        .when(F.col("on_disk").isNull(), "deleted")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("modified")
    )
    return d.join(s, KEY, "full_outer").select(*KEY, change.alias("change"))


def confirm(changes: DataFrame, hashes: DataFrame, state: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Modified files whose content is the one indexed become touched: only size and time are refreshed."""
    known = state.select(*KEY, F.col("content_hash").alias("known"), "status", "index_version")
    joined = changes.join(hashes.select(*KEY, "content_hash"), KEY, "left").join(known, KEY, "left")
    touched = (F.col("change") == "modified") & (F.col("content_hash") == F.col("known")) & (F.col("status") == "indexed") & (F.col("index_version") == version)
    return joined.select(*KEY, F.when(F.coalesce(touched, F.lit(False)), "touched").otherwise(F.col("change")).alias("change"), "content_hash")


def next_state(state: DataFrame, disk: DataFrame, outcome: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """State after a run.  outcome: root, path, change, content_hash, error.

    An error keeps the hash and version of before, so that status alone brings the file back."""
    old = state.select(*KEY, *(F.col(c).alias(f"o_{c}") for c in ("size", "mtime_ns", "content_hash", "status", "index_version")))
    rows = outcome.join(disk.select(*KEY, "size", "mtime_ns"), KEY, "left").join(old, KEY, "left").where("change <> 'deleted'")
    failed, fresh = F.col("error").isNotNull(), F.col("change").isin("added", "modified")
    pick = lambda new, kept: F.when(failed, F.col(f"o_{kept}")).when(fresh, new).otherwise(F.col(f"o_{kept}"))
    return rows.select(
        *KEY,
        F.coalesce("size", "o_size").alias("size"),
        F.coalesce("mtime_ns", "o_mtime_ns").alias("mtime_ns"),
        pick(F.col("content_hash"), "content_hash").alias("content_hash"),
        F.when(failed, "error").when(fresh, "indexed").otherwise(F.col("o_status")).alias("status"),
        pick(F.lit(version), "index_version").alias("index_version"),
    )


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """old without the keys of touched (default: those of new), and new."""
    gone = (touched if touched is not None else new).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def pending_texts(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts without an embedding of the model."""
    have = cache.where(F.col("model") == model).select("text_sha")
    return chunks.select(F.sha2("text", 256).alias("text_sha"), "text").dropDuplicates(["text_sha"]).join(have, "text_sha", "left_anti")


def prune_cache(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cache rows whose text is still in a chunk."""
    return cache.join(chunks.select(F.sha2("text", 256).alias("text_sha")).distinct(), "text_sha", "left_semi")


def needs_pruning(cached: int, live: int, ratio: float = 1.5, extra: int = 200) -> bool:
    return cached > ratio * live + extra


def last_embeddings(cache: DataFrame) -> DataFrame:
    """One row for each model and text, the one written last."""
    return cache.groupBy("model", "text_sha").agg(F.max_by("embedding", "pos").alias("embedding"))


def status_counts(state: DataFrame) -> DataFrame:
    """Files by status, and in all (status 'total')."""
    return state.rollup("status").count().select(F.coalesce("status", F.lit("total")).alias("status"), F.col("count").alias("files"))


def collapse_changes(events: DataFrame) -> DataFrame:
    """One action for each path of a batch: upsert beats delete."""
    return events.groupBy("scope", "path").agg(F.max("action").alias("action"))
