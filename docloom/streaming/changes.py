"""Change events of files: quiet periods, coalesced batches, and applying them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTLE_TIMES = 5
EVENT = "scope string, action string, path string, ts timestamp"


def debounce(events: DataFrame, keys: list[str], gap: str, action_col: str = "action", order_col: str = "ts") -> DataFrame:
    """One row for each run of events that no gap parts: the last action, first and last time, number of events.

    Works on tables and, with a watermark on ts, on streams."""
    return (
        events.groupBy(*keys, F.session_window("ts", gap).alias("_w"))
        .agg(F.max_by(action_col, order_col).alias("action"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
        .drop("_w")
    )


def effective(events: DataFrame, active_scope: str | None, suffixes: tuple[str, ...]) -> DataFrame:
    """Events of the scope now watched, on files that are supported and not hidden."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kept = events.where(~F.col("path").rlike(r"(^|/)\.") & ext.isin(*suffixes))
    return kept if active_scope is None else kept.where(F.col("scope") == active_scope)


def coalesce(events: DataFrame, quiet_ms: int = 1000) -> DataFrame:
    """Stream of batches (scope, batch, action, path): the last action on each path of a scope.

    A batch ends when nothing came for quiet_ms, or SETTLE_TIMES as long after it began."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        begun, paths, actions, number = state.get if state.exists else (0, [], [], 0)
        now = state.getCurrentProcessingTimeMs()
        held = dict(zip(paths, actions))
        late = state.hasTimedOut
        if not late:
            rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
            begun = begun or now
            for path, action in zip(rows["path"], rows["action"]):
                held.pop(path, None)
                held[path] = action
            late = now - begun >= SETTLE_TIMES * quiet_ms
        if late and held:
            state.update((0, [], [], number + 1))
            yield pd.DataFrame({"scope": key[0], "batch": number, "action": list(held.values()), "path": list(held)})
        elif held:
            state.update((begun, list(held), list(held.values()), number))
            state.setTimeoutDuration(max(1, min(quiet_ms, begun + SETTLE_TIMES * quiet_ms - now)))

    return events.groupBy("scope").applyInPandasWithState(
        step, "scope string, batch long, action string, path string", "begun long, paths array<string>, actions array<string>, number long", "append", "ProcessingTimeTimeout"
    )


def snapshot_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """Events between two snapshots (root, path, size, mtime_ns): upsert for new or changed files, delete for gone ones."""
    old, new = before.alias("o"), now.alias("n")
    joined = old.join(new, (F.col("o.root") == F.col("n.root")) & (F.col("o.path") == F.col("n.path")), "full_outer")
    same = (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime_ns") == F.col("n.mtime_ns"))
    action = F.when(F.col("n.path").isNull(), "delete").when(~F.coalesce(same, F.lit(False)), "upsert")
    return joined.select(F.coalesce("n.root", "o.root").alias("scope"), action.alias("action"), F.coalesce("n.path", "o.path").alias("path")).where("action IS NOT NULL")


def apply_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Started query that hands each micro-batch to apply(rows, batch id)."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()
