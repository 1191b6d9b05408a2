"""Mixing sources to target weights by temperature.

Sources hold shares p of all tokens.  Their weights are p ** a, normalised.  The exponent a in [0, 1] is
bisected: the largest one whose weights reach the target entropy (as a share of the logarithm of the
number of sources), raised as far as the repetition limit asks.  A weight times the budget is what a source
has to give.  It is given as epochs, each a permutation of the source's blocks; the last one stops when the
budget is spent: whole blocks first, then rows of the block in which it runs out, never more than is left.

Without a budget the source repeated least is read exactly once, so that every row is kept.

Blocks are hashes of rows, BLOCKS for a source at most, so all tables but the rows themselves are small:
one row for a source, or for a block and epoch.  Sources are never collected; each round of the bisection
is one aggregation over them that tries 63 exponents, six halvings at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, materialize

TARGET_ENTROPY, MAX_REPEATS = 0.9, 4.0
BLOCKS, ROWS_A_BLOCK = 1024, 64
#: The plan of blocks is broadcast if it has no more rows than this (under 100 bytes each).
BROADCAST_ROWS = 500_000
ROUNDS = 7


def token_count(column):
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _statistics(sources: DataFrame, exponents: list[float], budget: float | None):
    """[(exponent, entropy share, most repeats)] of the weights at each exponent."""
    tried = (
        sources.where("tokens > 0")
        .select("tokens", (F.log("tokens") - F.log("all_tokens")).alias("lp"), "all_tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .groupBy("a")
        .agg(
            F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"),
            F.sum(F.exp(F.col("a") * F.col("lp")) * F.col("a") * F.col("lp")).alias("zl"),
            F.count("*").alias("n"),
            F.min(F.exp((F.col("a") - 1) * F.col("lp"))).alias("least"),
            F.max(F.exp((F.col("a") - 1) * F.col("lp"))).alias("most"),
            F.max("all_tokens").alias("total"),
        )
        .orderBy("a")
        .collect()
    )
    out = []
    for r in tried:
        entropy = (math.log(r["z"]) - r["zl"] / r["z"]) / math.log(r["n"]) if r["n"] > 1 else 1.0
        repeats = r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / r["total"]
        out.append((r["a"], entropy, repeats))
    return out


def find_exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget: float | None) -> float:
    """Exponent in [0, 1]; 1 (the shares as they are) if no other meets the repetition limit."""

    def bisect(wanted_above) -> float:
        """Boundary between exponents that are too low and those that will do, or the reverse."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / 64 for i in range(65)]
            above = [wanted_above(s) for s in _statistics(sources, grid, budget)]
            if all(above):
                return low
            if not any(above):
                return high
            first = above.index(True)
            low, high = grid[max(0, first - 1)], grid[first]
        return high

    if not sources.where("tokens > 0").limit(2).count() > 1:
        return 1.0
    slack = 1e-9
    even = bisect(lambda s: s[1] < target_entropy - slack)
    rare = bisect(lambda s: s[2] <= max_repeats * (1 + slack))
    return max(even, rare)


def source_plan(sources: DataFrame, exponent: float, budget: float | None) -> DataFrame:
    """sources with give: tokens that each has to give in all."""
    raised = sources.withColumn("raised", F.when(F.col("tokens") > 0, F.exp(exponent * (F.log("tokens") - F.log("all_tokens")))).otherwise(0.0))
    if budget is None:
        everything = raised.where("tokens > 0").agg(F.min(F.col("raised") / F.col("tokens")).alias("unit"))
    else:
        everything = raised.agg((F.sum("raised") / F.lit(float(budget))).alias("unit"))
    unit = everything.first()["unit"]
    give = F.col("raised") / F.lit(unit) if unit else F.col("tokens").cast("double")
    return raised.withColumn("give", F.round(give, 3)).withColumn(
        "epochs", F.greatest(F.lit(1), F.ceil(F.round(F.col("give") / F.greatest("tokens", F.lit(1)), 9))).cast("int")
    )


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget: float | None = None,
    seed: int = 0,
) -> tuple[DataFrame, dict[str, str]]:
    """(rows, names): the rows of docs as often as the mixture takes them, with three further columns.

    names tells what the columns are called: epoch, tokens, and position, by which the mixture is ordered
    (its share of the source's tokens given before the row).  Null is a source like any other; a source
    without tokens is given once; rows that repeat are taken each; an empty table gives no rows; other
    columns are handed on."""
    name = {k: free_name(docs, f"mix_{k}") for k in ("epoch", "tokens", "position", "source", "hash", "block")}
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    rows = docs.withColumns(
        {
            name["source"]: key,
            name["tokens"]: token_count(F.col(text_col)),
            name["hash"]: F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_col),
        }
    )
    slim = materialize(rows.select(*(F.col(name[k]).alias(k) for k in ("source", "tokens", "hash"))))
    per_source = slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    everything = per_source.agg(F.sum("tokens")).first()[0] or 0
    sources = materialize(per_source.withColumn("all_tokens", F.lit(everything)))
    exponent = find_exponent(sources, target_entropy, max_repeats, budget)
    # beyond BLOCKS as many blocks as each has rows: neither the order of blocks nor that within one grows large
    blocks = F.least(F.greatest(F.lit(BLOCKS), F.ceil(F.sqrt("rows"))), F.ceil(F.col("rows") / ROWS_A_BLOCK)).cast("int")
    plan = materialize(source_plan(sources, exponent, budget).withColumn("blocks", blocks))
    count = plan.agg(F.sum(F.col("blocks") * F.col("epochs"))).first()[0] or 0
    hint = F.broadcast if count <= BROADCAST_ROWS else lambda df: df

    in_block = slim.join(hint(plan.select("source", "blocks")), "source").withColumn("block", F.pmod("hash", "blocks"))
    order = W.partitionBy("source", "epoch").orderBy("shuffled", "block")
    steps = materialize(
        in_block.groupBy("source", "block")
        .agg(F.sum("tokens").alias("block_tokens"))
        .join(hint(plan.select("source", "blocks", "epochs", "give", F.col("tokens").alias("source_tokens"))), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("shuffled", F.xxhash64(F.lit(seed), "source", "epoch", "block"))
        .withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
        .withColumn("room", F.floor(F.col("give") - F.col("epoch") * F.col("source_tokens") - F.col("before")))
        .withColumn("whole", F.col("room") >= F.col("block_tokens"))
        .where("whole OR room > 0 OR (source_tokens = 0 AND epoch = 0)")
        .select("source", "block", "blocks", "epoch", "room", F.expr("whole OR source_tokens = 0").alias("whole"), "before", "block_tokens", "source_tokens", "give")
    )
    n = name
    c = {k: free_name(docs, f"mix_step_{k}") for k in steps.columns}
    steps = hint(steps.select(*(F.col(k).alias(v) for k, v in c.items())))
    block_of = hint(plan.select(F.col("source").alias(n["source"]), F.col("blocks").alias(n["block"])))
    rows = rows.join(block_of, n["source"]).withColumn(n["block"], F.pmod(n["hash"], n["block"]))
    taken = rows.join(steps, (F.col(n["source"]) == F.col(c["source"])) & (F.col(n["block"]) == F.col(c["block"])))
    inside = (F.pmod(n["hash"], F.lit(1 << 20)) / float(1 << 20)) * F.col(c["block_tokens"])
    position = F.col(c["epoch"]) * F.col(c["source_tokens"]) + F.col(c["before"]) + inside
    result = [F.col(x) for x in docs.columns] + [
        F.col(c["epoch"]).alias(n["epoch"]),
        F.col(n["tokens"]),
        F.when(F.col(c["give"]) > 0, F.least(position / F.col(c["give"]), F.lit(1.0))).otherwise(0.0).alias(n["position"]),
    ]
    in_turn = W.partitionBy(n["source"], n["block"], c["epoch"]).orderBy(F.xxhash64(c["epoch"], n["hash"]), n["hash"])
    spent = free_name(docs, "mix_spent")
    cut = (
        taken.where(~F.col(c["whole"]))
        .withColumn(spent, F.sum(n["tokens"]).over(in_turn.rowsBetween(W.unboundedPreceding, 0)))
        .where(F.col(spent) <= F.col(c["room"]))
    )
    return taken.where(c["whole"]).select(*result).unionByName(cut.select(*result)), {k: n[k] for k in ("epoch", "tokens", "position")}
