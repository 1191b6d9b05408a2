"""Which pictures of a document are worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the rules, in bytes, pixels, points and inches.
MIN_BYTES, MIN_SIDE, MIN_AREA = 1024, 96, 12000
MAX_ASPECT, MIN_INK = 8.0, 0.005
MIN_POINTS, MIN_POINTS_AREA = 48, 4000
MIN_INCHES, MIN_INCHES_AREA = 0.9, 0.8
REPEATS, REPEATED_AREA = 3, 200000
INK_DELTA = 16


def reject_reason(bytes_: Column, width: Column, height: Column, ink: Column, points: tuple[Column, Column], inches: tuple[Column, Column], occurrences: Column) -> Column:
    """The first rule that a picture breaks, null if it is kept; unknown sizes on the page break none."""
    area = width * height
    aspect = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    small = lambda s, least, whole: (s[0] < least) | (s[1] < least) | (s[0] * s[1] < whole)
    return (
        F.when(bytes_ < MIN_BYTES, "tiny_file")
        .when((width < MIN_SIDE) | (height < MIN_SIDE), "too_small")
        .when(area < MIN_AREA, "too_small_area")
        .when(aspect > MAX_ASPECT, "thin")
        .when(ink < MIN_INK, "blank")
        .when(small(points, MIN_POINTS, MIN_POINTS_AREA), "small_on_page")
        .when(small(inches, MIN_INCHES, MIN_INCHES_AREA), "small_on_page")
        .when((occurrences >= REPEATS) & (area < REPEATED_AREA), "repeated")
    )


def with_occurrences(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("occurrences", F.count("*").over(W.partitionBy("file_id", "sha256")))


def reject_histogram(judged: DataFrame) -> DataFrame:
    """file_id and rejected, a map from reason to count."""
    counts = judged.where("reason IS NOT NULL").groupBy("file_id", "reason").count()
    return counts.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("rejected"))


def pixel_metrics(samples: DataFrame, key: str) -> DataFrame:
    """key, entropy (bits), ink: share of samples that differ from the commonest value by more than INK_DELTA.

    samples: key, value; of values equally common the smallest counts as the commonest."""
    counts = samples.groupBy(key, "value").agg(F.count("*").alias("n"))
    shares = counts.groupBy(key).agg(
        F.sum("n").alias("total"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.collect_list(F.struct("value", "n")).alias("bins")
    )
    entropy = F.aggregate("bins", F.lit(0.0), lambda s, x: s - (x["n"] / F.col("total")) * F.log2(x["n"] / F.col("total")))
    ink = F.aggregate("bins", F.lit(0), lambda s, x: s + F.when(F.abs(x["value"] - F.col("mode")) > INK_DELTA, x["n"]).otherwise(0).cast("int")) / F.col("total")
    return shares.select(key, F.round(entropy, 6).alias("entropy"), F.round(ink, 6).alias("ink"))
