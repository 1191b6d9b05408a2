"""Sharding by extendible hashing, on DataFrames only.

A row's hash is the first 60 bits of an MD5 digest.  A shard is a prefix of it.  Only a shard with more
bytes than the limit is split, on its next bit, until each fits.  The directory is indexed by prefix bits
in pages of PAGE_BITS: a first page over all rows, a further page under each of its entries that is still
too large, and so on; each page is one aggregation of (prefix, bytes), whose size does not depend on the
number of rows.  Rows find their shard by joining their prefix with the pages.

Rows of one hash cannot be told apart by more bits; they stay together, over the limit if need be, and
are marked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS, PAGE_BITS = 60, 12
LIMIT = 1 << 20


def hashed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, bytes of the text, and hash of id and text, so that rows that repeat an id can part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
    )


def _page(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """Entries of the pages at `base` bits: entry (prefix of base + PAGE_BITS bits), depth, over.

    depth counts the prefixes above the entry, from base on, that are too large; over says that the entry
    itself still is."""
    below = base + PAGE_BITS
    cells = materialize(
        rows.groupBy(F.shiftright("hash", BITS - below).alias("entry")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
    )
    paths = cells.select(
        "entry", "bytes", "lo", "hi", F.explode(F.sequence(F.lit(base), F.lit(below))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(entry, CAST({below} - depth AS INT))"))
    large = (
        paths.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .where((F.col("bytes") > limit) & (F.col("lo") != F.col("hi")))
        .select("depth", "prefix", F.lit(1).alias("large"))
    )
    return materialize(
        paths.join(large, ["depth", "prefix"], "left")
        .groupBy("entry")
        .agg((F.lit(base) + F.count("large")).cast("int").alias("depth"), F.max(F.when(F.col("depth") == below, F.col("large"))).isNotNull().alias("over"))
    )


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard (its prefix in binary digits; empty: all rows), depth, shard_bytes, oversized of each row.

    Null ids and texts count as empty ones; repeated rows are kept, in one shard; a single text over the
    limit is a shard of its own, oversized; an empty table gives no rows; other columns are not read."""
    rows = materialize(hashed_rows(docs, id_col, text_col))
    placed, todo, base = [], rows, 0
    while True:
        page = _page(todo, base, limit)
        below = base + PAGE_BITS
        last = below >= BITS
        found = todo.withColumn("entry", F.shiftright("hash", BITS - below)).join(page, "entry")
        done = found if last else found.where("NOT over")
        placed.append(done.select("doc_id", "bytes", "hash", F.least("depth", F.lit(BITS)).alias("depth")))
        if last or not page.where("over").limit(1).count():
            break
        todo = materialize(found.where("over").select("doc_id", "bytes", "hash"))
        base = below
    all_rows = reduce(DataFrame.unionByName, placed).withColumn(
        "shard", F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(hash, CAST({BITS} - depth AS INT))), depth, '0') END")
    )
    sizes = all_rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return all_rows.join(sizes, "shard").select(
        "doc_id", "bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized")
    )


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
large AS (
  SELECT d, hash >> ({BITS} - d) AS prefix FROM r, range(0, {BITS}) AS g(d)
  GROUP BY ALL HAVING sum(bytes) > {LIMIT} AND min(hash) <> max(hash)),
deep AS (SELECT hash, count(large.d) AS depth FROM (SELECT DISTINCT hash FROM r), range(0, {BITS}) AS g(k)
  LEFT JOIN large ON large.d = k AND large.prefix = hash >> ({BITS} - k) GROUP BY hash),
placed AS (
  SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth,
         CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(hash), {BITS}, '0')[:CAST(depth AS INTEGER)], CAST(depth AS INTEGER)) END AS shard
  FROM r JOIN deep USING (hash)),
sizes AS (SELECT shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM placed GROUP BY shard)
SELECT doc_id, bytes, shard, depth, shard_bytes, shard_bytes > {LIMIT} AS oversized FROM placed JOIN sizes USING (shard)
"""
