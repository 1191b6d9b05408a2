"""Near-duplicate detection with SimHash fingerprints and deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at most two bits,
one of the segments differs in at most one bit.  The index therefore holds each segment as it is, and
once for each of its bits with that bit as a wildcard; equal index keys propose pairs, which a bit count
verifies.  Keys shared by more than BUCKET fingerprints are not paired off: their members are indexed
again by whole fingerprints with one bit flipped.  Two fingerprints at two bits or fewer share such a
key, all holders of one key (65 at most) are within two bits of each other, and a star over them links
the same fingerprints as all pairs would.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, materialize

SEED = 42
SEGMENT_BITS = 32
BUCKET = 16
HOT = 1000
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words (lower-cased A-Z, split at ASCII white space), repeats included.

    Fewer words: one hash of all of them.  None or no word: an empty array."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    join = b" ".join
    runs = zip(*(words[i:] for i in range(width)))
    return np.fromiter((digest(join(run), SEED) for run in runs), np.uint64, len(words) - width + 1)


def simhash64(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; none: 0."""
    if not len(hashes):
        return 0
    columns = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_column(column, width: int):
    """Fingerprint of each text as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = [simhash64(shingle_hashes(t, width)) for t in texts]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return of(column)


def hex_column(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _index(prints: DataFrame) -> DataFrame:
    """66 keys a fingerprint: 2 segments x (32 wildcard positions, and position 32: none).

    side is the bit under the wildcard; only fingerprints on different sides of a key still need to be
    compared, since those on the same side meet under the key without a wildcard."""
    at = F.col("slot") % (SEGMENT_BITS + 1)
    half = F.expr(
        f"shiftrightunsigned(fp, CAST(slot DIV {SEGMENT_BITS + 1} AS INT) * {SEGMENT_BITS}) & {2**SEGMENT_BITS - 1}L"
    )
    return (
        prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS + 1))).alias("slot"))
        .withColumns({"half": half, "at": at.cast("int")})
        .withColumns(
            {
                "side": F.expr(f"CASE WHEN at = {SEGMENT_BITS} THEN 2 ELSE CAST(shiftright(half, at) & 1L AS INT) END"),
                "masked": F.expr(f"CASE WHEN at = {SEGMENT_BITS} THEN half ELSE half & ~shiftleft(1L, at) END"),
            }
        )
        .select("fp", "side", F.expr(f"shiftleft(CAST(slot AS BIGINT), {SEGMENT_BITS}) | masked").alias("key"))
    )


def near_links(prints: DataFrame) -> DataFrame:
    """Links (u, v), u < v, between distinct fingerprints `fp` of prints.

    Linked are pairs at 1 or 2 differing bits.  For members of overfull keys a spanning star replaces
    the pairs, so connected components (not the number of links) are those of all pairs."""
    index = _index(prints)
    keys = materialize(
        index.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.min("fp").alias("lo"),
            F.max("fp").alias("hi"),
            F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("ones"),
            F.min("side").alias("least_side"),
        )
        .where("n > 1 AND (least_side = 2 OR (ones > 0 AND ones < n))")
    )
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    two = keys.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v")).where(within("u", "v"))
    few = (
        index.join(keys.where(f"n BETWEEN 3 AND {BUCKET}").select("key"), "key")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("fp", "side"))).alias("bucket"))
        .select(
            F.explode(
                F.expr(
                    "flatten(transform(bucket, (x, i) -> transform(filter(bucket, y -> y.fp > x.fp"
                    " AND (x.side = 2 OR x.side <> y.side) AND bit_count(x.fp ^ y.fp) <= 2),"
                    " y -> named_struct('u', x.fp, 'v', y.fp))))"
                )
            ).alias("link")
        )
        .select("link.u", "link.v")
    )
    crowded = index.join(keys.where(f"n > {BUCKET}").select("key"), "key").select("fp").distinct()
    flips = (
        crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
        .select("fp", F.expr("CASE WHEN bit < 0 THEN fp ELSE fp ^ shiftleft(1L, bit) END").alias("middle"))
        .groupBy("middle")
        .agg(F.array_sort(F.collect_set("fp")).alias("bucket"))
        .where("size(bucket) > 1")
        .select(F.col("bucket")[0].alias("u"), F.explode(F.expr("slice(bucket, 2, size(bucket) - 1)")).alias("v"))
    )
    return two.unionByName(few).unionByName(flips).distinct()


def join_by_key(big: DataFrame, small: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """big joined with small, which has one row for a key and in count_col how many of the `total` rows of big have it.

    Keys with more than 1 / HOT of all rows, which HOT keys at most can be, are broadcast, so that no task gets
    all rows of such a key."""
    hot = F.col(count_col) * HOT > total
    few, rest = F.broadcast(small.where(hot).drop(count_col)), small.where(~hot).drop(count_col)
    return big.join(few, key).unionByName(big.join(few.select(key), key, "left_anti").join(rest, key))


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node reachable.

    Alternating large-star and small-star steps over the links (u, v); each round is written to the
    shared folder.  No task needs the links of one node together: least neighbours are aggregated
    before the shuffle, and the join that hands them back can be split."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = materialize(links.where("u <> v").select("u", "v"))
    before = state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_key(both, least, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = materialize(small)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def cluster_prints(prints: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with component_id: the least doc_id reachable over links of at most 2 bits.

    Equal fingerprints are linked.  A component whose doc_ids are all null has the id null."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(near_links(classes.select("fp")))
    merged = materialize(roots.join(classes.select(F.col("fp").alias("node"), "first_id"), "node"))
    least = merged.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    of_linked = join_by_key(merged, least, "root", "n", merged.count()).select(F.col("node").alias("fp"), "component_id")
    ids = classes.join(of_linked, "fp", "left").select(
        "fp", "n", F.when(F.col("component_id").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return join_by_key(prints, materialize(ids), "fp", "n", prints.count())


def simhash_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Null and wordless texts have fingerprint zero and are linked like any other; repeated rows are kept
    and share a component; an empty table gives no rows; other columns of docs are not read."""
    prints = materialize(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp"))
    )
    return cluster_prints(prints).select("doc_id", hex_column("fp").alias("fingerprint"), "component_id")


# Near copies at a Jaccard similarity, for which 64 bits are too few: at 0.8 over five-word shingles two
# fingerprints differ in about 9 bits.  Fingerprints within two bits are linked first; the rest of the links
# comes from an exact join.  All texts order their shingles alike: those of the list of frequent ones last,
# else by hash.  Texts at the similarity share a shingle among the first of both (their prefixes).

#: Texts from which frequent shingles are told, in how many of them such a shingle is, and the longest list.
#: They only order shingles: any order finds the same links.
ORDER_TEXTS, ORDER_LEAST, ORDER_MOST = 4000, 3, 50_000
#: Tables are broadcast if they have no more rows than this (of 16 bytes each).
BROADCAST_ROWS = 500_000


def prefix_of(distinct: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n sorted distinct shingles in the common order.

    frequent: sorted hashes and their ranks."""
    n = len(distinct)
    if not n:
        return distinct
    least = n - int(np.ceil(similarity * n - 1e-9)) + 1
    hashes, ranks = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        known = hashes[at] == distinct
        if known.any():
            distinct = np.concatenate([distinct[~known], distinct[known][np.argsort(ranks[at[known]])]])
    return distinct[:least]


def parity_of(distinct: np.ndarray) -> bytes:
    """A bitmap with two to four bits for a shingle: whether an odd number of shingles has that place.

    Its halves laid over each other (exclusive or) are the bitmap of half the size."""
    bits = 64
    while bits < 2 * len(distinct):
        bits *= 2
    places = (distinct & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """By their bitmaps, the least number of shingles that only one of two texts has."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _sketch_column(column, width: int, similarity: float, frequent):
    """Fingerprint, number of distinct shingles, prefix and bitmap of each text."""

    @F.pandas_udf("struct<fp:long, size:int, prefix:array<long>, parity:binary>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        prints, sizes, prefixes, parities = [], [], [], []
        for t in texts:
            h = shingle_hashes(t, width)
            prints.append(simhash64(h))
            h = np.unique(h)
            sizes.append(len(h))
            prefixes.append(prefix_of(h, similarity, frequent.value).view(np.int64))
            parities.append(parity_of(h))
        return pd.DataFrame({"fp": np.array(prints, np.uint64).view(np.int64), "size": np.array(sizes, np.int32), "prefix": prefixes, "parity": parities})

    return sketched(column)


def _may_reach(similarity: float, a, b, size_a, size_b):
    """Whether the bitmaps and sizes of two texts leave room for the similarity."""

    @F.pandas_udf("boolean")
    def room(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        most = (m + n) * (1 - similarity) / (1 + similarity) + 1e-6
        return pd.Series([least_difference(x, y) <= k for x, y, k in zip(a, b, most)])

    return room(a, b, size_a, size_b)


def _set_column(column, width: int):
    """Distinct shingles of a text, as 32-bit hashes."""

    @F.pandas_udf("array<int>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique((shingle_hashes(t, width) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for t in texts], dtype=object)

    return sets(column)


def _frequent_shingles(docs: DataFrame, text, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and ranks (the most frequent last) of the shingles that many of some texts have."""

    @F.pandas_udf("array<long>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts], dtype=object)

    every = max(1, docs.count() // ORDER_TEXTS)
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    found = (
        some.select(F.explode(distinct("text")).alias("token"))
        .groupBy("token")
        .count()
        .where(F.col("count") >= ORDER_LEAST)
        .orderBy(F.desc("count"), "token")
        .limit(ORDER_MOST)
        .collect()
    )
    hashes = np.array([r[0] for r in found], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _room(similarity: float):
    """Condition on a shingle that the texts of u_ and v_ share: their sizes, and what follows the shingle in
    each, leave room for the similarity.  It holds for the first shingle that linked texts share."""
    sizes = F.col("u_size") + F.col("v_size")
    follow = F.least(F.col("u_size") - F.col("u_pos"), F.col("v_size") - F.col("v_pos"))
    alike = F.least("u_size", "v_size") >= similarity * F.greatest("u_size", "v_size") - 1e-6
    return alike & (follow >= F.ceil(similarity / (1 + similarity) * sizes - 1e-6))


def _star_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each text with one other for each shingle that texts of several roots share: with the text
    that has the greatest share of shared shingles, which of near copies is the one they were made from."""
    centre = F.max(F.struct("weight", "node", "root", "size", "pos"))
    centres = shared.groupBy("token").agg(centre.alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    centres = centres.select("token", *(F.col(f"c.{k}").alias(f"v_{k}") for k in ("node", "root", "size", "pos")))
    return _renamed(shared, "u").join(centres, "token").where((F.col("u_root") != F.col("v_root")) & _room(similarity))


def _cross_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """All pairs of texts of different roots for each shingle: each text outside the commonest root of the
    shingle with every other."""
    roots = shared.groupBy("token", "root").agg(F.count("*").alias("n"))
    common = roots.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.count("*").alias("roots")).where("roots > 1")
    marked = materialize(shared.join(common.select("token", "common"), "token"))
    few = _renamed(marked.where("root <> common").drop("common"), "u")
    once = (F.col("v_root") == F.col("common")) | (F.col("u_node") < F.col("v_node"))
    return few.join(_renamed(marked, "v", "common"), "token").where((F.col("u_root") != F.col("v_root")) & once & _room(similarity))


def _renamed(shared: DataFrame, side: str, *others: str) -> DataFrame:
    return shared.select("token", *(F.col(k).alias(f"{side}_{k}") for k in ("node", "root", "size", "pos")), *others)


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node (hash of the text), root for each row of docs: rows of one root are near copies.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least `similarity`.  Links are
    proposed by SimHash fingerprints, then by an exact join of the texts that these leave apart, and verified
    on the whole sets.  Equal texts are linked, null texts are empty ones."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))
    rows = materialize(full.select("doc_id", "node"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_shingles(docs, text, width))
    texts = materialize(full.select("node", _sketch_column(F.col("text"), width, similarity, frequent).alias("s")).select("node", "s.*").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (u, v) among pairs: those with room by their bitmaps, then those with the shingles in common."""
        sketch = lambda c: texts.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
        both = pairs.join(sketch("u"), "u").join(sketch("v"), "v")
        likely = materialize(both.where(_may_reach(similarity, F.col("u_parity"), F.col("v_parity"), F.col("u_size"), F.col("v_size"))).select("u", "v"))
        concerned = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
        one_row = concerned.join(rows.groupBy("node").agg(F.min("doc_id").alias("first_id")), "node")
        sets = materialize(
            full.join(_small(one_row), "node")
            .where(F.col("doc_id").eqNullSafe(F.col("first_id")))
            .select("node", _set_column(F.col("text"), width).alias("shingles"))
            .dropDuplicates(["node"])
        )
        common = F.size(F.array_intersect("a", "b"))
        return materialize(
            likely.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
            .where(common >= similarity * (F.size("a") + F.size("b") - common))
            .select("u", "v")
        )

    prints = materialize(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    first_of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    same_print = join_by_key(texts.select("fp", "node"), prints.where("n > 1"), "fp", "n", texts.count()).select(F.col("first").alias("u"), F.col("node").alias("v"))
    by_print = near_links(prints.select("fp")).join(first_of("u"), "u").join(first_of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    links = verified(same_print.unionByName(by_print))
    roots = materialize(components(links))

    tokens = texts.select("node", F.posexplode("prefix").alias("pos", "token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    shared = materialize(tokens.join(several, "token", "left_semi").select("token", "node", "pos"))
    weights = materialize(texts.select("node", "size").join(shared.groupBy("node").agg(F.count("*").alias("n")), "node").select("node", "size", (F.col("n") / F.col("size")).cast("float").alias("weight")))
    for proposed in (_star_pairs, _cross_pairs):
        nodes = weights.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = proposed(materialize(shared.join(nodes, "node")), similarity)
        more = verified(pairs.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))
        if more.limit(1).count():
            # a link per text and root stands for those that led to the root
            links = materialize(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).where("u <> v"))
            roots = materialize(components(links))
    return rows.join(_small(roots), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the least id (nulls last), then text hash.

    Rows alike in id and text count as one; columns are handed on as they are; an empty table stays empty."""
    classes = materialize(near_copy_classes(docs, id_col, text_col, width, similarity))
    own = materialize(classes.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))
    best = own.groupBy("root").agg(F.min(rank).alias("best"), F.count("*").alias("of_root")).select("root", "best", "of_root")
    loses = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")))
    losers = materialize(join_by_key(own, best, "root", "of_root", own.count()).where(loses).select("doc_id", "node"))
    repeated = materialize(own.where("n > 1").select("doc_id", "node"))
    n, m = free_name(docs, "near_node"), free_name(docs, "near_id")
    keyed = docs.withColumns({n: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), m: F.col(id_col)})

    def named(df):
        few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        df = df.select(F.col("doc_id").alias(m + "_r"), F.col("node").alias(n + "_r"))
        return F.broadcast(df) if few else df

    alike = F.col(m).eqNullSafe(F.col(m + "_r")) & (F.col(n) == F.col(n + "_r"))
    kept = keyed.join(named(losers), alike, "left_anti")
    if not repeated.limit(1).count():
        return kept.drop(n, m)
    again = named(repeated)
    once = kept.join(again, alike, "left_anti")
    return once.unionByName(kept.join(again, alike, "left_semi").dropDuplicates([m, n])).drop(n, m)
