"""Document fingerprints by consistent weighted sampling.

The weight of a term is its count.  For sample k a term has, from a counter-based generator seeded by its
hash, r and c from Gamma(2, 1) and b from (0, 1).  At weight w it takes the level t = floor(ln w / r + b)
and the value ln c - r (t - b) - r; the term of least value, with its level, is the sample.  Two documents
draw the same sample with a chance equal to the generalised Jaccard similarity of their counts,
sum(min) / sum(max); a sample is kept as 16 bits of the hash of term and level.

Documents are paired with the next one by descending id without bringing them to one place: ids are cut at
quantiles into buckets, and the first document of each bucket is also sent to the bucket before it.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SAMPLES = 128
TABLE = 70_000  # terms remembered by process; 12 * SAMPLES bytes each
STEP = 8_000  # terms of one text taken at a time
ROWS_A_BUCKET = 4_000
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))


def draws(hashes: np.ndarray, samples: int = SAMPLES):
    """(value at weight 1, r, b), each by term and sample."""
    counter = np.arange(1, samples * 3 + 1, dtype=np.uint64) * _GOLDEN
    bits = _mix(_mix(hashes)[:, None] + counter)
    u = bits.view(np.uint32).astype(np.float32) * np.float32(2.0**-32) + np.float32(2.0**-33)  # two from each number
    u = u.reshape(len(hashes), 6, samples)
    r = np.maximum(-np.log(u[:, 0] * u[:, 1]), np.float32(1e-6))
    ln_c = np.log(np.maximum(-np.log(u[:, 2] * u[:, 3]), np.float32(1e-6)))
    return ln_c + r * u[:, 4] - r, r, u[:, 4]


class Sampler:
    """Draws fingerprints; remembers the draws of TABLE terms."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.row: dict[bytes, int] = {}
        self.hashes = np.empty(TABLE, np.uint64)
        self.one, self.r, self.b = (np.empty((TABLE, samples), np.float32) for _ in range(3))

    def rows_of(self, terms: list[bytes]) -> np.ndarray:
        new = [t for t in terms if t not in self.row]
        if len(self.row) + len(new) > TABLE:
            self.row.clear()
            new = terms
        for k in range(0, len(new), 500):
            part = new[k : k + 500]
            a = len(self.row)
            b = a + len(part)
            self.hashes[a:b] = term_hashes(part)
            self.one[a:b], self.r[a:b], self.b[a:b] = draws(self.hashes[a:b], self.samples)
            self.row.update(zip(part, range(a, b)))
        return np.fromiter(map(self.row.__getitem__, terms), np.int64, len(terms))

    def fingerprint(self, counts: dict[bytes, int]) -> np.ndarray:
        """16 bits by sample; zeros for no terms."""
        terms = list(counts)
        best = np.full(self.samples, np.inf, np.float32)
        code = np.zeros(self.samples, np.uint64)
        k = np.arange(self.samples)
        for at in range(0, len(terms), STEP):
            part = terms[at : at + STEP]
            rows = self.rows_of(part)
            weight = np.fromiter((counts[t] for t in part), np.float64, len(part))
            once = np.flatnonzero(weight == 1)
            more = np.flatnonzero(weight != 1)
            for which, log_w in ((once, None), (more, np.log(weight[more]).astype(np.float32)[:, None])):
                if not len(which):
                    continue
                own = rows[which]
                value = self.one[own]
                if log_w is not None:
                    r = self.r[own]
                    level = np.floor(log_w / r + self.b[own])
                    value = value - r * level
                least = value.argmin(0)
                low = value[least, k]
                t = np.zeros(self.samples) if log_w is None else level[least, k]
                won = low < best
                best = np.where(won, low, best)
                code = np.where(won, _mix(self.hashes[own[least]] + (t.astype(np.int64).astype(np.uint64) + np.uint64(1)) * _GOLDEN), code)
        return (code & np.uint64(0xFFFF)).astype(np.uint16)


def counts_of(text: str) -> Counter:
    """Counts of the words of a text, lower-cased A-Z and split at ASCII white space."""
    return Counter(text.encode("utf-8", "replace").lower().split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def to_text(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _count_below(cuts: np.ndarray, value):
    """How many of the sorted cuts are less than value, by halving; a column, so that rows do not pass through Python."""
    if not len(cuts):
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.lit(cuts), at + step - 1) < value, at + step).otherwise(at))


def _placed(docs: DataFrame) -> DataFrame:
    """docs with bucket and ahead; the first row of each bucket also stands, ahead, at the end of the one before.

    id is doc_id with 0 for null, none says which are null: ids stay longs everywhere."""
    spark = docs.sparkSession
    docs = docs.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()})
    rows = docs.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_BUCKET)
    cuts = docs.where("NOT none").approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if rows else []
    cuts = np.unique(np.array([min(int(c), 2**63 - 1) for c in cuts], np.int64))

    below = _count_below(cuts, F.col("id"))
    docs = docs.withColumn("bucket", F.when(F.col("none"), len(cuts) + 1).otherwise(len(cuts) - below))
    heads = (
        docs.groupBy("bucket")
        .agg(F.min(F.struct("none", F.bitwise_not("id").alias("down"), "tie")).alias("head"))  # least of ~id: greatest id
        .collect()  # a row for each bucket
    )
    heads = sorted((h["bucket"], h["head"]["none"], ~h["head"]["down"], h["head"]["tie"]) for h in heads)
    ids, ties, before = (np.zeros(len(cuts) + 2, np.int64) for _ in range(3))
    for k, (own, _, i, tie) in enumerate(heads):
        ids[own], ties[own], before[own] = i, tie, heads[k - 1][0]
    of = lambda values: F.get(F.lit(values), F.col("bucket"))
    spot = lambda bucket, ahead: F.struct(bucket.cast("int").alias("bucket"), F.lit(ahead).alias("ahead"))
    own, ahead = spot(F.col("bucket"), 0), spot(of(before), 1)
    head = (F.col("id") == of(ids)) & (F.col("tie") == of(ties))

    return (
        docs.withColumn("place", F.explode(F.when(head, F.array(own, ahead)).otherwise(F.array(own))))
        .select("id", "none", "text", "tie", "place.bucket", "place.ahead")
        .repartitionById(len(cuts) + 2, F.col("bucket"))
        .sortWithinPartitions("bucket", "ahead", "none", F.col("id").desc(), "tie", "text")
    )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next document are.

    Next is by descending id, ids that are null last, equal ids by hash of the text; after the last comes the
    first, which for a single row is itself.  Ids are longs (others that are no whole numbers: an error of the
    cast).  Null texts are empty; texts without words have a fingerprint of
    zeros; repeated rows stay; an empty table gives no rows; other columns are not read."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = _placed(rows.withColumn("tie", F.xxhash64("text")))

    def walk(frames):
        sampler = Sampler()
        held = None  # bucket, id, text, counts' fingerprint
        for frame in frames:
            out = []
            ids = [None if n else i for n, i in zip(frame["none"].tolist(), frame["id"].tolist())]
            for bucket, ahead, i, text in zip(frame["bucket"].tolist(), frame["ahead"].tolist(), ids, frame["text"].tolist()):
                own = sampler.fingerprint(counts_of(text)) if not ahead or held is not None else None
                if held is not None and held[0] == bucket:
                    _, j, before, print_ = held
                    changed = edited(before, text)
                    other = sampler.fingerprint(counts_of(changed))
                    out.append(
                        (j, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), to_text(print_), to_text(other), likeness(print_, other), likeness(print_, own))
                    )
                held = None if ahead else (bucket, i, text, own)
            result = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            result["doc_id"] = pd.array([o[0] for o in out], "Int64")
            yield result

    return placed.select("bucket", "ahead", "id", "none", "text").mapInPandas(walk, RESULT)
