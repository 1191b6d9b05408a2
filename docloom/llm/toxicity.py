"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given by document; the field needs them by token.  A token of a toxic document counts as a
toxic one if its word, or a prefix of the word, stands in many toxic and next to no clean documents of
the sample.  The field has two states.  Its emission weighs the word, its prefixes, its ending and its
shape; its transitions say how labels follow each other.  Forward-backward marginals give the chance
that a token is toxic; the largest of them and their sum give the document's score by a logistic curve
fitted on the same sample.

The sample is bounded: at most `positives` toxic and `negatives` clean documents, those with the least
hashes of doc_id.  All else covers every document and its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, free_name

POSITIVES, NEGATIVES = 800, 1600
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6)
#: A word or prefix marks toxic tokens if it is in so many toxic documents (and in 2 % of them), and the
#: smoothed odds are so high.
LEAST_DOCUMENTS, LEAST_ODDS = 3, 60.0
#: A document with a larger share of five-word runs that an earlier one has is a copy; it teaches nothing new.
SEEN_SHARE = 0.2
ROUNDS = 25
SPAN_AT = 0.5
TOKENS_AT_ONCE = 100_000
#: Training passes over so many tokens at once, which bounds what the driver holds.
TRAIN_AT_ONCE = 100_000
CACHE = 100_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(word: str) -> list[str]:
    found = ["w" + word]
    found += [f"p{n}{word[:n]}" for n in PREFIXES if len(word) > n]
    found.append("s" + word[-3:])
    found.append("l%d" % min(len(word), 12) if word.isalpha() else "d")
    return found


def _slots(word: str) -> np.ndarray:
    return np.array([zlib.crc32(f.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1) for f in word_features(word)])


def scan(emission: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Share of state 1 in the forward messages of many chains laid end to end.

    emission: odds of state 1 by position; first: where a chain begins; move[i, j]: factor from i to j.
    Positions are cut into blocks that advance side by side; a first pass finds how each block maps an
    entering message, a walk over the blocks finds what enters each, a second pass fills them in."""
    n = len(emission)
    if not n:
        return np.empty(0)
    long = max(16, int(n**0.5))
    blocks = -(-n // long)
    e = np.ones(blocks * long)
    e[:n] = emission
    f = np.ones(blocks * long, bool)
    f[:n] = first
    e, f = np.ascontiguousarray(e.reshape(blocks, long).T), np.ascontiguousarray(f.reshape(blocks, long).T)
    any_first = f.any(1)
    one = start[1] * e / (start[0] + start[1] * e)  # share of state 1 where a chain begins

    def step(j, a, b):
        x, y = a * move[0, 0] + b * move[1, 0], (a * move[0, 1] + b * move[1, 1]) * e[j]
        return x, y

    into = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for j in range(long):
        a, b = step(j, into[0], into[1])
        c, d = step(j, into[2], into[3])
        if any_first[j]:
            at, s = f[j], one[j]
            a, c = np.where(at, 1 - s, a), np.where(at, 1 - s, c)
            b, d = np.where(at, s, b), np.where(at, s, d)
        total = a + b + c + d
        into = [a / total, b / total, c / total, d / total]
    enters = np.empty(blocks)
    x = 0.5
    for k, (a, b, c, d) in enumerate(zip(*(m.tolist() for m in into))):
        enters[k] = x
        zero, won = (1 - x) * a + x * c, (1 - x) * b + x * d
        x = won / (zero + won) if zero + won > 0 else 0.5
    out = np.empty((long, blocks))
    share = enters
    for j in range(long):
        a, b = step(j, 1 - share, share)
        share = b / (a + b)
        if any_first[j]:
            share = np.where(f[j], one[j], share)
        out[j] = share
    return out.T.reshape(-1)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray):
    """(chance of state 1, forward share, backward share) of each position; exact sums over all labellings."""
    emission = np.clip(emission, 1e-13, 1e13)
    forward = scan(emission, first, move, start)
    last = np.append(first[1:], True) if len(first) else first
    backward = scan(emission[::-1], last[::-1], move.T, np.ones(2))[::-1]
    forward_, backward_ = np.clip(forward, 1e-15, 1 - 1e-15), np.clip(backward, 1e-15, 1 - 1e-15)
    odds = forward_ / (1 - forward_) * backward_ / (1 - backward_) / emission
    return odds / (1 + odds), forward_, backward_


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    curve: np.ndarray  # logistic curve over what summary() gives
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.weights, self.move, self.start, self.curve

    def __setstate__(self, state):
        self.weights, self.move, self.start, self.curve = state
        self.cache = {}

    def emission(self, words: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE:
            self.cache.clear()
        known, weights = self.cache, self.weights
        for w in set(words):
            if w not in known:
                known[w] = float(weights[_slots(w)].sum())
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def tag(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Marginals of the tokens of each document."""
        sizes = [len(d) for d in documents]
        if not sum(sizes):
            return [np.empty(0) for _ in documents]
        energy = np.concatenate([self.emission(d) for d in documents])
        first = np.zeros(len(energy), bool)
        edges = np.cumsum([0, *sizes])
        first[edges[:-1][np.array(sizes) > 0]] = True
        chance = marginals(np.exp(np.clip(energy, -30, 30)), first, self.move, self.start)[0]
        return [chance[a:b] for a, b in zip(edges, edges[1:])]

    def score(self, chances: list[np.ndarray]) -> np.ndarray:
        z = summary(chances) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def summary(chances: list[np.ndarray]) -> np.ndarray:
    """By document, scaled to 1: log odds of its likeliest toxic token, and the sum of those above zero, up to 30."""
    rows = []
    for p in chances:
        z = np.log(np.clip(p, 1e-6, None) / np.clip(1 - p, 1e-6, None))
        rows.append((float(z.max()) if len(z) else np.log(1e-6), min(30.0, float(z[z > 0].sum()))))
    return np.array(rows, float).reshape(-1, 2) / (14.0, 30.0)


def mark_tokens(documents: list[list[str]], toxic: list[int]) -> set[str]:
    """Words and prefixes ("w..." and "p<n>...") that mark toxic tokens.

    Only those of toxic documents are counted; what no toxic document has marks nothing."""
    counts = [Counter(), Counter()]
    sizes = [toxic.count(0), toxic.count(1)]
    features: dict[str, list[str]] = {}
    for y in (1, 0):
        for words in (d for d, v in zip(documents, toxic) if v == y):
            keys: set[str] = set()
            for w in set(words):
                if w not in features:
                    features[w] = [k for k in word_features(w) if k[0] in "wp" and (y or k in counts[1])]
                keys.update(features[w])
            counts[y].update(keys)
        if y:
            least = max(LEAST_DOCUMENTS, sizes[1] / 50)
            counts[1] = Counter({k: a for k, a in counts[1].items() if a >= least})
            features.clear()
    ratio = (sizes[0] + 1) / (sizes[1] + 1)
    return {k for k, a in counts[1].items() if (a + 0.5) / (counts[0][k] + 0.5) * ratio >= LEAST_ODDS}


def without_copies(documents: list[list[str]]) -> list[int]:
    """Positions of documents that mostly say what no earlier one says."""
    runs = []
    for words in documents:
        runs.append(np.unique(np.fromiter((hash(run) for run in zip(*(words[k:] for k in range(5)))), np.int64)))
        if not len(runs[-1]):
            runs[-1] = np.array([hash(tuple(words))])
    if not runs:
        return []
    sizes = np.array([len(r) for r in runs])
    of = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)
    every = np.concatenate(runs)
    order = np.argsort(every, kind="stable")  # equal runs stay in the order of their documents
    again = np.append(False, every[order][1:] == every[order][:-1])
    seen = np.bincount(of[order[again]], minlength=len(runs))
    return np.flatnonzero(seen <= SEEN_SHARE * sizes).tolist()


def _parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents with TRAIN_AT_ONCE tokens or little more."""
    at, parts, held = 0, [], 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= TRAIN_AT_ONCE:
            parts.append((at, i + 1))
            at, held = i + 1, 0
    return parts + [(at, len(sizes))] * (at < len(sizes))


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit the field and the curve.  With one class only, every score is the smoothed share of toxic documents."""
    pairs = list(dict.fromkeys(zip(texts, toxic)))
    same: dict[str, str] = {}  # one object for each word, however often it occurs
    documents, y = [[same.setdefault(w, w) for w in words_of(t)] for t, _ in pairs], [int(v) for _, v in pairs]
    kept = without_copies(documents)
    documents, y = [documents[i] for i in kept], [y[i] for i in kept]
    base = (sum(y) + 1) / (len(y) + 2)
    model = Model(np.zeros(1 << FEATURE_BITS), np.ones((2, 2)), np.array([1 - 1e-3, 1e-3]), np.array([0.0, 0.0, np.log(base / (1 - base))]))
    if len(set(y)) < 2 or not any(documents):
        return model
    marks = mark_tokens(documents, y)
    index: dict[str, int] = {}
    types = np.fromiter((index.setdefault(w, len(index)) for d in documents for w in d), np.int32)
    features = [word_features(w) for w in index]
    marked = np.array([not marks.isdisjoint(f) for f in features])
    slots = [np.array([zlib.crc32(k.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1) for k in f]) for f in features]
    of_type = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slots = np.concatenate(slots)
    sizes = np.array([len(d) for d in documents])
    first = np.zeros(len(types), bool)
    first[np.cumsum([0, *sizes])[:-1][sizes > 0]] = True
    truth = marked[types] & np.repeat(np.array(y, bool), sizes)
    follows = ~first[1:]
    before, after = truth[:-1][follows].astype(np.int8), truth[1:][follows].astype(np.int8)
    seen = np.bincount(before * 2 + after, minlength=4).astype(float)
    edges = np.cumsum([0, *sizes])
    parts = [(edges[i], edges[j]) for i, j in _parts(sizes) if edges[i] < edges[j]]
    right = np.bincount(types, truth, len(slots_index := index))
    tied = np.array([0.0, 0.0, 0.0, 0.0])  # log factors 00 01 10 11
    grad_sign, steps, weights = None, None, model.weights
    active = np.unique(slots)
    for _ in range(ROUNDS):
        energy = np.bincount(of_type, weights[slots], len(slots_index))
        move = np.exp(tied).reshape(2, 2)
        by_type, pair = right.copy(), np.zeros(4)
        for i, j in parts:
            e = np.exp(np.clip(energy[types[i:j]], -30, 30))
            chance, forward, backward = marginals(e, first[i:j], move, model.start)
            inner = ~first[i + 1 : j]
            a, g = forward[:-1][inner], backward[1:][inner]
            both = np.stack([(1 - a) * move[0, 0] * (1 - g), (1 - a) * move[0, 1] * g, a * move[1, 0] * (1 - g), a * move[1, 1] * g])
            pair += (both / both.sum(0)).sum(1)
            by_type -= np.bincount(types[i:j], chance, len(slots_index))
        grad = np.concatenate([np.bincount(slots, by_type[of_type], 1 << FEATURE_BITS)[active] - 0.05 * weights[active], (seen - pair) - 0.05 * tied])
        sign = np.sign(grad)
        if grad_sign is None:
            steps = np.full(len(grad), 0.1)
        else:
            steps = np.clip(steps * np.where(sign * grad_sign > 0, 1.3, np.where(sign * grad_sign < 0, 0.5, 1.0)), 1e-4, 1.0)
        grad_sign = sign
        weights[active] += (sign * steps)[:-4]
        tied += (sign * steps)[-4:]
    model.move = np.exp(tied - tied.max()).reshape(2, 2)
    summaries = [summary(model.tag(documents[i:j])) for i, j in _parts(sizes)]
    model.curve = _logistic(np.concatenate(summaries), np.array(y, float))
    model.cache = {}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps for a logistic curve with a penalty on its slopes; last value: the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.array([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty * w), -4, 4)
    return w


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, positives: int, negatives: int):
    """[(text, label)] to learn from: rows outside the held-out fold, the least hashes first within each class."""
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
        .select("doc_id", F.col(label).cast("int").alias("label"))
    )
    picked = []
    for value, most in ((1, positives), (0, negatives)):
        picked += known.where(F.col("label") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not picked:
        return []
    chosen = spark.createDataFrame(picked, known.schema)  # positives + negatives rows at most
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").collect()
    return sorted(((r["text"], r["label"]) for r in rows))


def tag_column(spark: SparkSession, model: Model, column):
    """struct<toxicity, toxic_tokens, toxic_spans (start, end in code points, chance)> of a text column."""
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = "struct<toxicity:double, toxic_tokens:int, toxic_spans:array<struct<start:int, end:int, chance:double>>>"

    @F.pandas_udf(kind)
    def tagged(texts: pd.Series) -> pd.DataFrame:
        m, out, todo, size = sent.value, [], [], 0

        def flush():
            chances = m.tag([w for _, w in todo])
            for (text, _), p, score in zip(todo, chances, m.score(chances)):
                spans = []
                if (hot := np.flatnonzero(p >= SPAN_AT)).size:
                    low = (text or "").lower()
                    same = len(low) == len(text)
                    at = [x.span() for x in (WORD.finditer(low))]
                    for i in hot.tolist():
                        if spans and spans[-1][3] == i - 1:
                            spans[-1] = (spans[-1][0], at[i][1], max(spans[-1][2], float(p[i])), i)
                        else:
                            spans.append((at[i][0], at[i][1], float(p[i]), i))
                    if not same:  # lower-casing changed the length: map back by code points
                        back = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
                        spans = [(back[a], back[b], c, i) for a, b, c, i in spans]
                out.append((float(score), int(hot.size), [{"start": a, "end": b, "chance": c} for a, b, c, _ in spans]))
            todo.clear()

        for text in texts:
            words = words_of(text)
            todo.append((text or "", words))
            size += len(words)
            if size >= TOKENS_AT_ONCE:
                flush()
                size = 0
        flush()
        return pd.DataFrame(out, columns=["toxicity", "toxic_tokens", "toxic_spans"])

    return tagged(column)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, toxicity, toxic_tokens and toxic_spans of each row.

    Null and empty texts get the score of a document without toxic tokens; whole texts are read; repeated
    rows and ids are scored each by itself; an empty table gives no rows; other columns are not read."""
    tagged = tag_column(docs.sparkSession, model, F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), tagged.alias("t")).select("doc_id", "t.*")


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.7) -> DataFrame:
    """docs without the rows that score `at` or more; columns are handed on as they are."""
    name = free_name(docs, "toxic")
    tagged = docs.withColumn(name, tag_column(docs.sparkSession, model, F.col(text_col)))
    return tagged.where(F.col(name)["toxicity"] < at).drop(name)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    rows = sample_labels(docs, labels, "toxic", folds, held_out, positives, negatives)
    return train([t for t, _ in rows], [y for _, y in rows])
