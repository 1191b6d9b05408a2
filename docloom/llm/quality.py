"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document is a hashed tf-idf vector of its words beside a vector of its style: the shares of its words that
have a shape (case and punctuation) or repeat the word before.  The first part has length 1, the second
STYLE_LENGTH, and a truncated singular value decomposition fitted on labelled documents reduces them together.  Every document is compared with all labelled vectors
(cosines in blocks, exactly); the K nearest vote with their label, weighted by similarity.

The labelled vectors are bounded: at most `per_class` documents of each label, those with the least hashes
of doc_id; with RANK numbers each they are broadcast (4 * 2 * per_class * RANK bytes at most).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import sample_labels

PER_CLASS = 1500
WORD_SLOTS, STYLE_SLOTS = 1 << 13, 1 << 9
SLOTS = WORD_SLOTS + STYLE_SLOTS
STYLE_LENGTH = 2.0
RANK = 64
K = 25
SHARPNESS = 12.0
CACHE = 300_000
ROWS_AT_ONCE = 256
_REPEAT = SLOTS - 1


def _slots_of(token: str) -> tuple[int, int]:
    letters = "".join(c for c in token if c.isalnum())
    signs = "".join(c for c in token if not c.isalnum())[:3]
    if not letters:
        case = "-"
    elif letters.isdigit():
        case = "9"
    elif len(letters) > 1 and letters.isupper():
        case = "X"
    else:
        case = "x"
    hashed = lambda s: zlib.crc32(s.encode("utf-8", "replace"))
    return hashed(letters.lower()) % WORD_SLOTS, WORD_SLOTS + hashed(case + signs) % (STYLE_SLOTS - 1)


class Terms:
    """Slots of tokens, remembered by process."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(slots, weights before idf) of a text: 1 + log of the count for words, root of the share for style."""
        tokens = (text or "").split()
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for t in set(tokens):
            if t not in known:
                known[t] = _slots_of(t)
        pairs = np.array([known[t] for t in tokens], np.int64)
        n = np.bincount(pairs.ravel(), minlength=SLOTS)
        n[_REPEAT] = int((pairs[1:, 0] == pairs[:-1, 0]).sum())
        slots = np.flatnonzero(n)
        count = n[slots].astype(float)
        return slots, np.where(slots < WORD_SLOTS, 1 + np.log(count), np.sqrt(count / len(tokens)))


def balanced(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights with the word part at length 1 and the style part at STYLE_LENGTH."""
    cut = int(np.searchsorted(slots, WORD_SLOTS))
    for part, length in ((weights[:cut], 1.0), (weights[cut:], STYLE_LENGTH)):
        size = np.sqrt((part * part).sum())
        if size > 0:
            part *= length / size
    return weights


class Model:
    def __init__(self, idf, basis, vectors, labels, base):
        self.idf, self.basis, self.vectors, self.labels, self.base = idf, basis, vectors, labels, base
        self.terms = Terms()

    def __getstate__(self):
        return self.idf, self.basis, self.vectors, self.labels, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def project(self, texts: list[str | None]) -> np.ndarray:
        """Unit latent vectors; zero for texts without terms."""
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for i, text in enumerate(texts):
            slots, weights = self.terms.weights(text)
            if len(slots):
                out[i] = balanced(slots, weights * self.idf[slots]).astype(np.float32) @ self.basis[slots]
        return unit(out)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors; the base rate for zero vectors."""
        scores = np.full(len(vectors), self.base)
        if not len(self.labels):
            return scores
        k = min(K, len(self.labels))
        for at in range(0, len(vectors), ROWS_AT_ONCE):
            block = vectors[at : at + ROWS_AT_ONCE]
            likeness = block @ self.vectors.T
            near = np.argpartition(-likeness, k - 1, 1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(likeness, near, 1).astype(float) - 1))
            share = (weight * self.labels[near]).sum(1) / weight.sum(1)
            some = np.abs(block).max(1) > 0
            scores[at : at + len(block)][some] = np.clip(share, 0, 1)[some]
        return scores


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit idf and the latent basis on labelled texts.  Without labels every score is 0.5."""
    base = (sum(labels) + 1) / (len(labels) + 2)
    if not texts:
        return Model(np.zeros(SLOTS), np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), base)
    terms = Terms()
    rows = np.zeros((len(texts), SLOTS), np.float32)
    found = [terms.weights(t) for t in texts]
    seen = np.bincount(np.concatenate([slots for slots, _ in found]), minlength=SLOTS)
    idf = np.log((1 + len(texts)) / (1 + seen)) + 0.05
    idf[WORD_SLOTS:] = 1.0
    for i, (slots, weights) in enumerate(found):
        rows[i, slots] = balanced(slots, weights * idf[slots])
    rank = min(RANK, *rows.shape)
    probe = np.random.default_rng(0).standard_normal((SLOTS, min(rank + 16, SLOTS))).astype(np.float32)
    y = rows @ probe
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = rows @ (rows.T @ q)
    q, _ = np.linalg.qr(y)
    basis = np.linalg.svd(q.T @ rows, full_matrices=False)[2][:rank].T.astype(np.float32)
    model = Model(idf, np.ascontiguousarray(basis), np.zeros((0, rank), np.float32), np.array(labels, float), base)
    model.vectors = unit(rows @ basis)
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Model:
    rows = sample_labels(docs, labels, "quality", folds, held_out, per_class, per_class)
    return train([t for t, _ in rows], [y for _, y in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and quality (0 to 1) of each row.

    Null texts and texts without a word get the smoothed share of good documents in the sample; repeated
    rows are scored each; an empty table gives no rows; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.vote(sent.value.project(texts.tolist())))

    return docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col)).alias("quality"))
