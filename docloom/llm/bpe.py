"""Byte-level BPE encoding and decoding with numpy.

A text is cut by the tokenizer's pattern.  Pieces that are no token themselves are gathered over many
texts, each once, and grouped by length into padded matrices of token ids.  In each round every row
merges its leftmost pair of least rank; ranks of pairs come from a hash table; the merged row closes the
gap, and rows that have nothing left to merge leave the matrix.  Pieces longer than LONGEST bytes would
need as many rounds over rows as wide; they are merged one by one with a heap, to the same tokens.

Ids are packed as little-endian unsigned 32-bit integers, the form token shards are stored in.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
LONGEST = WIDTHS[-1]
ROWS_AT_ONCE = 20_000
CHARACTERS_AT_ONCE = 1_000_000
CACHE = 200_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressed hash table from (left id, right id) to the id of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == -1
            taken, winner = np.unique(slot[left[free]], return_index=True)
            put = left[free][winner]
            self.keys[taken], self.values[taken] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where the pair does not merge or one side is missing (-1)."""
        keys = np.where((left < 0) | (right < 0), -2, (left.astype(np.int64) << 32) | right.astype(np.int64))
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return found


class Tokenizer:
    """Ranks from a file of lines "<base64 of bytes> <rank>"; rank and id are the same number."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most `width` bytes."""
        sizes = np.array([len(p) for p in pieces])
        inside = np.arange(width) < sizes[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out: list = [None] * len(pieces)
        row = np.arange(len(pieces))
        columns = np.arange(width)
        while len(row):
            at = ranks.argmin(1)
            each = np.arange(len(row))
            best = ranks[each, at]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = ids[i, : sizes[row[i]]]
                stay = ~done
                row, ids, ranks, at, best = row[stay], ids[stay], ranks[stay], at[stay], best[stay]
                each = np.arange(len(row))
                if not len(row):
                    break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[each, at] = best
            sizes[row] -= 1
            after = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, at] = self.pairs.get(best, after)
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pairs.get(ids[inner, at[inner] - 1], best[inner])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        known, bytes_of = self.ranks, self.bytes_of

        def offer(i):
            if i >= 0 and right[i] >= 0:
                a, b = ids[i], ids[right[i]]
                r = known.get(bytes_of[a] + bytes_of[b])
                if r is not None:
                    heapq.heappush(heap, (r, i, a, b))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn_pieces(self, pieces: list[str]) -> None:
        """Put the packed ids of the pieces into the cache."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            elif len(raw) > LONGEST:
                self.cache[p] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                groups.setdefault(next(w for w in WIDTHS if len(raw) <= w), []).append((p, raw))
        for width, group in groups.items():
            most = max(1, ROWS_AT_ONCE * 8 // width)
            for k in range(0, len(group), most):
                part = group[k : k + most]
                for (p, _), ids in zip(part, self.merge_rows([raw for _, raw in part], width)):
                    self.cache[p] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; None like an empty text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARACTERS_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            if len(self.cache) > CACHE:
                self.cache.clear()
            cut = [self.split(t or "") for t in texts[at:end]]
            new = {p for pieces in cut for p in pieces if p not in self.cache}
            self.learn_pieces(list(new))
            known = self.cache.__getitem__
            out += [b"".join(map(known, pieces)) for pieces in cut]
            at = end
        return out

    def decode(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


def encode_column(column, path: str, pattern: str):
    """Packed ids (binary) of a text column; null texts give no ids."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(path, pattern).encode(texts.tolist()), dtype=object)

    return encoded(column)


def decode_column(column, path: str, pattern: str):
    """Bytes that packed ids stand for; an id outside the vocabulary is an error."""

    @F.pandas_udf("binary")
    def decoded(packed: pd.Series) -> pd.Series:
        t = tokenizer(path, pattern)
        return pd.Series([t.decode(p) for p in packed], dtype=object)

    return decoded(column)


def round_trip_column(column, path: str, pattern: str):
    """struct<token_ids, decoded>: a text's packed ids and the bytes decoded from them, in one pass over the rows."""

    @F.pandas_udf("struct<token_ids:binary, decoded:binary>")
    def both(texts: pd.Series) -> pd.DataFrame:
        t = tokenizer(path, pattern)
        ids = t.encode(texts.tolist())
        return pd.DataFrame({"token_ids": ids, "decoded": [t.decode(i) for i in ids]}, dtype=object)

    return both(column)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """doc_id, n_tokens, token_ids (packed) of each row, and with decode the bytes they decode to.

    Null and empty texts have no tokens; repeated rows stay; other columns are not read; an empty table
    gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if decode:
        made = round_trip_column(text, path, pattern)
    else:
        made = F.struct(encode_column(text, path, pattern).alias("token_ids"))
    rows = docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
    return rows.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), *rows.columns[1:])


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with `decoded`, the bytes that its token_ids stand for."""
    return encoded.select("*", decode_column(F.col("token_ids"), path, pattern).alias("decoded"))
