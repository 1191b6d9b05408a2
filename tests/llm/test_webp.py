import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import webp as W


class Writer:
    """Bits written one value at a time, and plain prefix codes, to build pictures by hand."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [(v >> i) & 1 for i in range(n)]

    def code(self, counts, alphabet):
        full = np.zeros(alphabet, int)
        full[: len(counts)] = counts
        if np.count_nonzero(full) == 0:
            full[0] = 1
        lengths = np.zeros(alphabet, np.int64)
        if np.count_nonzero(full) == 1:
            lengths[np.flatnonzero(full)[0]] = 1
            single = True
        else:
            lengths, single = W.code_lengths(full, 15), False
        W._write_code(self.put, lengths)
        return (lambda s: None) if single else (lambda s, c=W.codes_of(lengths): self.put(int(c[s]), int(lengths[s])))

    def prefix(self, value):
        """(prefix, extra, bits) of an amount of 1 or more."""
        v = value - 1
        if v < 4:
            return v, 0, 0
        top = v.bit_length() - 1
        second = (v >> top - 1) & 1
        return 2 * top + second, v & ((1 << top - 1) - 1), top - 1

    def image(self, tokens, cache_bits=0, main=False):
        """tokens: ("lit", argb) | ("copy", length, distance code) | ("cache", index)."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        counts = [np.zeros(n, int) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
        for t in tokens:
            if t[0] == "lit":
                for k, shift in zip((0, 1, 2, 3), (8, 16, 0, 24)):
                    counts[k][(t[1] >> shift) & 255] += 1
            elif t[0] == "copy":
                counts[0][256 + self.prefix(t[1])[0]] += 1
                counts[4][self.prefix(t[2])[0]] += 1
            else:
                counts[0][280 + t[1]] += 1
        write = [self.code(c, len(c)) for c in counts]
        for t in tokens:
            if t[0] == "lit":
                for k, shift in zip((0, 1, 2, 3), (8, 16, 0, 24)):
                    write[k]((t[1] >> shift) & 255)
            elif t[0] == "copy":
                for k, value in ((0, t[1]), (4, t[2])):
                    prefix, extra, n = self.prefix(value)
                    write[k](prefix + (256 if k == 0 else 0))
                    self.put(extra, n)
            else:
                write[0](280 + t[1])

    def header(self, width, height):
        self.put(W.SIGNATURE, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(1, 1), self.put(0, 3)

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def literal(image):
    flat = image.reshape(-1, 4).astype(int)
    return [("lit", (a << 24) | (r << 16) | (g << 8) | b) for a, r, g, b in flat.tolist()]


def picture(seed, h=9, w=11):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4))


def decoded(w):
    return W.decode_chunk(w.bytes())


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=700))
def test_round_trip(payload):
    back = W.load(W.store(payload))
    assert len(back) % 64 == 0 and len(back) >= 64 and back.rstrip(b"\0") == payload.rstrip(b"\0") and back[: len(payload)] == payload


@pytest.mark.parametrize("payload", [b"", b"\0" * 64, b"aab" * 500, bytes(range(256)) * 9, "Füße 🙂\n".encode() * 3000, b"x" * (64 * 16384 + 70)])
def test_odd_payloads(payload):
    media = W.store(payload)
    assert W.load(media)[: len(payload)] == payload
    assert (W.decode(media)[0][..., 0] == 255).all() and (W.decode(media)[0][..., 1] == W.decode(media)[0][..., 3]).all()


def test_skewed_counts_stay_within_the_longest_code():
    lengths = W.code_lengths(np.array([1 << i for i in range(25)]), 12)
    assert lengths.max() <= 12 and sum(2.0 ** -int(n) for n in lengths) == 1


def test_literals_copies_and_cache():
    w, image = Writer(), picture(1, 4, 8)
    tokens = literal(image[:2]) + [("copy", 8, 1), ("copy", 5, 2), ("copy", 3, 120 + 24)]
    w.header(8, 4)
    w.put(0, 1)
    w.image(tokens, main=True)
    got = decoded(w)
    assert (got[:2] == image[:2]).all() and (got[2] == image[1]).all()
    assert (got[3, :5] == got[2, 7]).all() and (got[3, 5:8] == got[0, 5:8]).all()
    w = Writer()
    colours = [0xFF112233, 0x80445566, 0xFF778899]
    slot = lambda c: ((W.CACHE_FACTOR * c) & 0xFFFFFFFF) >> 28
    w.header(3, 2)
    w.put(0, 1)
    w.image([("lit", c) for c in colours] + [("cache", slot(colours[1])), ("cache", slot(colours[2])), ("lit", 0)], cache_bits=4, main=True)
    flat = decoded(w).reshape(-1, 4).tolist()
    assert flat[3] == flat[1] == [0x80, 0x44, 0x55, 0x66] and flat[4] == flat[2]


def test_near_distances():
    assert len(W.NEAR) == 120 and W.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and W.NEAR[-1] == (8, 7)


def predict(mode, image, y, x):
    L, T = image[y][x - 1], image[y - 1][x]
    TL = image[y - 1][x - 1]
    TR = image[y - 1][x + 1] if x + 1 < len(image[0]) else image[y][0]
    avg = lambda a, b: [(p + q) // 2 for p, q in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [l + t - c for l, t, c in zip(L, T, TL)]
        return L if sum(abs(a - b) for a, b in zip(p, L)) < sum(abs(a - b) for a, b in zip(p, T)) else T
    if mode == 12:
        return [clamp(l + t - c) for l, t, c in zip(L, T, TL)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(L, T), TL)]
    return [[255, 0, 0, 0], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = picture(mode).tolist()
    h, w = len(image), len(image[0])
    rest = [[None] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            guess = [255, 0, 0, 0] if x == y == 0 else image[y][x - 1] if y == 0 else image[y - 1][x] if x == 0 else predict(mode, image, y, x)
            rest[y][x] = [(a - b) & 255 for a, b in zip(image[y][x], guess)]
    out = Writer()
    out.header(w, h)
    out.put(1, 1), out.put(0, 2), out.put(0, 3)
    out.image([("lit", 0xFF000000 | mode << 8)] * (3 * 3))
    out.put(0, 1)
    out.image(literal(np.array(rest)), main=True)
    assert decoded(out).tolist() == image


def test_cross_colour_then_subtract_green():
    image, rng = picture(5), random.Random(1)
    g2r, g2b, r2b = 200, 17, 130
    s8 = lambda v: v - 256 if v > 127 else v
    stored = image.copy()
    stored[..., 1] = (stored[..., 1] - stored[..., 2]) & 255
    stored[..., 3] = (stored[..., 3] - stored[..., 2]) & 255
    for p in stored.reshape(-1, 4):
        a, r, g, b = map(int, p)
        p[3] = (b - ((s8(g2b) * s8(g)) >> 5) - ((s8(r2b) * s8(r)) >> 5)) & 255
        p[1] = (r - ((s8(g2r) * s8(g)) >> 5)) & 255
    out = Writer()
    out.header(11, 9)
    out.put(1, 1), out.put(2, 2)
    out.put(1, 1), out.put(1, 2), out.put(0, 3)
    out.image([("lit", 0xFF000000 | r2b << 16 | g2b << 8 | g2r)] * 9)
    out.put(0, 1)
    out.image(literal(stored), main=True)
    assert (decoded(out) == image).all()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes(size):
    rng = np.random.default_rng(size)
    palette, index = rng.integers(0, 256, (size, 4)), rng.integers(0, size, (5, 13))
    pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    each, wide = 8 >> pack, -(-13 >> pack)
    packed = np.zeros((5, wide, 4), int)
    for y in range(5):
        for x in range(13):
            packed[y, x >> pack, 2] |= int(index[y, x]) << each * (x & ((1 << pack) - 1))
    out = Writer()
    out.header(13, 5)
    out.put(1, 1), out.put(3, 2), out.put(size - 1, 8)
    out.image(literal(np.diff(palette, axis=0, prepend=np.zeros((1, 4), int)) & 255))
    out.put(0, 1)
    out.image(literal(packed), main=True)
    assert (decoded(out) == palette[index]).all()


def test_groups_of_codes():
    image = picture(8, 8, 8)
    out = Writer()
    out.header(8, 8)
    out.put(0, 1)
    out.put(0, 1)
    out.put(1, 1), out.put(0, 3)  # blocks of 4
    out.image([("lit", g << 8) for g in (0, 1, 1, 0)])
    writers = []
    for g in (0, 1):
        writers.append([out.code(np.ones(256, int) if k < 4 else [1], 280 if k == 0 else 256 if k < 4 else 40) for k in range(5)])
    for y in range(8):
        for x in range(8):
            a, r, g, b = map(int, image[y, x])
            own = writers[(y // 4 + x // 4) % 2]
            own[0](g), own[1](r), own[2](b), own[3](a)
    assert (decoded(out) == image).all()


def test_broken_files():
    good = W.store(b"hello world, this is a text" * 9)
    with pytest.raises(ValueError):
        W.decode(b"nonsense....")
    for cut in (30, 45, len(good) - 20):
        with pytest.raises(ValueError):
            W.decode_chunk(good[20:cut])


def test_frames(spark):
    df = spark.createDataFrame([(1, None, b"z"), (2, "", b"z"), (3, "é" * 50000, b"z"), (3, "abc", b"z"), (None, "abc", b"z")], "doc_id long, text string, media binary")
    got = W.store_texts(df).collect()
    assert sorted((r.n_bytes, len(r.payload)) for r in got) == [(0, 64), (0, 64), (3, 64), (3, 64), (100000, 100032)]
    assert len({(bytes(r.media), r.feature) for r in got}) == 3
    assert W.store_texts(df.limit(0)).count() == 0


def test_files_that_cannot_be_read_give_nulls(spark):
    good = W.store(b"some text")
    rows = [(0, good), (1, None), (2, b""), (3, good[:20]), (4, b"RIFF" + good[8:]), (5, b"no picture"), (6, good[:-3])]
    got = {r.i: r.back for r in spark.createDataFrame(rows, "i int, media binary").select("i", W.payload_column(F.col("media")).alias("back")).collect()}
    assert bytes(got[0].payload).rstrip(b"\0") == b"some text"
    assert all(got[i].payload is None and got[i].feature is None for i in (1, 5))
    assert set(got) == set(range(7))
