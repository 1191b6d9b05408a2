"""Lossless WebP: a reader for whole files, and a writer that stores bytes as grey pictures.

The reader takes apart the RIFF container, decodes prefix codes, back-references and the colour cache, and
undoes the predictor, cross-colour, subtract-green and palette transforms; it gives arrays of height x
width x 4 (alpha, red, green, blue).  The writer puts one byte into each pixel (red = green = blue) of
pictures 64 pixels wide, subtracts green and gives every picture its own prefix code; pictures of more than
16384 rows are continued in a further file behind the first.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WIDTH, MOST_ROWS, LONGEST_CODE = 64, 16384, 12

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
#: Near pixels (left, up) by distance code: nearest first, then least sideways, then left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + bytes(8), 0, len(data) * 8

    def read(self, n: int) -> int:
        k = self.at >> 3
        value = (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise ValueError("picture data ends early")
        return value


class PrefixCode:
    """Canonical code: lookup by the next `width` bits gives symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used = np.zeros(1, np.int64)
        self.only = int(used[0]) if len(used) == 1 else None
        self.width = 0
        if self.only is not None:
            return
        sizes = lengths[used].astype(np.int64)
        order = np.lexsort((used, sizes))
        used, sizes = used[order], sizes[order]
        self.width = width = int(sizes[-1])
        if int((1 << (width - sizes)).sum()) != 1 << width:
            raise ValueError("prefix code is not complete")
        symbols = np.repeat(used, 1 << (width - sizes))
        spans = np.repeat(sizes, 1 << (width - sizes))
        at = reverse_bits(np.arange(1 << width), width)
        self.symbols = np.empty(1 << width, np.int32)
        self.lengths = np.empty(1 << width, np.int32)
        self.symbols[at], self.lengths[at] = symbols, spans
        self._pairs = None

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._pairs is None:
            self._pairs = list(zip(self.symbols.tolist(), self.lengths.tolist()))
        k = bits.at >> 3
        window = (int.from_bytes(bits.data[k : k + 4], "little") >> (bits.at & 7)) & ((1 << self.width) - 1)
        symbol, length = self._pairs[window]
        bits.at += length
        if bits.at > bits.size:
            raise ValueError("picture data ends early")
        return symbol


def _reversed16() -> np.ndarray:
    values, out = np.arange(1 << 16), np.zeros(1 << 16, np.int64)
    for _ in range(16):
        out = (out << 1) | (values & 1)
        values = values >> 1
    return out


_REVERSED = _reversed16()


def reverse_bits(values: np.ndarray, width) -> np.ndarray:
    """Numbers of `width` bits, 16 at most, back to front."""
    return _REVERSED[values] >> (16 - width)


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, count = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3) if s == 17 else 11 + bits.read(7))
        if at + count > alphabet:
            raise ValueError("code lengths run over")
        lengths[at : at + count] = value
        at += count
    return PrefixCode(lengths)


def _amount(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB numbers, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache is too large")
    groups, block_bits, per_row, group_of = 1, 0, 1, None
    if main and bits.read(1):
        block_bits = 2 + bits.read(3)
        per_row = -(-width >> block_bits)
        meta = read_pixels(bits, per_row, -(-height >> block_bits), False)
        group_of = ((meta >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
        groups = max(group_of) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_size and (fast := _literals(bits, codes[0], total)) is not None:
        return fast
    out: list[int] = []
    cache = [0] * cache_size
    shift = 32 - cache_bits

    def remember(start: int) -> None:
        for argb in out[start:]:
            cache[((CACHE_FACTOR * argb) & 0xFFFFFFFF) >> shift] = argb

    while (n := len(out)) < total:
        y, x = divmod(n, width)
        group = codes[group_of[(y >> block_bits) * per_row + (x >> block_bits)]] if group_of else codes[0]
        s = group[0].read(bits)
        if s < 256:
            r, b = group[1].read(bits), group[2].read(bits)
            out.append((group[3].read(bits) << 24) | (r << 16) | (s << 8) | b)
        elif s < 280:
            length = _amount(s - 256, bits)
            code = _amount(group[4].read(bits), bits)
            if code > 120:
                back = code - 120
            else:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > n or n + length > total:
                raise ValueError("back-reference leaves the picture")
            if back >= length:
                out += out[n - back : n - back + length]
            else:
                out += (out[n - back :] * (length // back + 1))[:length]
        else:
            out.append(cache[s - 280])
        if cache_size:
            remember(n)
    return np.array(out, np.uint32)


def _literals(bits: Bits, group: list[PrefixCode], total: int) -> np.ndarray | None:
    """All pixels at once where only green varies and every symbol is a literal; else None.

    The symbol at every bit is looked up; following the lengths from the first bit tells which count."""
    green = group[0]
    if any(c.only is None for c in group[1:4]) or (green.only is not None and green.only > 255):
        return None
    if green.only is not None:
        values = np.full(total, green.only, np.uint32)
    else:
        if int(green.symbols.max()) > 255:
            return None
        first = bits.at >> 3
        raw = np.frombuffer(bits.data, np.uint8)[first:].astype(np.uint32)
        words = raw[:-3] | (raw[1:-2] << 8) | (raw[2:-1] << 16)
        windows = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.width) - 1)).ravel()
        end = len(windows)
        one = np.empty(end + 1, np.int32)
        np.minimum(np.arange(end) + green.lengths[windows], end, out=one[:-1], casting="unsafe")
        one[end] = end
        two = one[one]
        four = two[two]
        eight = memoryview(four[four])
        at, marks = bits.at & 7, []
        put = marks.append
        for _ in range(-(-total // 8)):  # every eighth symbol is walked to, those between are looked up
            put(at)
            at = eight[at]
        spots = np.array(marks, np.int32)
        for jump in (four, two, one):
            spots = np.column_stack([spots, jump[spots]]).ravel()
        spots = spots[:total]
        bits.at = first * 8 + int(one[spots[-1]])
        if bits.at > bits.size or spots[-1] >= end:
            raise ValueError("picture data ends early")
        values = green.symbols[windows[spots]].astype(np.uint32)
    rest = (group[3].only << 24) | (group[1].only << 16) | group[2].only
    return np.uint32(rest) | (values << np.uint32(8))


def channels(argb: np.ndarray, width: int) -> np.ndarray:
    """height x width x 4 as int32: alpha, red, green, blue."""
    return ((argb[:, None] >> np.array([24, 16, 8, 0], np.uint32)) & np.uint32(255)).astype(np.int32).reshape(-1, width, 4)


def _half(a, b):
    return (a + b) >> 1


def _guess(mode: int, left, up, corner, right):
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(up))
    if mode in (1, 2, 3, 4):
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return _half(_half(left, right), up)
    if mode in (6, 7, 8, 9):
        return _half(*((left, corner), (left, up), (corner, up), (up, right))[mode - 6])
    if mode == 10:
        return _half(_half(left, corner), _half(up, right))
    if mode == 11:
        to_left, to_up = np.abs(up - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_up, left, up)
    if mode == 12:
        return np.clip(left + up - corner, 0, 255)
    if mode == 13:
        mean = _half(left, up)
        away = mean - corner
        return np.clip(mean + np.where(away < 0, -(-away >> 1), away >> 1), 0, 255)
    raise ValueError("unknown predictor")


_FROM_ABOVE = (0, 2, 3, 4, 8, 9)


def undo_predictor(image: np.ndarray, modes: np.ndarray, block_bits: int) -> None:
    """Adds each pixel's prediction in place; runs of blocks that look above only are done at once."""
    height, width, _ = image.shape
    image[0, 0] = (image[0, 0] + (255, 0, 0, 0)) & 255
    image[0] = np.cumsum(image[0], 0) & 255
    step = 1 << block_bits
    for y in range(1, height):
        row, above = image[y], image[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for block in range(modes.shape[1]):
            mode = int(modes[y >> block_bits, block])
            a, b = max(1, block * step), min(width, (block + 1) * step)
            if a >= b:
                continue
            right = np.concatenate([above[a + 1 : b + 1], row[:1]])[: b - a]
            if mode in _FROM_ABOVE:
                row[a:b] = (row[a:b] + _guess(mode, None, above[a:b], above[a - 1 : b - 1], right)) & 255
            elif mode == 1:
                row[a:b] = (np.cumsum(row[a:b], 0) + row[a - 1]) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + _guess(mode, row[x - 1], above[x], above[x - 1], right[x - a])) & 255


def _signed(x):
    return x - ((x & 128) << 1)


def undo_cross_colour(image: np.ndarray, elements: np.ndarray, block_bits: int) -> None:
    height, width, _ = image.shape
    e = np.repeat(np.repeat(elements, 1 << block_bits, 0), 1 << block_bits, 1)[:height, :width]
    red_to_blue, green_to_blue, green_to_red = (_signed(e[..., k]) for k in (1, 2, 3))
    green = _signed(image[..., 2])
    red = (image[..., 1] + ((green_to_red * green) >> 5)) & 255
    image[..., 3] = (image[..., 3] + ((green_to_blue * green) >> 5) + ((red_to_blue * _signed(red)) >> 5)) & 255
    image[..., 1] = red


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    each = 8 >> pack
    index = image[..., 2]
    if pack:
        index = (index[..., None] >> (each * np.arange(1 << pack))) & ((1 << each) - 1)
        index = index.reshape(len(image), -1)[:, :width]
    padded = np.zeros((max(256, len(palette)), 4), np.int32)
    padded[: len(palette)] = palette
    return padded[index]


def decode_chunk(data: bytes) -> np.ndarray:
    """Pixels of one VP8L chunk as height x width x 4 (alpha, red, green, blue), uint8."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless picture")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    wide, todo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("transform given twice")
        seen.add(kind)
        if kind in (0, 1):
            block_bits = 2 + bits.read(3)
            across = -(-wide >> block_bits)
            todo.append((kind, channels(read_pixels(bits, across, -(-height >> block_bits), False), across), block_bits))
        elif kind == 2:
            todo.append((kind, None, 0))
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(channels(read_pixels(bits, size, 1, False), size)[0], 0) & 255
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, (palette, wide), pack))
            wide = -(-wide >> pack)
    image = channels(read_pixels(bits, wide, height, True), wide)
    for kind, more, n in reversed(todo):
        if kind == 0:
            undo_predictor(image, more[..., 2], n)
        elif kind == 1:
            undo_cross_colour(image, more, n)
        elif kind == 2:
            image[..., 1:4:2] = (image[..., 1:4:2] + image[..., 2:3]) & 255
        else:
            image = undo_palette(image, more[0], more[1], n)
    return image.astype(np.uint8)


def decode(media: bytes) -> list[np.ndarray]:
    """Pictures of one or more files standing one behind the other."""
    pictures, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        k = at + 12
        while k + 8 <= end:
            size = struct.unpack_from("<I", media, k + 4)[0]
            if media[k : k + 4] == b"VP8L":
                pictures.append(decode_chunk(media[k + 8 : k + 8 + size]))
            k += 8 + size + (size & 1)
        at = end + (end - at & 1)
    return pictures


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Prefix code lengths for symbol counts, none over `longest`; two symbols at least get a length."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    weights = [int(counts[s]) for s in used]
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = list(range(len(used)))
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = len(parent)
            parent.append(len(parent))
            heapq.heappush(heap, (a + b, len(parent) - 1))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= longest:
            out[used] = depth[: len(used)]
            return out
        floor = sum(weights) >> longest - 1
        weights = [w + floor + 1 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bits reversed for writing."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    longest = int(size[-1])
    starts = np.concatenate([[0], np.cumsum(1 << (longest - size))[:-1]])
    codes[order] = reverse_bits(starts >> (longest - size), size)
    return codes


def _write_code(put, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and max(used) < 256:
        put(1, 1), put(len(used) - 1, 1), put(1, 1)
        for s in used:
            put(s, 8)
        return
    tokens, run = [], 0
    for s in [*lengths[: used[-1] + 1].tolist(), None]:
        if s == 0:
            run += 1
            continue
        while run:
            n = min(run, 138) if run >= 11 else run if run >= 3 else 1
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3) if n >= 3 else (0, 0, 0))
            run -= n
        if s is not None:
            tokens.append((s, 0, 0))
    of_tokens = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    if not of_tokens.any():
        of_tokens[tokens[0][0]] = 1
    codes = codes_of(of_tokens)
    count = max(4, max(i + 1 for i, s in enumerate(LENGTH_ORDER) if of_tokens[s]))
    put(0, 1), put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        put(int(of_tokens[s]), 3)
    put(1, 1), put(4, 3), put(len(tokens) - 2, 10)
    one = np.count_nonzero(of_tokens) == 1
    for s, extra, n in tokens:
        if not one:
            put(int(codes[s]), int(of_tokens[s]))
        if n:
            put(extra, n)


def encode_grey(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """One file with the samples as grey pixels; their number is a multiple of width, 16384 rows at most."""
    value = size = 0

    def put(v: int, n: int) -> None:
        nonlocal value, size
        value |= v << size
        size += n

    put(SIGNATURE, 8), put(width - 1, 14), put(len(samples) // width - 1, 14), put(0, 4)
    put(1, 1), put(2, 2), put(0, 1)  # subtract green, no other transform
    put(0, 1), put(0, 1)  # no colour cache, one group of codes
    counts = np.bincount(samples, minlength=280)
    if np.count_nonzero(counts) == 1:
        lengths = np.zeros(280, np.int64)
        lengths[samples[0]] = 1
    else:
        lengths = code_lengths(counts, LONGEST_CODE)
    _write_code(put, lengths)
    for constant in (0, 0, 255, 0):  # red, blue, alpha, distance
        put(1, 1), put(0, 1), put(1, 1), put(constant, 8)
    head = np.frombuffer(value.to_bytes(-(-size // 8), "little"), np.uint8)
    pixel_bits = np.empty(0, np.uint8)
    if np.count_nonzero(lengths) > 1:
        own = lengths[samples]
        ends = np.cumsum(own)
        which = np.repeat(np.arange(len(samples)), own)
        offset = np.arange(int(ends[-1])) - (ends - own)[which]
        pixel_bits = ((codes_of(lengths)[samples][which] >> offset) & 1).astype(np.uint8)
    data = np.packbits(np.concatenate([np.unpackbits(head, bitorder="little")[:size], pixel_bits]), bitorder="little").tobytes()
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def store(payload: bytes) -> bytes:
    """payload, zero-padded to a positive multiple of 64, as one or more grey pictures."""
    samples = np.frombuffer(payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH)), np.uint8)
    most = WIDTH * MOST_ROWS
    return b"".join(encode_grey(samples[k : k + most]) for k in range(0, len(samples), most))


def load(media: bytes) -> bytes:
    """The padded payload of stored pictures."""
    return b"".join(p[..., 2].tobytes() for p in decode(media))


def readable(media: bytes | None) -> bytes | None:
    """As load; None for None and for damaged files."""
    try:
        return None if media is None else load(media)
    except (ValueError, IndexError, struct.error):
        return None


def features(payload: bytes) -> str:
    """rows x columns, sum of samples, distinct samples, and a histogram of 16 bins."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    bins = "-".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
    return f"{len(samples) // WIDTH}x{WIDTH};{int((counts * np.arange(256)).sum())};{np.count_nonzero(counts)};{bins}"


def media_column(column):
    """Binary column to stored pictures; null like empty."""

    @F.pandas_udf("binary")
    def stored(values: pd.Series) -> pd.Series:
        return pd.Series([store(v or b"") for v in values], dtype=object)

    return stored(column)


def payload_column(column):
    """struct<payload, feature> read back from stored pictures; both null for null and for files that cannot be read."""

    @F.pandas_udf("struct<payload:binary, feature:string>")
    def loaded(values: pd.Series) -> pd.DataFrame:
        payloads = [readable(v) for v in values]
        return pd.DataFrame({"payload": payloads, "feature": [None if p is None else features(p) for p in payloads]}, dtype=object)

    return loaded(column)


def store_texts(docs, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, n_bytes, media (the files), payload (read back from them), feature of each row.

    Null and empty texts are stored as 64 zero bytes; repeated rows stay; an empty table gives no rows; other
    columns are not read."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), media_column(raw).alias("media"))
    return rows.withColumn("back", payload_column("media")).select("doc_id", "n_bytes", "media", "back.payload", "back.feature")
