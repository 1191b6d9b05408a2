"""Pictures inside office files: where they are placed, their sizes and ink, and which of them are kept."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import assets

# Namespaces, units and suffixes of the formats.
NS = {
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "p": "http://schemas.openxmlformats.org/presentationml/2006/main",
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
}
EMU_PER_INCH = 914_400
SAMPLES = 4096
FORMATS = (".png", ".jpg", ".jpeg", ".gif", ".bmp")

#: By suffix: the element that holds a picture, and where its size on the page stands, in order of preference.
HOLDERS = {".docx": (".//w:drawing", (".//wp:extent", ".//a:ext")), ".pptx": (".//p:pic", (".//a:ext",))}
PICTURE = (
    "position int, slide int, part string, format string, sha256 string, width int, height int,"
    " entropy double, ink double, shown_width double, shown_height double, data binary"
)


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header of a PNG, JPEG, GIF or BMP file; None for others and damaged ones."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return abs(width), abs(height)
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                kind, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return width, height
                at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


def png_pixels(data: bytes) -> np.ndarray | None:
    """Samples (pixel, channel) of a PNG of 8 bits without interlacing; None for any other file."""
    chunks, at = {}, 8
    while at + 8 <= len(data):
        length = int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8]
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + length]
        at += 12 + length
    head = chunks.get(b"IHDR", b"")
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(head) != 13 or head[8] != 8 or head[12]:
        return None
    width, height = struct.unpack(">II", head[:8])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9])
    try:
        raw = np.frombuffer(zlib.decompress(chunks.get(b"IDAT", b"")), np.uint8)
    except zlib.error:
        return None
    if not channels or len(raw) != height * (width * channels + 1):
        return None
    raw = raw.reshape(height, -1)
    above = np.zeros((width, channels), np.uint8)
    out = np.empty((height, width, channels), np.uint8)
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:])):
        line = line.reshape(width, channels)
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = np.array(_along(line.tolist(), above.tolist(), kind), np.uint8)
        out[y] = above = line
    pixels = out.reshape(-1, channels)
    if head[9] == 3:
        colours = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        return colours[pixels[:, 0]] if len(colours) and pixels.max(initial=0) < len(colours) else None
    return pixels


def _along(line: list[list[int]], above: list[list[int]], kind: int) -> list[list[int]]:
    """A line that was filtered by the mean of left and above (3), or by the nearest of three neighbours (4)."""
    left = corner = [0] * len(line[0]) if line else []
    done = []
    for own, up in zip(line, above):
        if kind == 3:
            left = [(v + (a + b) // 2) & 255 for v, a, b in zip(own, left, up)]
        else:
            near = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner)]
            left = [(v + n) & 255 for v, n in zip(own, near)]
        corner = up
        done.append(left)
    return done


def ink_of(pixels: np.ndarray) -> tuple[float, float]:
    """Entropy of the grey values of some 4096 pixels, and the share of those unlike the commonest."""
    some = pixels[:: max(1, len(pixels) // SAMPLES)].astype(np.int64)
    if not len(some):
        return 0.0, 0.0
    grey = some[:, :3] @ np.array([299, 587, 114]) // 1000 if some.shape[1] >= 3 else some[:, 0]
    values, first, counts = np.unique(grey, return_index=True, return_counts=True)
    share = counts / len(grey)
    commonest = values[min(range(len(values)), key=lambda i: (-counts[i], first[i]))]
    return float(-(share * np.log2(share)).sum()), float((np.abs(grey - commonest) > assets.INK_DELTA).mean())


def _targets(z: zipfile.ZipFile, owner: str) -> dict[str, str]:
    """Relationship id to picture file, of one part of the archive."""
    folder, name = posixpath.split(owner)
    try:
        relations = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels")).iterfind(".//rel:Relationship", NS)
    except (KeyError, ElementTree.ParseError):
        return {}
    inside = {r.get("Id"): r.get("Target", "").replace("\\", "/") for r in relations if r.get("TargetMode") != "External" and r.get("Type", "").endswith("/image")}
    whole = {k: posixpath.normpath(t.lstrip("/") if t.startswith("/") else f"{folder}/{t}") for k, t in inside.items() if k and t}
    there = set(z.namelist())
    return {k: part for k, part in whole.items() if part in there and posixpath.splitext(part)[1].lower() in FORMATS}


def _shown(holder, places: tuple[str, ...]) -> tuple[float, float] | None:
    """Width and height on the page, in inches."""
    at = next((e for e in (holder.find(p, NS) for p in places) if e is not None), None)
    try:
        size = [int(at.get(side) or 0) for side in ("cx", "cy")] if at is not None else [0]
    except ValueError:
        return None
    return (size[0] / EMU_PER_INCH, size[1] / EMU_PER_INCH) if min(size) > 0 else None


def placed(z: zipfile.ZipFile, suffix: str) -> list[tuple[int | None, str, tuple[float, float] | None]]:
    """(slide, part, size) of each placed picture of the body or the slides, in order.

    Headers, footers, masters and layouts are not looked at.  If no picture is placed, all that the body or the slides
    relate to are given, without sizes."""
    holder, places = HOLDERS[suffix]
    if suffix == ".docx":
        owners = [(None, f"word/{n}.xml") for n in ("document", "footnotes", "endnotes")]
    else:
        owners = [(int(m[1]), m[0]) for n in sorted(z.namelist()) if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    found, related = [], []
    for slide, owner in owners:
        targets = _targets(z, owner)
        related += [(slide, part, None) for part in targets.values()]
        try:
            page = ElementTree.fromstring(z.read(owner)) if targets else None
        except (KeyError, ElementTree.ParseError):
            continue
        for node in page.iterfind(holder, NS) if page is not None else ():
            blip = node.find(".//a:blip", NS)
            key = None if blip is None else blip.get(f"{{{NS['r']}}}embed") or blip.get(f"{{{NS['r']}}}link")
            if key in targets:
                found.append((slide, targets[key], _shown(node, places)))
    return found or related


def pictures_of(suffix: str | None, content: bytes | None) -> list[dict]:
    """Pictures of a DOCX or PPTX file; other and damaged files have none, pictures of unknown formats are left out.

    Entropy and ink are known of PNG files of 8 bits without interlacing, else None, which breaks no rule."""
    suffix, out = (suffix or "").lower(), []
    if suffix not in HOLDERS or not content:
        return out
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for k, (slide, part, shown) in enumerate(placed(z, suffix)):
                data = z.read(part)
                if (size := size_of(data)) is None:
                    continue
                pixels = png_pixels(data)
                entropy, ink = (None, None) if pixels is None else ink_of(pixels)
                wide, high = shown or (None, None)
                out.append(
                    {"position": k, "slide": slide, "part": part, "format": posixpath.splitext(part)[1].lower()[1:], "sha256": hashlib.sha256(data).hexdigest()}
                    | {"width": size[0], "height": size[1], "entropy": entropy, "ink": ink, "shown_width": wide, "shown_height": high, "data": data}
                )
    except (zipfile.BadZipFile, zlib.error):
        return []
    return out


def pictures(suffix: Column, content: Column) -> Column:
    """Array of pictures, each with reason: the first rule that it breaks, null if it is kept.

    Only office files are handed to Python; a document's pictures are judged within its row."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in PICTURE.split(', '))}>>")
    def found(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([pictures_of(s, c) for s, c in zip(suffixes, contents)], dtype=object)

    return found(suffix, F.when(F.lower(suffix).isin(*HOLDERS), content))


def judged(found: Column) -> Column:
    unknown = F.lit(None).cast("double")

    def reason(x: Column) -> Column:
        times = F.size(F.filter(found, lambda y: y["sha256"] == x["sha256"]))
        return assets.reject_reason(F.length(x["data"]), x["width"], x["height"], x["ink"], (unknown, unknown), (x["shown_width"], x["shown_height"]), times)

    return F.transform(found, lambda x: x.withField("reason", reason(x)))


def kept(judged_: Column, file_id: Column) -> Column:
    """Pictures that break no rule, with the name and path they are stored under."""

    def name(x: Column) -> Column:
        lead = F.when(x["slide"].isNotNull(), F.format_string("pptx-s%03d", x["slide"])).otherwise(F.lit("docx"))
        return F.concat(lead, F.format_string("-%02d-", x["position"]), F.substring(x["sha256"], 1, 10), F.lit("."), F.lower(x["format"]))

    good = F.filter(judged_, lambda x: x["reason"].isNull())
    named = F.transform(good, lambda x: x.withField("file_name", name(x)))
    return F.transform(named, lambda x: x.withField("image_path", F.concat(F.lit("images/"), file_id, F.lit("/"), x["file_name"])))


def manifest(docs: DataFrame, judged_col: str = "pictures") -> DataFrame:
    """root, path, candidates, kept, rejected (reason to count) of each document."""
    reasons = F.transform(F.filter(judged_col, lambda x: x["reason"].isNotNull()), lambda x: x["reason"])
    counted = F.transform(F.array_sort(F.array_distinct("_reasons")), lambda r: F.struct(r, F.size(F.filter("_reasons", lambda s: s == r))))
    rows = docs.select("root", "path", F.size(judged_col).alias("candidates"), reasons.alias("_reasons"))
    return rows.select("root", "path", "candidates", (F.col("candidates") - F.size("_reasons")).alias("kept"), F.map_from_entries(counted).alias("rejected"))
