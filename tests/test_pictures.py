import hashlib
import io
import struct
import threading
import zipfile
import zlib

import numpy as np
import pytest

from docloom.plans.engine import Engine
from docloom.plans.jobs import Jobs
from docloom.sources import embedders, files, pictures


def png(pixels: np.ndarray, kinds=(0,)) -> bytes:
    """A PNG of grey (h, w) or colour (h, w, 3) samples; its lines are filtered by kinds in turn."""
    pixels = pixels.reshape(*pixels.shape[:2], -1).astype(int)
    h, w, c = pixels.shape
    lines = []
    for y in range(h):
        kind, line = kinds[y % len(kinds)], bytearray()
        for x in range(w):
            for k in range(c):
                a = pixels[y, x - 1, k] if x else 0
                b = pixels[y - 1, x, k] if y else 0
                d = pixels[y - 1, x - 1, k] if x and y else 0
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                line.append((int(pixels[y, x, k]) - int([0, a, b, (a + b) // 2, paeth][kind])) & 255)
        lines.append(bytes([kind]) + bytes(line))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def noise(seed: int, h=160, w=200) -> bytes:
    return png(np.random.default_rng(seed).integers(0, 256, (h, w)))


def relations(**targets) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" {t}/>' for k, t in targets.items())
    return f'<Relationships xmlns="{pictures.NS["rel"]}">{rows}</Relationships>'


def spaces(*names: str) -> str:
    return " ".join(f'xmlns:{n}="{pictures.NS[n]}"' for n in names)


def drawing(key: str, inches: float) -> str:
    side = int(inches * 914400)
    return f'<w:p><w:r><w:drawing><wp:extent cx="{side}" cy="{side}"/><a:blip r:embed="{key}"/></w:drawing></w:r></w:p>'


def docx(drawings: str, media: dict[str, bytes], **targets) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {spaces('w', 'wp', 'a', 'r')}><w:body><w:p><w:r><w:t>Words.</w:t></w:r></w:p>{drawings}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", relations(**targets))
        z.writestr("word/_rels/header1.xml.rels", relations(h='Target="media/header.png"'))
        for name, data in media.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("shape", [(9, 7), (8, 5, 3)])
def test_png_pixels(shape):
    want = np.random.default_rng(1).integers(0, 256, shape)
    got = pictures.png_pixels(png(want, (0, 1, 2, 3, 4)))
    assert got.tolist() == want.reshape(shape[0] * shape[1], -1).tolist()
    assert pictures.png_pixels(png(want)[:60]) is None and pictures.png_pixels(b"") is None


def test_sizes_and_ink():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03"
    assert pictures.size_of(jpeg) == (40, 30)
    assert pictures.size_of(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert pictures.size_of(b"BM" + bytes(16) + struct.pack("<ii", 7, -8)) == (7, 8)
    assert pictures.size_of(b"\x89PNG\r\n\x1a\n") is None and pictures.size_of(b"") is None and pictures.size_of(jpeg[:12]) is None
    flat = np.full((100, 1), 9, np.uint8)
    assert pictures.ink_of(flat) == (0.0, 0.0)
    flat[:25] = 200
    entropy, ink = pictures.ink_of(flat)
    assert ink == 0.25 and entropy == pytest.approx(0.811278, abs=1e-6)
    assert pictures.ink_of(np.empty((0, 1), np.uint8)) == (0.0, 0.0)


def test_placed_pictures():
    a, b = noise(1), noise(2)
    media = {"word/media/a.png": a, "word/media/b.png": b, "word/media/header.png": noise(3), "word/x.emf": b"emf"}
    targets = {"r1": 'Target="media/a.png"', "r2": 'Target="/word/media/b.png"', "r3": 'Target="x.emf"', "r4": 'Target="media/no.png"', "r5": 'Target="media/a.png" TargetMode="External"'}
    found = pictures.pictures_of(".DOCX", docx(drawing("r2", 2) + drawing("r1", 3) + drawing("r3", 2) + drawing("r5", 2), media, **targets))
    assert [(p["part"], p["shown_width"], p["width"], p["height"]) for p in found] == [("word/media/b.png", 2.0, 200, 160), ("word/media/a.png", 3.0, 200, 160)]
    assert found[0]["data"] == b and found[0]["sha256"] == hashlib.sha256(b).hexdigest() and found[0]["entropy"] > 7
    unplaced = pictures.pictures_of(".docx", docx("", media, **targets))
    assert [(p["part"], p["shown_width"]) for p in unplaced] == [("word/media/a.png", None), ("word/media/b.png", None)]
    for suffix, content in ((".docx", b"no archive"), (".docx", None), (".md", b"x"), (None, b"x")):
        assert pictures.pictures_of(suffix, content) == []


def test_slides():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in (1, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld {spaces("p", "a", "r")}><p:pic><a:blip r:embed="r1"/><a:ext cx="914400" cy="1828800"/></p:pic></p:sld>')
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", relations(r1='Target="../media/i.png"'))
        z.writestr("ppt/slideMasters/_rels/slideMaster1.xml.rels", relations(r1='Target="../media/logo.png"'))
        z.writestr("ppt/media/i.png", noise(4))
        z.writestr("ppt/media/logo.png", noise(5))
    found = pictures.pictures_of(".pptx", out.getvalue())
    assert [(p["slide"], p["part"], p["shown_width"], p["shown_height"]) for p in found] == [(1, "ppt/media/i.png", 1.0, 2.0), (2, "ppt/media/i.png", 1.0, 2.0)]


def test_engine_keeps_pictures(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    good, small, blank = noise(6), noise(7, 40, 40), png(np.zeros((200, 1000, 3)) + np.random.default_rng(0).integers(0, 9, (200, 1000, 3)))
    again = noise(8)
    media = {"word/media/g.png": good, "word/media/s.png": small, "word/media/b.png": blank, "word/media/x.png": again}
    targets = {"g": 'Target="media/g.png"', "s": 'Target="media/s.png"', "b": 'Target="media/b.png"', "x": 'Target="media/x.png"'}
    body = drawing("s", 2) + drawing("b", 2) + drawing("x", 2) * 3 + drawing("g", 2) + drawing("g", 0.5)
    (folder / "p.docx").write_bytes(docx(body, media, **targets))
    (folder / "q.md").write_text("# H\n\nplain")
    rows = {r.path: r for r in pictures.manifest(files.read_documents(spark, str(folder))).collect()}
    assert (rows["p.docx"].candidates, rows["p.docx"].kept) == (7, 1)
    assert rows["p.docx"].rejected == {"too_small": 1, "blank": 1, "repeated": 3, "small_on_page": 1}
    assert (rows["q.md"].candidates, rows["q.md"].kept, rows["q.md"].rejected) == (0, 0, {})

    engine = Engine(spark, str(tmp_path / "home"), embedders.HashedWords(16))
    engine.sync(str(folder))
    stub = engine.chunks.where("chunk_type = 'image_stub'").collect()
    assert len(stub) == 1 and stub[0].path == "p.docx" and engine.totals(str(folder))["images"] == 1
    held = engine.image(str(folder), stub[0].asset_id)
    assert held["data"] == good and held["file_name"] == f"docx-05-{hashlib.sha256(good).hexdigest()[:10]}.png"
    assert engine.image(str(folder), image_path=held["image_path"])["asset_id"] == stub[0].asset_id == held["asset_id"]
    assert held["image_path"] == stub[0].asset_path and engine.image(str(folder), "none") is None
    (folder / "p.docx").unlink()
    engine.sync(str(folder))
    assert engine.images(str(folder)).count() == 0 and engine.chunks.where("chunk_type = 'image_stub'").count() == 0


def test_retries_and_local_embedder():
    class Busy(Exception):
        status_code = 503

    pauses, replies = [], [Busy(), Exception("429 slow"), [[1.0]]]

    def embed(texts):
        reply = replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    assert embedders.Retrying(embed, sleep=pauses.append)(["a"]) == [[1.0]] and pauses == [5.0, 10.0]
    replies[:] = [ValueError("wrong key")]
    with pytest.raises(ValueError, match="wrong key"):
        embedders.Retrying(embed, sleep=pauses.append)(["a"])
    replies[:] = [[[1.0]]]
    with pytest.raises(ValueError, match="1 vectors for 2 texts"):
        embedders.Retrying(embed)(["a", "b"])
    replies[:], pauses[:] = [Busy()] * 6, []
    with pytest.raises(Busy):
        embedders.Retrying(embed, sleep=pauses.append)(["a"])
    assert pauses == [5.0, 10.0, 20.0, 40.0, 80.0]
    one, same, other, none = embedders.HashedWords(64)(["Red cat", "cat red", "blue dog", ""])
    assert one == same != other and sum(x * x for x in one) == pytest.approx(1.0) and not any(none)


def test_wait_idle(spark):
    jobs, gate = Jobs(spark), threading.Event()
    assert jobs.wait_idle(0)
    jobs.submit("held", gate.wait)
    assert not jobs.wait_idle(0.1)
    gate.set()
    assert jobs.wait_idle(10)
