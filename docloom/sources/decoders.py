"""File content to Markdown, by suffix."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.operators.markdown import BLOCK, normalize, parse_blocks, render_table

SUFFIXES = (".md", ".markdown", ".txt", ".docx", ".pptx", ".pdf", ".html", ".htm")
_DROPPED = frozenset("script style noscript nav footer header aside".split())
_BLOCKS = frozenset("p div section article main ul ol blockquote h1 h2 h3 h4 h5 h6 pre tr table body".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Unsupported(ValueError):
    """No decoder for the suffix, or none on this machine."""


class _Page(HTMLParser):
    """Headings, paragraphs, lists and tables of a page as Markdown, without its furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.dropped = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.head = False

    def flush(self):
        if words := " ".join("".join(self.line).split()):
            self.out.append(self.prefix + words)
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.dropped += 1
        elif self.dropped:
            return
        elif tag in ("title", "head"):
            self.head = True
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            self.cell = []
        elif tag == "br":
            (self.line if self.cell is None else self.cell).append(" ")
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag in _BLOCKS and self.rows is None:
            self.flush()
            if tag[0] == "h" and tag[1:].isdigit():
                self.prefix = "#" * int(tag[1]) + " "

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            return
        elif tag == "head":
            self.head = False
        elif tag in ("td", "th") and self.rows and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "/"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            self.out.append(render_table([r for r in self.rows if r]))
            self.rows = self.cell = None
        elif tag in _BLOCKS and self.rows is None or tag == "li":
            self.flush()

    def handle_data(self, data):
        if not self.dropped and not self.head:
            (self.line if self.cell is None else self.cell).append(data)


def html_markdown(content: bytes) -> str:
    page = _Page()
    page.feed(content.decode("utf-8", "replace"))
    page.close()
    page.flush()
    return "\n\n".join(x for x in page.out if x)


def text_markdown(content: bytes) -> str:
    return content.decode("utf-8", "replace")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_markdown(content: bytes) -> str:
    """Headings by their style, paragraphs and tables, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            out.append(render_table([[words(c).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]))
        elif node.tag == f"{_W}p" and (text := words(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            out.append("#" * int(level.group(1)) + " " + text if level else text)
    return "\n\n".join(out)


def pptx_markdown(content: bytes) -> str:
    """Slides in order: the first text of each is its heading."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()))
        pages = [ElementTree.fromstring(z.read(n)) for n in slides]
    out = []
    for page in pages:
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in page.iter(f"{_A}p")]
        lines = [x for x in lines if x]
        out += ["# " + lines[0], *lines[1:]] if lines else []
    return "\n\n".join(out)


def no_pdf(content: bytes) -> str:
    raise Unsupported("no PDF decoder on this machine; register one for .pdf")


DECODERS = {
    ".md": text_markdown, ".markdown": text_markdown, ".txt": text_markdown, ".html": html_markdown, ".htm": html_markdown,
    ".docx": docx_markdown, ".pptx": pptx_markdown, ".pdf": no_pdf,
}


def decode(suffix: str, content: bytes, decoders=None) -> str:
    decoder = (decoders or DECODERS).get((suffix or "").lower())
    if decoder is None:
        raise Unsupported(f"no decoder for {suffix or 'files without a suffix'}")
    return decoder(content or b"")


def read(suffix: str, content: bytes, decoders=None) -> tuple[str | None, str | None]:
    """(text, error): one of the two is None."""
    try:
        return decode(suffix, content, decoders), None
    except Exception as e:  # any decoder may fail in its own way; the row says how
        return None, f"{type(e).__name__}: {e}"


def markdown_of(suffix: Column, content: Column, decoders=None) -> Column:
    """struct<text, error>: one of the two is null; a file that cannot be read does not stop the others."""

    @F.pandas_udf("struct<text:string, error:string>")
    def decoded(suffixes: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(s, c, decoders) for s, c in zip(suffixes, contents)], columns=["text", "error"], dtype=object)

    return decoded(suffix, content)


def blocks_of(suffix: Column, content: Column, decoders=None) -> Column:
    """Blocks of a file in one pass of one worker, empty for one that cannot be read: markdown.blocks_of of markdown_of."""

    @F.pandas_udf(f"array<{BLOCK}>")
    def parsed(suffixes: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([parse_blocks(normalize(read(s, c, decoders)[0])) for s, c in zip(suffixes, contents)], dtype=object)

    return parsed(suffix, content)
