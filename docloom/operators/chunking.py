"""Documents to self-describing chunks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.batches import bound_batches

from . import markdown, structure

TARGET, MOST = 1200, 1800
ROW_KEYS, BREADCRUMB_DEPTH = 40, 3

CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in "chunk_id file_id root path url title file_name section_heading".split()]
    + [T.StructField(n, T.IntegerType()) for n in "seq section_level section_depth".split()]
    + [T.StructField("breadcrumbs", T.StringType()), T.StructField("section_id", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in "section_ancestors section_titles section_numbers".split()]
    + [T.StructField("section_depths", T.ArrayType(T.IntegerType()))]
    + [T.StructField(n, T.StringType()) for n in "section_title_clean section_number raw_heading chunk_type context_header doc_type".split()]
    + [T.StructField("char_count", T.IntegerType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in "asset_id asset_path caption table_number content".split()]
    + [T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("row_count", T.IntegerType())]
    + [T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]
)


def split_text(text: str | None, target: int = TARGET, most: int = MOST) -> list[str]:
    """Pieces of a text: whole if it is no longer than most; else paragraphs packed up to target; a paragraph
    over most is cut every most characters, one between the two stands alone."""
    text = (text or "").strip()
    if len(text) <= most:
        return [text] if text else []
    out: list[str] = []
    packed = ""
    for paragraph in text.split("\n\n"):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        if len(paragraph) > most:
            out += [packed] if packed else []
            packed = ""
            out += [paragraph[k : k + most] for k in range(0, len(paragraph), most)]
        elif packed and len(packed) + 2 + len(paragraph) <= target:
            packed = f"{packed}\n\n{paragraph}"
        else:
            out += [packed] if packed else []
            packed = paragraph
    return out + ([packed] if packed else [])


def _strip(c: Column) -> Column:
    """White space off both ends; only texts that have some there are searched."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)[\s\x1c-\x1f]"), F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).otherwise(c)


def split_column(text: Column, target: int = TARGET, most: int = MOST) -> Column:
    """split_text as a fold in the JVM; the text is stripped once."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("packed"))
    done = lambda s: F.when(s["packed"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["packed"])))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda k: F.substring(p, k * most + 1, F.lit(most)))

    def step(s, p):
        fits = (s["packed"] != "") & (F.length(s["packed"]) + 2 + F.length(p) <= target)
        return (
            F.when(F.length(p) > most, F.struct(F.concat(done(s), cut(p)).alias("out"), F.lit("").alias("packed")))
            .when(fits, F.struct(s["out"].alias("out"), F.concat(s["packed"], F.lit("\n\n"), p).alias("packed")))
            .otherwise(F.struct(done(s).alias("out"), p.alias("packed")))
        )

    def pieces(trimmed):
        paragraphs = F.filter(F.transform(F.split(trimmed, "\n\n"), _strip), lambda p: p != "")
        folded = F.aggregate(paragraphs, start, step, done)
        return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).when(F.length(trimmed) <= most, F.array(trimmed)).otherwise(folded)

    return F.get(F.transform(F.array(_strip(text)), pieces), F.lit(0))


def context_header(name: str, crumbs: list[str]) -> str:
    return f"[Document: {name} | Section: {' > '.join(crumbs[:BREADCRUMB_DEPTH])}]"


def table_stub_text(table_id: str, caption: str, rows: list[list[str]]) -> str:
    keys = [r[0] for r in rows[1:] if r and r[0].strip()][:ROW_KEYS]
    return "\n".join(
        [
            f"[Table: {table_id}]",
            f"Caption: {caption}",
            f"Columns: {', '.join(rows[0])}",
            f"Row entities: {', '.join(keys)}",
            f"Total rows: {len(rows) - 1}",
        ]
    )


def image_stub_text(image_id: str, path: str | None, caption: str | None) -> str:
    first = f"[Image: {image_id}]" + (f" {path}" if path else "")
    return first + (f"\nCaption: {caption}" if caption else "")


def chunk_document(root: str, path: str, text: str | None, images: list[dict] | None = None) -> list[dict]:
    """Chunks of one Markdown document in order; table stubs carry their rows.

    A heading closes the text above it under the section before.  A table closes the text, leaves a stub,
    and is pointed to by the text that follows.  Images end the document: their stubs in s0, and pointers
    to them as one more text of the last section."""
    file = hashlib.md5(f"{root}\n{path}".encode()).hexdigest()
    name = path.rsplit("/", 1)[-1]
    title = name.rsplit(".", 1)[0] if "." in name[1:] else name
    blocks = structure.attach_captions(structure.merge_page_breaks(markdown.parse_blocks(markdown.normalize(text))))
    overview = {"id": "s0", "title": "Overview", "raw": "Overview", "number": "", "raw_level": 0, "depth": 0}
    stack, trail = structure.SectionStack(), [overview]
    out: list[dict] = []
    body: list[str] = []

    def emit(kind: str, part: str, trail: list[dict], **more) -> None:
        section = trail[-1]
        crumbs = [s["raw"] for s in trail]
        header = context_header(name, crumbs)
        whole = f"{header}\n\n{part}"
        out.append(
            {"chunk_id": f"{file}:{len(out) + 1}", "file_id": file, "root": root, "path": path, "url": path, "title": title, "file_name": name}
            | {"section_heading": section["raw"] + (" (Table)" if kind == "table_stub" else ""), "seq": len(out) + 1}
            | {"section_level": section["raw_level"], "section_depth": section["depth"], "breadcrumbs": " > ".join(crumbs)}
            | {"section_id": section["id"], "section_ancestors": [s["id"] for s in trail], "section_titles": [s["title"] for s in trail]}
            | {"section_numbers": [s["number"] for s in trail], "section_depths": [s["depth"] for s in trail]}
            | {"section_title_clean": section["title"], "section_number": section["number"], "raw_heading": section["raw"]}
            | {"chunk_type": kind, "context_header": header, "doc_type": "local", "char_count": len(whole), "text": whole}
            | more
        )

    def flush() -> None:
        for part in split_text("\n\n".join(body)):
            emit("text", part, trail)
        body.clear()

    tables = 0
    for b in blocks:
        if b["type"] == "heading":
            flush()
            stack.enter(b["level"], b["text"])
            trail = stack.path()
        elif b["type"] == "table":
            flush()
            key = f"{file}_{trail[-1]['id']}_t{tables}"
            tables += 1
            rows, caption = b["rows"] or [], b["caption"] or markdown.default_caption(b["rows"])
            stub = table_stub_text(key, caption, rows) if rows else "\n\n".join(x for x in (f"[Table: {key}]", caption, b["content"]) if x)
            emit(
                "table_stub", stub, trail, asset_id=key, caption=caption, table_number=b["table_number"], content=b["content"],
                headers=rows[0] if rows else [], row_count=max(0, len(rows) - 1), rows=rows,
            )
            body.append(f"[Ref Table: {key} - {caption}]")
        elif b["text"]:
            body.append(b["text"])
    flush()
    for k, image in enumerate(images or []):
        key = f"{file}_s0_p{k}"
        emit("image_stub", image_stub_text(key, image.get("image_path"), image.get("caption")), [overview], asset_id=key, asset_path=image.get("image_path"), caption=image.get("caption"))
        body.append(f"[Ref Image: {key}]")
    if body:
        emit("text", "\n".join(body), trail)
    return out


def chunk_frame(docs: DataFrame) -> DataFrame:
    """Chunks of docs (root, path, text): one pass over the rows, no shuffle; a document is chunked within its row.

    docs may have images, an array of structs with image_path and caption: they end their document as stubs."""
    bound_batches(docs.sparkSession)
    names = CHUNK.fieldNames()
    pictured = "images" in docs.columns

    def run(frames):
        for frame in frames:
            images = frame["images"] if pictured else [None] * len(frame)
            rows = [c for r, p, t, i in zip(frame["root"], frame["path"], frame["text"], images) for c in chunk_document(r, p, t, None if i is None else list(i))]
            out = pd.DataFrame(rows, columns=names)
            for n in ("seq", "section_level", "section_depth", "char_count", "row_count"):
                out[n] = out[n].astype("Int32")
            yield out.astype(object).where(out.notna(), None)

    return docs.select("root", "path", "text", *(["images"] if pictured else [])).mapInPandas(run, CHUNK)


def raw_tables(chunks: DataFrame) -> DataFrame:
    """The tables behind the stubs of chunks, by table_id."""
    return chunks.where("chunk_type = 'table_stub'").select(
        F.col("asset_id").alias("table_id"), "file_id", "root", "path", "section_id", F.col("breadcrumbs").alias("breadcrumb"), "caption",
        "table_number", "headers", "rows", "content", "row_count", F.size("headers").alias("col_count"),
    )
