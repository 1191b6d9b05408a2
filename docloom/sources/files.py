"""Folders as tables of files, and the content of single files."""

from __future__ import annotations

import os
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.batches import bound_batches

from . import pictures
from .decoders import SUFFIXES, markdown_of

CONTENT_BYTES, LISTED = 4_000_000, 300


def normal_root(path: str) -> str:
    """Absolute POSIX path of a folder as a user may give it: quoted, with ~, or with a Windows drive."""
    path = path.strip().strip("\"'")
    if m := re.match(r"^([A-Za-z]):[\\/](.*)$", path):
        path = f"/mnt/{m.group(1).lower()}/" + m.group(2)
    return os.path.abspath(os.path.expanduser(path.replace("\\", "/")))


def scan(spark: SparkSession, root: str, content: bool = False, hidden: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Supported files below root: root, path, name, ext, size, mtime_ns; content is read only if asked for.

    Names that start with a dot are left out at any depth unless hidden is set; Spark itself leaves out names that
    start with an underscore.  With paths only those files are looked at."""
    reader = spark.read.format("binaryFile")
    if paths is None:
        files = reader.option("recursiveFileLookup", True).load(root)
    else:
        files = reader.load([f"{root}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths])
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    rel = F.substring(F.regexp_replace(path, "/+", "/"), len(base) + 2, 1_000_000)
    rows = files.select(
        F.lit(base).alias("root"),
        rel.alias("path"),
        X.file_name(rel).alias("name"),
        X.suffix(rel).alias("ext"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        *([F.col("content")] if content else []),
    )
    seen = F.lit(True) if hidden else ~F.col("path").rlike(r"(^|/)\.")
    return rows.where(seen & F.col("ext").isin(*SUFFIXES))


def file_meta(spark: SparkSession, root: str, path: str) -> DataFrame:
    return scan(spark, root).where(F.col("path") == path)


def listing(spark: SparkSession, root: str, limit: int = LISTED) -> DataFrame:
    return scan(spark, root, hidden=True).select("path").orderBy("path").limit(limit)


def tree(files: DataFrame) -> dict:
    """Folders and files nested by name; only names come to the driver."""
    top: dict = {"name": "", "folders": {}, "files": []}
    for row in files.select("path").orderBy("path").toLocalIterator():
        *folders, name = row["path"].split("/")
        node = top
        for f in folders:
            node = node["folders"].setdefault(f, {"name": f, "folders": {}, "files": []})
        node["files"].append(name)
    return top


def read_content(spark: SparkSession, root: str, path: str, most: int = CONTENT_BYTES) -> dict:
    """Text of a file, or base64 if it is none; cut at `most` bytes.  Paths that leave root are refused."""
    parts = PurePosixPath(path).parts
    if path.startswith("/") or ".." in parts:
        raise ValueError("the path leaves the folder")
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}")
    head = F.substring("content", 1, most)
    row = files.select(
        head.alias("head"), F.base64(head).alias("base64"), (F.col("length") > most).alias("truncated"), F.col("length").alias("size")
    ).first()
    data = bytes(row["head"])
    known = PurePosixPath(path).suffix.lower() in (".md", ".markdown", ".txt", ".html", ".htm")
    is_text = known
    if not known and b"\0" not in data:
        try:
            data.decode("utf-8")
            is_text = True
        except UnicodeDecodeError as e:
            is_text = row["truncated"] and e.start >= len(data) - 3
    out = {"path": path, "size": row["size"], "truncated": row["truncated"]}
    return out | ({"encoding": "utf-8", "content": data.decode("utf-8", "replace")} if is_text else {"encoding": "base64", "content": row["base64"].replace("\r\n", "")})


def read_documents(spark: SparkSession, root: str, decoders=None, paths: list[str] | None = None) -> DataFrame:
    """root, path, text, error, content_hash, pictures of the files below root (or of paths alone), decoded on the executors."""
    bound_batches(spark)
    files = scan(spark, root, content=True, paths=paths)
    return files.select(
        "root", "path", "size", "mtime_ns", F.sha2("content", 256).alias("content_hash"), markdown_of(F.col("ext"), F.col("content"), decoders).alias("d"),
        pictures.pictures(F.col("ext"), F.col("content")).alias("found"),
    ).select("root", "path", "size", "mtime_ns", "content_hash", F.make_valid_utf8("d.text").alias("text"), "d.error", pictures.judged(F.col("found")).alias("pictures"))
