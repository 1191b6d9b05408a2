"""Identities, all computed from content."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(root: Column, path: Column) -> Column:
    """By folder and relative path: equal paths in two folders differ."""
    return F.md5(F.concat_ws("\n", root, path))


def chunk_id(file: Column, seq: Column) -> Column:
    return F.concat_ws(":", file, seq.cast("string"))


def table_id(file: Column, section: Column, index: Column) -> Column:
    return F.concat(file, F.lit("_"), section, F.lit("_t"), index.cast("string"))


def image_id(file: Column, index: Column) -> Column:
    return F.concat(file, F.lit("_s0_p"), index.cast("string"))


def short_key(root: Column, path: Column | None = None) -> Column:
    key = F.substring(F.md5(root), 1, 8)
    return key if path is None else F.concat(key, F.lit("_"), F.substring(F.md5(path), 1, 8))


def point_id(chunk: Column) -> Column:
    """UUID of version 5 in the URL name space."""

    @F.pandas_udf("string")
    def named(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: None if c is None else str(uuid.uuid5(uuid.NAMESPACE_URL, c)))

    return named(chunk)


TOOL_ID = r"^[0-9a-f]{32}_[A-Za-z0-9.\-]+_[tp]\d+$"


def is_tool_id(column: Column) -> Column:
    """Form of a table or image id: 32 hex digits, section, t or p with a number."""
    return F.coalesce(column.rlike(TOOL_ID), F.lit(False))
