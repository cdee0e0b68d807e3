"""Content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(separator: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def work_key(author: Column, title: Column, first_line: Column) -> Column:
    """The key that editions of a work share: 32 hex digits."""
    return F.substring(_digest("|", author, title, first_line), 1, 32)


def content_hash(edition: Column, file: Column, title: Column, text_match: Column) -> Column:
    return _digest("|", edition, file, title, text_match)


def addition_hash(title: Column, author: Column, text_match: Column) -> Column:
    return _digest("\n", title, author, text_match)
