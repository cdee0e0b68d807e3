"""What kind of file an upload is, from its first 64 KiB."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 65_536
# What files begin with.
ZIP, OLE, UTF16 = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", (b"\xff\xfe", b"\xfe\xff")


@dataclass(frozen=True)
class Kind:
    """kind where the file can be read (xlsx or jsonl), else why not; line is the first bad line."""

    kind: str | None = None
    reason: str | None = None
    note: str | None = None
    line: int | None = None


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def _decoded(head: bytes, whole: bool) -> str | None:
    try:
        return head.decode("utf-8")
    except UnicodeDecodeError as error:
        # a character cut by the end of the head is no fault
        return head[: error.start].decode("utf-8") if not whole and error.start >= len(head) - 3 and error.reason == "unexpected end of data" else None


def sniff(head: bytes, whole: bool = True) -> Kind:
    """The kind of a file by its head; whole says that the head is all of it."""
    if not head:
        return Kind(reason="empty")
    if head.startswith(ZIP):
        return Kind("xlsx")
    if head.startswith(OLE):
        return Kind(reason="xls_legacy")
    text = None if head.startswith(UTF16) else _decoded(head, whole)
    if text is None:
        return Kind(reason="not_utf8")
    text = text.removeprefix("﻿").lstrip()
    lines = [x.strip() for x in text.split("\n")[:-1] if x.strip()]  # the last may be cut
    if not text:
        return Kind(reason="empty")
    if text[0] == "[":
        return Kind(reason="json_array")
    if text[0] == "{":
        if not lines:
            return Kind("jsonl", note="single_record_unverified")
        bad = next((i for i, x in enumerate(lines, 1) if not _is_object(x)), None)
        if bad is None:
            return Kind("jsonl")
        return Kind(reason="json_array") if _is_object("".join(lines)) else Kind(reason="unknown", line=bad)
    first = lines[:10]
    counts = [[x.count(mark) for x in first] for mark in ",\t;"]
    if len(first) > 1 and any(c[0] > 0 and len(set(c)) == 1 for c in counts):
        return Kind(reason="csv_like")
    return Kind(reason="unknown")


def kinds(content: Column) -> Column:
    """struct(kind, reason, note, line) of contents, by their heads of HEAD_BYTES; null is an empty file."""
    def judged(heads: pd.Series, whole: pd.Series) -> pd.DataFrame:
        found = [sniff(bytes(h or b""), w) for h, w in zip(heads, whole)]
        return pd.DataFrame({"kind": [k.kind for k in found], "reason": [k.reason for k in found], "note": [k.note for k in found], "line": pd.array([k.line for k in found], dtype="Int64")})

    whole = F.coalesce(F.octet_length(content) <= HEAD_BYTES, F.lit(True))
    return F.pandas_udf(judged, "kind string, reason string, note string, line bigint")(F.substring(content, 1, HEAD_BYTES), whole)


def sniff_file(spark: SparkSession, path: str) -> Kind:
    """The kind of a file that Spark can reach; only its head is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    size = fs.getFileStatus(place).getLen()
    stream = fs.open(place)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(size, HEAD_BYTES))))
    finally:
        stream.close()
    return sniff(head, size <= HEAD_BYTES)
