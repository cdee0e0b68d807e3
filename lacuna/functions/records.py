"""Functions on nested values: key names, traces, verdicts, redaction, labels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 64


def to_camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def to_snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: f"_{m[0].lower()}", name)


def renamed(kind: T.DataType, rename: Callable[[str], str], depth: int = 0) -> T.DataType:
    """A type with the names of its structs changed, through arrays, to a depth of 64; maps are left alone."""
    if depth > DEPTH:
        return kind
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(rename(f.name), renamed(f.dataType, rename, depth + 1), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(renamed(kind.elementType, rename, depth + 1), kind.containsNull)
    return kind


def convert_names(frame: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    """All column and field names changed, without touching a value: casts between structs go by position."""
    return frame.select(*[F.col(f"`{f.name}`").cast(renamed(f.dataType, rename)).alias(rename(f.name)) for f in frame.schema.fields])


def redacted(arguments: Column, names: list[str]) -> Column:
    """A map with the values of some keys hidden."""
    return F.transform_values(arguments, lambda k, v: F.when(k.isin(names), F.lit("[redacted]")).otherwise(v))


# Forms of verse and their labels, in two vocabularies.
FORM_LABELS = {
    "wujue": "五言絕句", "qijue": "七言絕句", "wulu": "五言律詩", "qilu": "七言律詩", "wupai": "五言排律",
    "qipai": "七言排律", "gushi": "古詩", "ci": "詞", "unknown": "未詳",
}
FORM_LABELS_VI = {
    "wujue": "ngũ ngôn tứ tuyệt", "qijue": "thất ngôn tứ tuyệt", "wulu": "ngũ ngôn bát cú", "qilu": "thất ngôn bát cú",
    "wupai": "ngũ ngôn bài luật", "qipai": "thất ngôn bài luật", "gushi": "cổ thi", "ci": "từ", "unknown": "chưa rõ",
}


def form_label(form: Column, labels: Mapping[str, str] = FORM_LABELS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, form), form)


def render(trace: Mapping[str, Any] | None, templates: Mapping[str, str], fallback: str | None = None) -> str | None:
    """The text of a message code with parameters and nested parts; the fallback where a template is missing."""
    if not trace:
        return fallback
    template = templates.get(trace.get("code", ""))
    if template is None:
        return fallback
    values = {k: str(v) for k, v in (trace.get("params") or {}).items()}
    if trace.get("parts"):
        values["parts"] = "; ".join(x for x in (render(p, templates) for p in trace["parts"][:12]) if x)
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


def rendered(messages: Column, templates: Mapping[str, str], fallback: str | None = None) -> Column:
    """Texts of a column of trace messages in JSON."""
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda m: render(json.loads(m) if m else None, templates, fallback))

    return F.pandas_udf(of, "string")(messages)


# What a judge may say.
VERDICTS = ("sufficient", "insufficient", "conflicting")


def first_object(text: str) -> Any:
    """The first balanced {...} of a text that is JSON, or None."""
    at = text.find("{")
    while at >= 0:
        try:
            return json.JSONDecoder().raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def verdict(text: str | None) -> dict | None:
    """The judge's verdict inside its prose, or None unless its fields are what a verdict needs."""
    found = first_object(text or "")
    if not isinstance(found, dict) or found.get("verdict") not in VERDICTS:
        return None
    confidence, notes, gaps = found.get("confidence"), found.get("notes", ""), found.get("gaps", [])
    if isinstance(confidence, bool) or not isinstance(confidence, int | float) or not 0 <= confidence <= 1:
        return None
    if not isinstance(notes, str) or len(notes) > 600 or not isinstance(gaps, list) or len(gaps) > 6 or not all(isinstance(g, str) for g in gaps):
        return None
    return {"verdict": found["verdict"], "confidence": float(confidence), "gaps": gaps, "notes": notes}


def verdicts(texts: Column) -> Column:
    """struct(verdict, confidence, gaps, notes) of a judge's prose; nulls where it has no verdict."""
    names = ["verdict", "confidence", "gaps", "notes"]

    def of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verdict(t) or dict.fromkeys(names) for t in values], columns=names)

    return F.pandas_udf(of, "verdict string, confidence double, gaps array<string>, notes string")(texts)
