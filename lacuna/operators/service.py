"""Embedders and rerankers as plug-ins: models run in Arrow batches on the executors, loaded once for each worker.

A model is a factory that is shipped to the workers and called there; what it makes is kept by name until it is unloaded.
`HashEmbedder` and `OverlapReranker` need no weights and give the same results everywhere, for tests and dry runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    model_id: str
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    model_id: str

    def score(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of hashed character pairs, so texts that share characters lie close to each other."""

    dim: int = 64
    model_id: str = "hash-64"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for a, b in zip(text, text[1:] + " "):
                row[xxhash.xxh64_intdigest(a + b) % self.dim] += 1
        return out


@dataclass(frozen=True)
class OverlapReranker:
    """The share of the query's distinct characters that a document has."""

    model_id: str = "overlap"

    def score(self, pairs: Sequence[tuple[str, str]]) -> np.ndarray:
        return np.array([len(set(q) & set(d)) / len(set(q)) if q else 0.0 for q, d in pairs])


_LOADED: dict[str, Any] = {}


def loaded(factory: Callable[[], Any], name: str) -> Any:
    """The model of that name in this process, made where it isn't there yet."""
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def unload(name: str) -> bool:
    """Drop a model of this process to give its memory back; whether there was one."""
    return _LOADED.pop(name, None) is not None


def embedded(frame: DataFrame, column: str, factory: Callable[[], Embedder], name: str, batch: int = 64, normalize: bool = True) -> DataFrame:
    """frame with `vector`: null for a blank text, since a vector of nothing would match anything."""
    schema = T.StructType([*frame.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    at = frame.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(factory, name)
        for one in batches:
            texts = one.column(at).to_pylist()
            good = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list[list[float] | None] = [None] * len(texts)
            for lo in range(0, len(good), batch):
                vectors = np.asarray(model.encode([texts[i] for i in good[lo : lo + batch]]), dtype=np.float64)
                if normalize:
                    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for i, v in zip(good[lo : lo + batch], vectors):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array(out, pa.list_(pa.float32()))], names=schema.names)

    return frame.mapInArrow(run, schema)


def scorer(factory: Callable[[], Reranker], name: str, batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A reranker as a scorer of hybrid search: pairs (query, content) get rerank_score."""

    def scored(query: pd.Series, content: pd.Series) -> pd.Series:
        model, out = loaded(factory, name), []
        pairs = list(zip(query.fillna(""), content.fillna("")))
        for lo in range(0, len(pairs), batch):
            out.extend(np.asarray(model.score(pairs[lo : lo + batch]), dtype=np.float64).tolist())
        return pd.Series(out, dtype="float64")

    return lambda pairs: pairs.withColumn("rerank_score", F.pandas_udf(scored, "double")("query", "content"))


def described(model: Embedder, normalize: bool = True, conversion: str = "traditional") -> dict[str, Any]:
    """The meta row of a collection that this model embeds."""
    return {"model_id": model.model_id, "dim": model.dim, "normalized": normalize, "conversion": conversion}


def timed(run: Callable[[], Any], clock: Callable[[], float] = time.monotonic) -> tuple[Any, dict[str, Any]]:
    """What a source returns, or None, and how it went: latency_ms, error_code, error_message, status where it failed."""
    began = clock()
    try:
        found = run()
    except Exception as error:  # noqa: BLE001 - a source may raise anything, and the others go on
        code = getattr(error, "code", None) or "internal"
        return None, {"latency_ms": (clock() - began) * 1000, "status": "timeout" if code == "tool_timeout" else "error", "error_code": code, "error_message": str(error).splitlines()[0] if str(error) else type(error).__name__}
    return found, {"latency_ms": (clock() - began) * 1000, "status": None, "error_code": None, "error_message": None}
