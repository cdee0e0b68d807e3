"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo `dims`, of its words, word pairs and pairs with one word
left out; a feature is there or not, so copies of a line weigh once. FTRL-proximal keeps a learning rate per
coordinate and an L1 threshold that leaves most weights at exactly zero: the model that is broadcast holds the
rest alone, at most `dims` of them.

Labels come from a bounded sample: at most `max_rows` labelled rows, those of the lowest hash of their id, and of
these as many as hold `max_features` features together. Features are extracted where the texts are; one task gets them
in the order of that hash, fits, and scales margins to log-odds with a fifth that it holds out. Every text is then
scored whole.

Cases: rows of one id with different texts all teach its label; a null or empty text has no feature and gets the score of the bias; labels other than 0 and 1, null labels
and null ids teach nothing; a repeated label row teaches once; without any label all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import tokens
from lacuna.llm.storage import small_batches


@dataclass(frozen=True)
class Settings:
    dims: int = 1 << 20
    max_rows: int = 24_000
    max_features: int = 60_000_000
    epochs: int = 5
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    dims: int

    def dense(self) -> np.ndarray:
        w = np.zeros(self.dims, dtype=np.float32)
        w[self.index] = self.weight
        return w


def features(w: tokens.Words, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every n-gram and skip-gram of a block, with repeats."""
    parts = [(w.row, w.hash), tokens.grams(w, 2), tokens.grams(w, 2, skip=1)]
    return np.concatenate([r for r, _ in parts]), (np.concatenate([h for _, h in parts]) % np.uint64(dims)).astype(np.int64)


def distinct(row: np.ndarray, index: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * dims + index)
    return key // dims, key % dims


def ftrl(examples: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Fit on lists of feature indexes; the last coordinate is the bias, which L1 doesn't touch."""
    z, n = np.zeros(s.dims + 1), np.zeros(s.dims + 1)
    order = np.random.Generator(np.random.PCG64(7))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return -np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    def bias() -> float:
        return -z[-1] / ((s.beta + np.sqrt(n[-1])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for i in order.permutation(len(examples)):
            at = examples[i]
            w, b = weights(at), bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / s.alpha * b
            n[-1] += g * g
    w = weights(slice(0, s.dims))
    index = np.flatnonzero(w)
    return Model(index.astype(np.int32), w[index].astype(np.float32), float(bias()), s.dims)


def calibration(margins: np.ndarray, labels: np.ndarray, least: int = 5) -> tuple[float, float]:
    """Slope and shift that turn margins of texts a model hasn't seen into log-odds; 1 and 0 where a label is too rare.

    Targets are smoothed, so that margins that part the labels cleanly still give a finite slope."""
    ones = labels.sum()
    zeros = len(labels) - ones
    a, b = 1.0, 0.0
    if min(ones, zeros) < least:
        return a, b
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2), x @ (p - target))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if 0.1 < a < 10 and abs(b) < 20 else (1.0, 0.0)


def calibrated(examples: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """A model of all examples whose margins are scaled as those of a model of four fifths need on the other fifth."""
    apart = np.arange(len(examples)) % 5 == 0
    part = ftrl([e for e, out in zip(examples, apart) if not out], labels[~apart], s)
    dense = part.dense()
    a, b = calibration(np.array([dense[e].sum() + part.bias for e, out in zip(examples, apart) if out]), labels[apart])
    whole = ftrl(examples, labels, s)
    return Model(whole.index, (whole.weight * a).astype(np.float32), whole.bias * a + b, s.dims)


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """documents (doc_id, text), labels (doc_id, toxic): learn from at most s.max_rows rows that have both."""
    small_batches(documents.sparkSession)
    sample = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.max_rows)
    )
    keys = F.xxhash64("doc_id").alias("by_id"), F.xxhash64("text").alias("by_text")
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(*keys, "y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in tokens.words(batch.column(3)):
                row, index = distinct(*features(w, s.dims), s.dims)
                cut = np.searchsorted(row, np.arange(w.hi - w.lo + 1))
                own = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(index, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(w.lo, w.hi - w.lo) for c in batch.columns[:3]), own], names=["by_id", "by_text", "y", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, truth, held = [], [], 0
        for batch in batches:
            cut, index = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for r, y in enumerate(batch.column(2).to_numpy()):
                held += cut[r + 1] - cut[r]
                if held > s.max_features and examples:
                    break
                examples.append(index[cut[r] : cut[r + 1]].copy())
                truth.append(y)
        if not examples:
            return
        model = calibrated(examples, np.array(truth), s)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(model.index, -1), pa.int32()), "w": pa.array(np.append(model.weight, model.bias), pa.float32())})

    extracted = rows.mapInArrow(tokens.tidy(extract), "by_id bigint, by_text bigint, y double, features array<int>")
    rows = extracted.repartition(1).sortWithinPartitions("by_id", "by_text")  # the order of arrival doesn't matter
    got = rows.mapInArrow(tokens.tidy(train), "i int, w float").toPandas()
    weights = got[got["i"] >= 0]
    bias = got.loc[got["i"] < 0, "w"]
    return Model(weights["i"].to_numpy(np.int32), weights["w"].to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else -30.0, s.dims)


def score_column(texts: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    dims = len(dense)
    for w in tokens.words(texts):
        row, index = features(w, dims)
        live = dense[index] != 0
        row, index = distinct(row[live], index[live], dims)
        out[w.lo : w.hi] += np.bincount(row, weights=dense[index], minlength=w.hi - w.lo)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with `toxicity` (0 to 1) appended; other columns pass through, one named toxicity is replaced."""
    small_batches(documents.sparkSession)
    documents = documents.drop("toxicity")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField("toxicity", T.DoubleType())])
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_column(batch.column(at), dense, m.bias))], names=[*batch.schema.names, "toxicity"])

    return documents.mapInArrow(tokens.tidy(run), schema)
