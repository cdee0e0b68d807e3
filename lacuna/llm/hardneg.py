"""Hard negatives by a full sort of each anchor's scores.

Components become integers, so scores are exact. Anchors go to the scan in passes of bounded size; a task reads rows in
blocks, scores a slice of anchors against a block and sorts each anchor's scores whole, highest first, ties by the
smaller id. In a first scan the sorted rows yield each anchor's positives, its first `positives` other rows of its label; in
a second one the place of each positive's score is found by binary search and the first `negatives` rows of other labels are
read from there while they reach the lower limit. A task keeps what is best so far for each anchor, or anchor and
positive, so a task sends on that many rows at most, whatever it reads; the best of all tasks are the best of all rows.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those whose integer vector has a
squared length of LONGEST or more, beyond which a score need not fit a long. Vectors of different lengths have no score;
empty ones score 0. A null id is no anchor; as a candidate it comes after all others that tie. Rows that share an id are
different rows: only the anchor's own row isn't its positive, and repeated rows give repeated results. Extra columns aren't
read. An anchor without positives, or a positive without negatives, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.storage import discard, keep
from lacuna.llm.tokens import tidy

SLICE = 64
LONGEST = 9.2e18
POSITIVES = "anchor bigint, score bigint, id bigint, row bigint"
NEGATIVES = "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint, row bigint"


@dataclass(frozen=True)
class Settings:
    """lower: a negative scores at least so many hundredths of its positive. anchors: of a pass, at most. block: rows that are sorted together."""

    positives: int = 5
    negatives: int = 5
    lower: int = 80
    scale: int = 256
    anchors: int = 20_000
    block: int = 16_384


@dataclass
class Rows:
    """Rows of one vector length: ids (null ones marked), labels, integer vectors."""

    row: np.ndarray
    id: np.ndarray
    null: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> list[Rows]:
        """The rows of a table for each vector length, by id, nulls last, and row."""
        ids = table["id"].combine_chunks()
        null, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
        row, label = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("row", "label"))
        lists = table["vector"].combine_chunks()
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes, order = np.diff(ends), np.lexsort((row, ids, null))
        out = []
        for size in np.unique(sizes):
            at = order[sizes[order] == size]
            out.append(cls(row[at], ids[at], null[at], label[at], flat[ends[at][:, None] + np.arange(size)]))
        return out

    def __len__(self) -> int:
        return len(self.row)

    def slice(self, lo: int, hi: int) -> Rows:
        return Rows(*(getattr(self, c)[lo:hi] for c in ("row", "id", "null", "label", "vector")))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[Rows]]:
    """Rows of a task in blocks of that size or somewhat more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield Rows.of(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield Rows.of(pa.Table.from_batches(held))


def scores(anchors: Rows, rows: Rows) -> np.ndarray:
    """Integer inner products. Where sums stay below 2**53 floats hold them exactly; beyond, int64 sums wrap and their ends fit."""
    most = [int(np.abs(x.vector).max(initial=0)) for x in (anchors, rows)]
    if most[0] * most[1] * max(1, anchors.vector.shape[1]) < 1 << 53:
        return (anchors.vector.astype(np.float64) @ rows.vector.T.astype(np.float64)).astype(np.int64)
    return anchors.vector @ rows.vector.T


class Best:
    """The best k rows so far of each of n lists."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, np.zeros(n, dtype=np.int64)
        self.score, self.id, self.row = (np.zeros((n, k), dtype=np.int64) for _ in range(3))
        self.null = np.zeros((n, k), dtype=bool)

    def add(self, at: int, score: np.ndarray, rows: Rows, picked: np.ndarray) -> None:
        """Rows `picked`, k at most and in order, into list `at`."""
        if not len(picked):
            return
        have = self.n[at]
        s, i, z, r = (np.concatenate([old[at, :have], new]) for old, new in ((self.score, score), (self.id, rows.id[picked]), (self.null, rows.null[picked]), (self.row, rows.row[picked])))
        order = np.lexsort((r, i, z, -s))[: self.k]
        now = len(order)
        self.n[at], self.score[at, :now], self.id[at, :now], self.null[at, :now], self.row[at, :now] = now, s[order], i[order], z[order], r[order]

    def columns(self) -> tuple[np.ndarray, list[pa.Array]]:
        """The list of each row, and score, id and row."""
        inside = np.arange(self.k) < self.n[:, None]
        return np.repeat(np.arange(len(self.n)), self.n), [pa.array(self.score[inside]), pa.array(self.id[inside], mask=self.null[inside]), pa.array(self.row[inside])]


def best_of(*keys: str) -> Column:
    """The rank of a row among those of its keys: highest score first, ties by id, nulls last."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))


def _sorted(anchors: list[Rows], block: list[Rows]) -> Iterator[tuple[int, Rows, Rows, int, np.ndarray, np.ndarray]]:
    """For each anchor: its group and number, the rows, and their order and scores, highest first."""
    for g, group in enumerate(anchors):
        for rows in block:
            if rows.vector.shape[1] != group.vector.shape[1]:
                continue
            for lo in range(0, len(group), SLICE):
                each = scores(part := group.slice(lo, lo + SLICE), rows)
                order = np.argsort(-each, axis=1, kind="stable")  # rows are in order of their ids
                for a in range(len(part)):
                    yield g, group, rows, lo + a, order[a], each[a][order[a]]


def prepared(vectors: DataFrame, settings: Settings, key: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, vector) of the rows that take part, written evenly over the cluster; row numbers them."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.aggregate(doubles, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * settings.scale) + 1, F.lit(2.0)))
    kept = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite).where(size < LONGEST)
    whole = F.transform(doubles, lambda x: F.floor(x * settings.scale).cast("bigint"))
    dealt = kept.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("vector"))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(dealt.repartition(spread).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def mine(vectors: DataFrame, anchor: Column, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchor: a condition on `id`, which rows are anchors."""
    rows = prepared(vectors, settings, key, vector, label)
    chosen = rows.where(anchor)
    passes = max(1, -(-chosen.count() // settings.anchors))
    out = [_pass(rows, chosen.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p) if passes > 1 else chosen, settings) for p in range(passes)]
    discard(rows)
    return reduce(DataFrame.unionByName, out)


def _pass(rows: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(Rows.of(chosen.select("row", "id", "label", "vector").toArrow()))

    @tidy
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = held.value
        best = [Best(len(x), settings.positives) for x in anchors]
        for block in blocks(batches, settings.block):
            for g, group, some, a, order, score in _sorted(anchors, block):
                own = np.flatnonzero((some.label[order] == group.label[a]) & (some.row[order] != group.row[a]))[: settings.positives]
                best[g].add(a, score[own], some, order[own])
        for group, found in zip(anchors, best, strict=True):
            of, columns = found.columns()
            yield pa.RecordBatch.from_arrays([pa.array(group.row[of]), *columns], ["anchor", "score", "id", "row"])

    first = rows.select("row", "id", "label", "vector").mapInArrow(nearest, POSITIVES)
    near = first.withColumn("place", best_of("anchor")).where(F.col("place") <= settings.positives).orderBy("anchor", "place").toArrow().to_pylist()
    limits: dict[int, list[dict[str, Any]]] = {}
    for x in near:  # `positives` for each anchor of the pass, at most
        limits.setdefault(x["anchor"], []).append(x)
    upper = spark.sparkContext.broadcast(limits)

    @tidy
    def hardest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, k = held.value, settings.positives
        of = [[upper.value.get(int(r), []) for r in group.row] for group in anchors]
        best = [Best(len(x) * k, settings.negatives) for x in anchors]
        for block in blocks(batches, settings.block):
            for g, group, some, a, order, score in _sorted(anchors, block):
                other = np.flatnonzero(some.label[order] != group.label[a])
                falling = -score[other]
                for j, positive in enumerate(of[g][a]):
                    lowest = -(-settings.lower * positive["score"] // 100)
                    at = np.searchsorted(falling, -positive["score"], "left")
                    end = min(at + settings.negatives, np.searchsorted(falling, -lowest, "right"))
                    best[g].add(a * k + j, -falling[at:end], some, order[other[at:end]])
        for group, found, mine in zip(anchors, best, of, strict=True):
            which, columns = found.columns()
            a, j = which // k, which % k
            known = [mine[x][y] for x, y in zip(a, j, strict=True)]
            about = [pa.array(group.row[a]), pa.array(j.astype(np.int32)), pa.array(group.id[a]), pa.array([x["id"] for x in known], pa.int64()), pa.array([x["score"] for x in known], pa.int64())]
            yield pa.RecordBatch.from_arrays([*about, *columns], ["anchor", "place", "anchor_id", "positive_id", "positive_score", "score", "id", "row"])

    each = rows.select("row", "id", "label", "vector").mapInArrow(hardest, NEGATIVES)
    ranked = each.withColumn("rank", best_of("anchor", "place")).where(F.col("rank") <= settings.negatives)
    found = keep(ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    held.destroy()
    upper.destroy()
    return found
