"""Dense search: cosine top-k of query vectors over a collection, exactly or by product codes, and the guard that both come from one model."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

QUERY_BLOCK, SLICE = 10_000, 64


class CorpusNotIngested(RuntimeError):
    """The collection has no meta row."""


class ModelMismatch(RuntimeError):
    """Queries and collection were embedded under different settings."""


def assert_model(meta: Mapping[str, Any] | None, live: Mapping[str, Any]) -> None:
    """Raise unless the collection's meta row has the model, size, normalisation and conversion of the live model."""
    if meta is None:
        raise CorpusNotIngested("the vector collection has no meta row")
    wrong = [k for k in ("model_id", "dim", "normalized", "conversion") if meta.get(k) != live.get(k)]
    if wrong:
        raise ModelMismatch("; ".join(f"{k}: collection {meta.get(k)}, model {live.get(k)}" for k in wrong))


def _queries(queries: DataFrame) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """Unit query vectors in blocks of about QUERY_BLOCK: their ids by number, and the matrix. Queries without a vector stay out."""
    asked = queries.where(F.col("vector").isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).toArrow()
        for size in sorted(set(pc.list_value_length(rows["vector"]).to_pylist())):
            some = rows.filter(pc.equal(pc.list_value_length(rows["vector"]), size))
            ids = pa.table({"n": pa.array(np.arange(len(some), dtype=np.int32)), "query_id": some["query_id"]})
            yield queries.sparkSession.createDataFrame(ids), scaled(_matrix(some["vector"].combine_chunks(), size)[1])


def _matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have `size` numbers, and these as a matrix."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), size)


def scaled(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _best(score: Callable[[int, int], np.ndarray], queries: int, ids: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The `most` highest scores of each query above -inf, ties by id. score: those of a slice of queries, one row each, in the order of ids."""
    for lo in range(0, queries, SLICE):
        each = score(lo, min(lo + SLICE, queries))
        order = np.argsort(-each, axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(each, order, axis=1)
        number, kept = np.repeat(np.arange(lo, lo + len(each), dtype=np.int32), order.shape[1]), np.isfinite(value).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(number[kept]), ids.take(pa.array(order.ravel()[kept])), pa.array(value.ravel()[kept])], ["n", "point_id", "score"])


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("n").orderBy(F.desc("score"), "point_id")
    return found.withColumn("position", F.row_number().over(best) - 1).where(F.col("position") < limit)


def search(queries: DataFrame, points: DataFrame, limit: int = 50) -> DataFrame:
    """queries (query_id, vector), points (point_id, vector) to (query_id, point_id, score, position).

    A block of queries is broadcast; a task multiplies it with its points batch by batch and sends the best of each batch
    on. Points without a vector of a query's length have no score."""
    kind, out = points.schema["point_id"].dataType.simpleString(), None
    for ids, matrix in _queries(queries):
        held = points.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            asked = held.value
            for table in _gathered(batches):
                table = table.sort_by("point_id")
                at, x = _matrix(table["vector"].combine_chunks(), asked.shape[1])
                x = scaled(x)
                yield from _best(lambda lo, hi, x=x: np.round(asked[lo:hi] @ x.T, 9), len(asked), table["point_id"].combine_chunks().take(pa.array(at)), limit)

        found = points.select("point_id", "vector").mapInArrow(run, f"n int, point_id {kind}, score double")
        top = _ranked(found, limit).join(F.broadcast(ids), "n").select("query_id", "point_id", "score", "position")
        out = top if out is None else out.unionByName(top)
    return out if out is not None else queries.select("query_id").join(points.select("point_id")).where(F.lit(False)).withColumns({"score": F.lit(0.0), "position": F.lit(0)})


def _lloyd(x: np.ndarray, k: int, rounds: int, unit: bool = False) -> np.ndarray:
    """k centres of the rows of x, by Lloyd's method from rows spread over x; fewer where there are fewer rows."""
    at = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, at)
        sums, counts = np.zeros_like(at), np.bincount(near, minlength=len(at))
        np.add.at(sums, near, x)
        at[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        if unit:
            at = scaled(at)
    return at


def _nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (x @ at.T - (at * at).sum(axis=1) / 2).argmax(axis=1)


@dataclass(frozen=True)
class Quantiser:
    """Centres of lists, and for each part of a residual 256 words at most: what codes are made of."""

    centres: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def trained(cls, points: DataFrame, lists: int = 32, parts: int = 16, sample_rows: int = 20_000, rounds: int = 8) -> Quantiser:
        """From at most sample_rows points, those of the lowest hash of their id."""
        sample = points.where(F.col("vector").isNotNull()).select("point_id", "vector").orderBy(F.xxhash64("point_id"), "point_id").limit(sample_rows).toArrow()
        column = sample["vector"].combine_chunks()
        x = scaled(_matrix(column, len(column[0]) if len(column) else 0)[1])
        if not x.size:
            return cls(np.zeros((0, 0)), [])
        centres = _lloyd(x, lists, rounds, unit=True)
        rest = x - centres[_nearest(x, centres)]
        return cls(centres, [_lloyd(np.ascontiguousarray(part), 256, rounds) for part in np.array_split(rest, min(parts, rest.shape[1]), axis=1)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each unit vector."""
        of = _nearest(x, self.centres)
        parts = np.array_split(x - self.centres[of], len(self.words), axis=1)
        return of, np.stack([_nearest(p, w) for p, w in zip(parts, self.words, strict=True)], axis=1).astype(np.uint8)

    def tables(self, asked: np.ndarray) -> list[np.ndarray]:
        """Products of each query's parts with the words of the part."""
        return [p @ w.T for p, w in zip(np.array_split(asked, len(self.words), axis=1), self.words, strict=True)]


@dataclass(frozen=True)
class Coded:
    """Points (point_id, vector, list, code, ...) as residual product codes beside their vectors, and what made the codes."""

    points: DataFrame
    quantiser: Quantiser
    probes: int = 32
    survivors: int = 20
    share: float = 0.13

    @classmethod
    def of(cls, points: DataFrame, quantiser: Quantiser, **settings: int) -> Coded:
        """Points that have a vector of the quantiser's length, with their codes."""
        held, schema = points.sparkSession.sparkContext.broadcast(quantiser), StructType([*points.schema.fields, StructField("list", IntegerType()), StructField("code", BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = held.value
            for batch in batches:
                at, x = _matrix(batch["vector"], q.centres.shape[1])
                if len(at):
                    of, code = q.encode(scaled(x))
                    out = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], schema.names)

        return cls(points.mapInArrow(run, schema) if quantiser.words else points.where(F.lit(False)).withColumns({"list": F.lit(0), "code": F.lit(b"")}), quantiser, **settings)

    def write(self, folder: str) -> None:
        """Points by list, and the quantiser as one row."""
        self.points.write.partitionBy("list").parquet(f"{folder}/points")
        row = [(pickle.dumps((self.quantiser.centres.tolist(), [w.tolist() for w in self.quantiser.words])),)]
        self.points.sparkSession.createDataFrame(row, "made binary").coalesce(1).write.parquet(f"{folder}/quantiser")

    @classmethod
    def read(cls, spark: SparkSession, folder: str, **settings: int) -> Coded:
        centres, words = pickle.loads(bytes(spark.read.parquet(f"{folder}/quantiser").first()["made"]))  # noqa: S301 - written by write()
        return cls(spark.read.parquet(f"{folder}/points"), Quantiser(np.array(centres), [np.array(w) for w in words]), **settings)

    def search(self, queries: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        """search() by codes, and (query_id, bytes_read, bytes_all) of vectors and codes.

        The codes of the `probes` lists nearest to a query are scored by its tables; the vectors of the best survivors * limit, but
        no more than `share` of all where that leaves limit, are scored exactly. One scan of codes serves all queries, of the lists that any of them probes."""
        q, spark, out, read = self.quantiser, self.points.sparkSession, None, None
        kind = self.points.schema["point_id"].dataType.simpleString()
        sizes = np.zeros(max(1, len(q.centres)), dtype=np.int64)
        for r in self.points.groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]
        for ids, asked in _queries(queries):
            if not len(q.centres) or asked.shape[1] != q.centres.shape[1]:
                continue
            near = np.argsort(-(asked @ q.centres.T), axis=1, kind="stable")[:, : self.probes]
            probed = np.zeros((len(asked), len(q.centres)), dtype=bool)
            np.put_along_axis(probed, near, True, axis=1)
            most = max(limit, min(self.survivors * limit, int(self.share * sizes.sum())))
            held = spark.sparkContext.broadcast((asked, probed, q))

            def run(batches: Iterator[pa.RecordBatch], held=held, most=most) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                asked, probed, q = held.value
                tables, start = q.tables(asked), asked @ q.centres.T
                for table in _gathered(batches):
                    table = table.sort_by("point_id")
                    of = table["list"].to_numpy()
                    code = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.uint8).reshape(len(of), -1)

                    def score(lo: int, hi: int, of=of, code=code) -> np.ndarray:  # noqa: ANN001
                        total = start[lo:hi][:, of]
                        for k, products in enumerate(tables):
                            total += products[lo:hi][:, code[:, k]]
                        return np.where(probed[lo:hi][:, of], total, -np.inf)

                    yield from _best(score, len(asked), table["point_id"].combine_chunks(), most)

            lists = np.flatnonzero(probed.any(axis=0)).tolist()
            close = self.points.where(F.col("list").isin(lists)).select("point_id", "list", "code").mapInArrow(run, f"n int, point_id {kind}, score double")
            survivors = _ranked(close, most).select("n", "point_id")
            exact = survivors.join(self.points.where(F.col("list").isin(lists)).select("point_id", "vector"), "point_id")

            def rescore(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                asked = held.value[0]
                for batch in batches:
                    _, x = _matrix(batch["vector"], asked.shape[1])
                    yield pa.RecordBatch.from_arrays([batch["n"], batch["point_id"], pa.array(np.round((asked[batch["n"].to_numpy()] * scaled(x)).sum(axis=1), 9))], ["n", "point_id", "score"])

            top = _ranked(exact.select("n", "point_id", "vector").mapInArrow(rescore, f"n int, point_id {kind}, score double"), limit).join(F.broadcast(ids), "n").select("query_id", "point_id", "score", "position")
            codes = (probed @ sizes).tolist()
            width = asked.shape[1] * 4
            spent = spark.createDataFrame([(n, c * len(q.words) + min(most, c) * width, int(sizes.sum()) * width) for n, c in enumerate(codes)], "n int, bytes_read bigint, bytes_all bigint").join(ids, "n").drop("n")
            out, read = (top, spent) if out is None else (out.unionByName(top), read.unionByName(spent))
        if out is None:
            return search(queries.limit(0), self.points), queries.limit(0).select("query_id", F.lit(0).alias("bytes_read"), F.lit(0).alias("bytes_all"))
        return out, read
