"""Rarest-gram seeds: which grams of a line are indexed, and by which one a window is looked up.

A window of min_window letters holds `stride` grams. Of these the rarest is its seed, by a table of gram frequencies, then by hash, then
by place. A line is indexed at the seeds of all its windows, a query's window is looked up by its own: equal windows have
equal grams, so both sides choose the same one, and a single lookup finds every line that holds the window. Grams of lines that
everyone repeats are chosen only where nothing rarer is near. A posting holds the letters around its seed that a window can
cover, so that the rest of the window is compared in place and a posting is as small in a long line as in a short one.

Frequencies are kept as logarithms in SLOTS slots by hash, 256 KB whatever the corpus: grams that share a slot share its
class, which costs choice, not results. The table is fixed for an index, since both sides have to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lacuna.config import Profile
from lacuna.operators import corpus

SLOTS, PIECE = 1 << 18, 1 << 20
_U = np.uint64


def gram_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in a row: the hash of the gram at each place, the number of the text there, and where each text starts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    n = max(0, len(points) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * _U(0x100000001B3) + points[k : k + n]
        total = (total ^ (total >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return total ^ (total >> _U(29)), owner, starts


def pieces(texts: list[str], reach: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in groups of about PIECE letters: number, place from 0 and letters. Longer texts are cut, each part with the reach - 1 letters that follow."""
    rows, at, parts, size = [], [], [], 0
    for row, whole in enumerate(texts):
        for start in range(0, max(1, len(whole) - reach + 1), PIECE):
            rows.append(row)
            at.append(start)
            parts.append(whole[start : start + PIECE + reach - 1])
            size += len(parts[-1])
            if size >= PIECE:
                yield rows, at, parts
                rows, at, parts, size = [], [], [], 0
    if rows:
        yield rows, at, parts


def frequencies(lines: DataFrame, profile: Profile) -> bytes:
    """The logarithm of how often grams of each slot occur in lines (text_match): a byte for each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(SLOTS, dtype=np.int64), profile.seed
        for batch in batches:
            for _, _, texts in pieces(batch["text_match"].to_pylist(), size):
                hashes, owner, _ = gram_hashes(texts, size)
                inside = owner[: len(hashes)] == owner[size - 1 :]
                total += np.bincount((hashes[inside] & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    found = lines.select(F.coalesce("text_match", F.lit("")).alias("text_match")).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, dtype=np.uint8)
    table[found["slot"].to_numpy()] = np.log2(found["n"].to_numpy() + 1.0).astype(np.uint8)
    return table.tobytes()


def chosen(texts: list[str], profile: Profile, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place from 0, hash) of the seed of every window of min_window letters, each place once."""
    hashes, owner, starts = gram_hashes(texts, profile.seed)
    w, reach = corpus.stride(profile), profile.min_window
    n = len(owner) - reach + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    rank = (table[(hashes & _U(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << _U(56)) | (hashes >> _U(8))
    first = np.arange(n) + np.lib.stride_tricks.sliding_window_view(rank, w)[:n].argmin(axis=1)
    at = np.unique(first[owner[:n] == owner[reach - 1 :]])
    return owner[at], at - starts[owner[at]], hashes[at].view(np.int64)


def postings(lines: DataFrame, profile: Profile, frequency: bytes) -> DataFrame:
    """lines (..., text_match) without text_match, with (seed, place, first, around) for each seed of a line: place and first from 1,
    around the letters from `first` that a window with this seed can cover. Lines below min_window letters hold no window."""
    shared, before = lines.sparkSession.sparkContext.broadcast(frequency), corpus.stride(profile) - 1
    kept = [f for f in lines.schema.fields if f.name != "text_match"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for rows, at, texts in pieces(whole := batch["text_match"].to_pylist(), profile.min_window):
                of, place, seed = chosen(texts, profile, table)
                of, place = np.array(rows, dtype=np.int64)[of], place + np.array(at, dtype=np.int64)[of]
                first = np.maximum(place - before, 0)
                around = [whole[r][f : p + profile.max_window] for r, f, p in zip(of.tolist(), first.tolist(), place.tolist(), strict=True)]
                out = batch.select([f.name for f in kept]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(seed), pa.array((place + 1).astype(np.int32)), pa.array((first + 1).astype(np.int32)), pa.array(around, pa.string())], [*out.schema.names, "seed", "place", "first", "around"])

    schema = StructType([*kept, StructField("seed", LongType()), StructField("place", IntegerType()), StructField("first", IntegerType()), StructField("around", StringType())])
    return lines.where(F.length("text_match") >= profile.min_window).mapInArrow(run, schema)


def packed(lines: DataFrame, profile: Profile, frequency: bytes) -> DataFrame:
    """lines (poem_id, line_no, text_match) as rows of about PIECE letters: ids and numbers of lines, the steps between sorted 32-bit hashes of
    their seeds, and the line of each. A posting takes a few bytes, and is stored where its line is read."""
    shared = lines.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for rows, _, texts in pieces(batch["text_match"].to_pylist(), profile.min_window):
                of, _, seed = chosen(texts, profile, table)
                if not len(of):
                    continue
                low, n = rows[0], rows[-1] - rows[0] + 1
                keys = np.unique((short(seed).astype(np.uint64) << _U(32)) | (np.array(rows, dtype=np.uint64)[of] - _U(low)))
                hashes, at = (keys >> _U(32)).astype(np.uint32), (keys & _U(0xFFFFFFFF)).astype(np.int32)
                steps = np.diff(hashes, prepend=np.uint32(0)).view(np.int32)
                lists = [batch["poem_id"].slice(low, n), batch["line_no"].slice(low, n), pa.array(steps), pa.array(at)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["ids", "nos", "steps", "at"])

    return lines.select("poem_id", "line_no", "text_match").where(F.length("text_match") >= profile.min_window).mapInArrow(run, schema_of(lines.schema["poem_id"].dataType.simpleString()))


def schema_of(id_type: str) -> str:
    return f"ids array<{id_type}>, nos array<int>, steps array<int>, at array<int>"


def short(seed: np.ndarray) -> np.ndarray:
    """What is stored of a seed. Seeds that share it cost lines that are looked at in vain."""
    return (seed.view(np.uint64) >> _U(32)).astype(np.uint32)


def named(stored: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(poem_id, line_no): the lines of packed rows that hold one of the wanted seeds."""
    shared = stored.sparkSession.sparkContext.broadcast(np.unique(short(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for i in range(batch.num_rows if len(asked) else 0):
                hashes = np.cumsum(batch["steps"][i].values.to_numpy().view(np.uint32), dtype=np.uint32)
                met = asked[np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)] == hashes
                of = pa.array(np.unique(batch["at"][i].values.to_numpy()[met]))
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values.take(of), batch["nos"][i].values.take(of)], ["poem_id", "line_no"])

    return stored.select("ids", "nos", "steps", "at").mapInArrow(run, f"poem_id {stored.schema['ids'].dataType.elementType.simpleString()}, line_no int")


def lookups(places: DataFrame, profile: Profile, frequency: bytes) -> DataFrame:
    """places (..., longest) with the seed of the first min_window letters and its offset."""
    shared = places.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            _, offset, seed = chosen([x[: profile.min_window] for x in batch["longest"].to_pylist()], profile, table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seed), pa.array(offset.astype(np.int32))], [*batch.schema.names, "seed", "offset"])

    schema = StructType([*places.schema.fields, StructField("seed", LongType()), StructField("offset", IntegerType())])
    return places.mapInArrow(run, schema)
