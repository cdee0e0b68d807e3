"""Line dedup by overlapping pairs of lines, or by content-defined chunks of lines.

By pairs, which the query uses, every two adjacent lines of which one holds a word are a unit. Each line of a repeated
run of two lines or more lies in a repeated pair, so the run goes whole, wherever it begins and ends; every line that
goes still stands in an earlier place. Where a pair overlaps its own first place (three equal lines) only the line
behind that place goes. Lines without a word go with the lines to both sides of them. n_removed_chunks counts
stretches of removed lines.

By chunks, the default of dedup(), a rolling hash covers a line and the one before. A chunk ends where the rolling hash
is a local minimum, so boundaries depend on a few lines around them, come back wherever the same lines do, and keep
chunks at two lines or more inside a text. Chunks with two lines that hold a word count; what of a repeated passage
lies in a chunk together with other lines stays.

Either way, units that stand in several places are candidates; their bytes are fetched and compared, and where they are
the same, all but the first place (lowest doc_id, then text by its hash, then lowest place) are cut out.

Tables of units hold hashes and places alone; texts are read again for the documents that have a candidate and for
those that lose one. The list of such documents is broadcast where it holds at most BROADCAST_ROWS units, else
documents are shuffled to it. A unit that stands in very many places is joined by broadcast, so that its places never
meet in one task.

Cases: a null text stays null and an empty one empty; a document without id is passed through and its units don't
count; rows with the same id and text count as one document, so copies of a whole row keep or lose the same lines; rows
with the same id and different texts are documents of their own; units of which two texts have the same hash are left alone. Columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import tokens
from lacuna.llm.skew import hot_join
from lacuna.llm.storage import discard, keep, small_batches

BROADCAST_ROWS = 500_000
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_BLANK = "\x20\t\n\r\x0b\x0c"


def line_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and whether there is a word, for each line of the rows that bounds delimit."""
    n = len(data)
    breaks = np.flatnonzero(data == 0x0A)
    row = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1])
    start = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.empty(len(start), dtype=np.int64)
    end[:-1] = start[1:] - 1
    end[last] = bounds[row[last] + 1]
    up, down = tokens.powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(tokens._ROWS[data] * up[:n], out=total[1:])
        solid = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(~tokens.SPACE[data], out=solid[1:])
        return row, tokens.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), solid[end] > solid[start]


def chunks(column: pa.Array, block: int = tokens.BLOCK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of rows, chunk by chunk: row, place in the row, first line, number of lines, hash, lines with a word."""
    data, offsets = tokens.utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, side="right")) - 1)
        first, last = int(offsets[lo]), int(offsets[hi])
        row, h, solid = line_hashes(data[first:last], offsets[lo : hi + 1] - first)
        n = len(row)
        head = np.append(True, row[1:] != row[:-1])
        tail = np.append(head[1:], True)
        with np.errstate(over="ignore"):
            before = np.where(head, _U(0), np.append(_U(0), h[:-1]))
            roll = tokens.mix(before * _STEP + h)
        lower = np.append(False, roll[1:] < roll[:-1]) & ~head
        under = np.append(roll[:-1] <= roll[1:], False) & ~tail
        ends = np.flatnonzero((lower & under) | tail)
        starts = np.append(0, ends[:-1] + 1)
        up, down = tokens.powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.append(_U(0), np.cumsum(h * up[:n]))
            value = tokens.mix((total[ends + 1] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        words = np.append(0, np.cumsum(solid))
        own = row[starts]
        opening = np.searchsorted(row, own)
        place = np.arange(len(starts)) - np.searchsorted(own, own)
        yield own + lo, place, starts - opening, ends - starts + 1, value, words[ends + 1] - words[starts]
        lo = hi


def pairs(column: pa.Array, block: int = tokens.BLOCK_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for every two adjacent lines of a row."""
    data, offsets = tokens.utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, side="right")) - 1)
        first, last = int(offsets[lo]), int(offsets[hi])
        row, h, solid = line_hashes(data[first:last], offsets[lo : hi + 1] - first)
        at = np.flatnonzero(row[1:] == row[:-1])
        with np.errstate(over="ignore"):
            value = tokens.mix(tokens.mix(h[at] * _STEP) + h[at + 1])
        place = at - np.searchsorted(row, row[at])
        yield row[at] + lo, place, place, np.full(len(at), 2), value, solid[at].astype(np.int64) + solid[at + 1]
        lo = hi


def _listed(batches: Iterator[pa.RecordBatch], units: Callable, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, place, _, lines, value, solid in units(batch.column(2)):
            good = (lines > 1) & (solid >= words)
            rows = pa.array(row[good])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[good].astype(np.int32)), pa.array(value[good].view(np.int64))], names=["doc_id", "of_text", "place", "hash"])


def _texts(batches: Iterator[pa.RecordBatch], units: Callable) -> Iterator[pa.RecordBatch]:
    """(text, places) to (hash, text of the unit)."""
    for batch in batches:
        wanted = batch.column(1).to_pylist()
        text = batch.column(0)
        for row, place, first, lines, value, _ in units(text):
            at, out, hashes = 0, [], []
            for r in np.unique(row):
                end = np.searchsorted(row, r, side="right")
                own = text[int(r)].as_py().split("\n")
                for p in wanted[r]:
                    if p >= end - at:  # of another text with the same id and hash
                        continue
                    k = at + p
                    out.append("\n".join(own[first[k] : first[k] + lines[k]]))
                    hashes.append(value[k])
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(out, pa.string())], names=["hash", "chunk"])


def _sized(frame: DataFrame, column: str) -> DataFrame:
    n = frame.agg(F.sum(F.size(column))).first()[0] or 0
    return F.broadcast(frame) if n <= BROADCAST_ROWS else frame


def _lost(places: list[int], first: np.ndarray, lines: np.ndarray, value: np.ndarray) -> set[int]:
    """The lines of a text that its units at those places cover."""
    gone, lost = set(places), set()
    for p in places:
        start, stop = int(first[p]), int(first[p] + lines[p])
        if p and p - 1 not in gone and value[p - 1] == value[p]:  # overlaps its first place, if units overlap
            start = max(start, int(first[p - 1] + lines[p - 1]))
        lost.update(range(start, stop))
    return lost


def _between(own: list[str], lost: set[int]) -> set[int]:
    """Lines without a word that have only such lines between them and lost lines to both sides."""
    out, at = set(), sorted(lost)
    for a, b in zip(at, at[1:]):
        if b > a + 1 and not any(x.strip(_BLANK) for x in own[a + 1 : b]):
            out.update(range(a + 1, b))
    return out


def dedup(documents: DataFrame, units: Callable = chunks, words: int = 2) -> DataFrame:
    """documents with repeated units cut out of text, and n_removed_chunks and n_removed_lines appended.

    units: chunks or pairs; words: how many lines with a word a unit needs.
    """
    small_batches(documents.sparkSession)
    documents = documents.drop("n_removed_chunks", "n_removed_lines")
    kind = documents.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("of_text", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("hash", T.LongType())]
    listed = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("of_text"), "text")
    found = keep(listed.mapInArrow(tokens.tidy(lambda batches: _listed(batches, units, words)), T.StructType(fields)).distinct(), "lines-units")
    counted = keep(found.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"), "lines-counted")
    repeated = keep(hot_join(found, counted, "hash", F.col("n"), found.count()), "lines-repeated")

    places = keep(repeated.groupBy(F.col("doc_id").alias("of_doc"), F.col("of_text").alias("of")).agg(F.sort_array(F.collect_list("place")).alias("places")), "lines-places")
    texts = listed.join(_sized(places, "places"), (F.col("doc_id") == F.col("of_doc")) & (F.col("of_text") == F.col("of"))).select("text", "places")
    texts = texts.mapInArrow(tokens.tidy(lambda batches: _texts(batches, units)), "hash bigint, chunk string")
    unlike = keep(texts.groupBy("hash", "chunk").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.sum("one").alias("kinds")).where("kinds > 1").select("hash"), "lines-unlike")

    own = repeated.where("doc_id = first_doc")
    first = own.groupBy("hash").agg(F.min(F.struct("of_text", "place")).alias("first"))
    again = own.join(first, "hash").where(F.struct("of_text", "place") != F.col("first")).drop("first")
    gone = repeated.where("doc_id != first_doc").unionByName(again)
    if n := unlike.count():
        gone = gone.join(F.broadcast(unlike) if n <= BROADCAST_ROWS else unlike, "hash", "left_anti")
    gone = gone.groupBy(F.col("doc_id").alias("__doc"), F.col("of_text").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("__places"))
    gone = keep(gone, "lines-gone")
    discard(found, counted, repeated, places, unlike)
    columns = documents.columns
    marked = documents.join(_sized(gone, "__places"), (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__of")), "left").select(*columns, "__places")
    added = [T.StructField("n_removed_chunks", T.LongType()), T.StructField("n_removed_lines", T.LongType())]
    schema = T.StructType([*documents.schema.fields, *added])
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, text = batch.column(len(columns)), batch.column(at)
            n_chunks, n_lines = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            touched = np.flatnonzero(~np.asarray(places.is_null()))
            if len(touched):
                out = text.take(pa.array(touched))
                new = dict(zip(touched.tolist(), out.to_pylist()))
                for row, _, first, lines, value, _ in units(out):
                    for r in np.unique(row):
                        lo, hi, of = np.searchsorted(row, r), np.searchsorted(row, r, side="right"), int(touched[r])
                        own, hashes = (out[int(r)].as_py() or "").split("\n"), value[lo:hi].view(np.int64)
                        gone = [x["place"] for x in places[of].as_py() if x["place"] < hi - lo and hashes[x["place"]] == x["hash"]]
                        lost = _lost(gone, first[lo:hi], lines[lo:hi], value[lo:hi])
                        if units is pairs:
                            lost |= _between(own, lost)
                        new[of] = "\n".join(x for i, x in enumerate(own) if i not in lost)
                        n_lines[of] = len(lost)
                        n_chunks[of] = sum(i - 1 not in lost for i in lost) if units is pairs else len(gone)
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[touched] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array([new[int(t)] for t in touched], text.type))
            arrays = [text if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_chunks), pa.array(n_lines)], names=schema.names)

    return marked.mapInArrow(tokens.tidy(cut), schema)
