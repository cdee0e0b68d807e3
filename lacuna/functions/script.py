"""Script conversion by phrases: at each place the longest entry of a table, then on behind it.

Characters that convert one to one need no more than `translate`; a table with phrases, where a character depends on its
neighbours, needs a search. The table is a trie laid out as one sorted array of (state, character), which a task gets once; a
batch of texts is one array of code points, all places of which go down the trie together, so Python works once for each
letter of the longest entry, and once for each entry of two letters or more that is met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: A table goes to every task: about 60 bytes an entry in arrays.
MOST_ENTRIES = 1_000_000
#: Code points that are converted at once; a longer text is converted by itself.
BLOCK = 1 << 20
_NONE = 0x110000  # no code point: stands between texts
PLACED = "text string, places array<int>"


class Script:
    """A conversion table, entry by entry to what replaces it, of any lengths; an entry without a replacement is deleted.

    Nulls stay null, empty texts empty. What no entry begins at stays as it is."""

    def __init__(self, table: Mapping[str, str]) -> None:
        if len(table) > MOST_ENTRIES:
            raise ValueError(f"{len(table)} entries: a table goes to every task and may have {MOST_ENTRIES}")
        if "" in table:
            raise ValueError("an entry must have a character")
        entries = sorted(table.items())
        self.fingerprint = hashlib.sha256("\0".join(x for pair in entries for x in pair).encode()).hexdigest()
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for n, (entry, _) in enumerate(entries):
            state = 0
            for character in entry:
                state = edges.setdefault((state, ord(character)), len(edges) + 1)
            ends[state] = n
        self.longest = max((len(entry) for entry, _ in entries), default=0)
        keys = np.array([(state << 21) | code for state, code in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.entry = np.array([ends.get(s, -1) for s in range(len(edges) + 1)], dtype=np.int64)
        self.sizes = np.array([len(new) for _, new in entries], dtype=np.int64)
        self.new = _codes("".join(new for _, new in entries))
        self.at = np.cumsum(self.sizes) - self.sizes

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Script) and other.fingerprint == self.fingerprint

    def __hash__(self) -> int:
        return hash(self.fingerprint)

    def __repr__(self) -> str:
        return f"Script({self.fingerprint[:16]})"

    @classmethod
    def load(cls, *paths: str) -> Script:
        """From text files, an entry a line: what is replaced, a tab, and replacements parted by blanks, the first of which counts. The first file that has an entry decides."""
        table: dict[str, str] = {}
        for path in paths:
            with open(path, encoding="utf-8") as file:
                for line in file:
                    entry, tab, new = line.rstrip("\r\n").partition("\t")
                    if entry and tab and not entry.startswith("#"):
                        table.setdefault(entry, (new.split() or [""])[0])
        return cls(table)

    def _longest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the longest entry that begins there (or -1) and its length."""
        found, length = np.full(len(codes), -1, dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        for depth in range(self.longest):
            inside = at + depth < len(codes)
            at, state = at[inside], state[inside]
            wanted = (state << 21) | codes[at + depth]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            met = self.keys[place] == wanted
            at, state = at[met], self.targets[place[met]]
            ends = self.entry[state] >= 0
            found[at[ends]], length[at[ends]] = self.entry[state[ends]], depth + 1
        return found, length

    def _convert(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        parts = [_codes(t) for t in texts]
        codes = np.concatenate([x for part in parts for x in (part, [_NONE])])
        found, length = self._longest(codes)
        inside, end = np.zeros(len(codes), dtype=bool), 0
        # entries of one letter are in nobody's way, so only longer ones are looked at in turn
        for i in np.flatnonzero(length > 1):
            if i >= end:
                end = i + length[i]
                inside[i + 1 : end] = True
        found[inside] = -1
        sizes = np.where(found >= 0, self.sizes[found] if len(self.sizes) else 0, np.where(inside, 0, 1))
        source = np.repeat(np.arange(len(codes)), sizes)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        made, entry = codes[source], found[source]
        new = entry >= 0
        made[new] = self.new[self.at[entry[new]] + nth[new]]
        places = source + np.where(new, np.minimum(nth, length[source] - 1), 0)
        last = np.cumsum(sizes)
        begin, first = 0, 0
        for part in parts:
            stop = int(last[begin + len(part) - 1]) if len(part) else first
            yield _text(made[first:stop]), places[first:stop] - begin
            begin, first = begin + len(part) + 1, stop + 1

    def convert(self, texts: Iterable[str | None]) -> Iterator[tuple[str, np.ndarray] | None]:
        """For each text, the converted one and the place that each of its characters comes from, counted in code points.

        Characters that replace an entry come from its characters in turn, those too many from its last."""
        held, size = [], 0

        def done() -> Iterator[tuple[str, np.ndarray] | None]:
            made = self._convert([t for t in held if t is not None])
            return [next(made) if t is not None else None for t in held] if any(t is not None for t in held) else [None] * len(held)

        for text in texts:
            if held and size + len(text or "") > BLOCK:
                yield from done()
                held, size = [], 0
            held.append(text)
            size += len(text or "") + 1
        yield from done()

    def converted(self, text: Column) -> Column:
        def of(values: pd.Series) -> pd.Series:
            return pd.Series([x and x[0] for x in self.convert(values)], dtype=object)

        return F.pandas_udf(of, "string")(text)

    def all_converted(self, texts: Column) -> Column:
        """The texts of an array, each by itself."""
        def of(values: pd.Series) -> pd.Series:
            made = self.convert(t for row in values if row is not None for t in row)
            return pd.Series([None if row is None else [x and x[0] for _, x in zip(row, made)] for row in values], dtype=object)

        return F.pandas_udf(of, "array<string>")(texts)

    def placed(self, text: Column) -> Column:
        """struct(text, places): the converted text and where in the given one each character comes from."""
        def of(values: pd.Series) -> pd.DataFrame:
            made = list(self.convert(values))
            return pd.DataFrame({"text": [x and x[0] for x in made], "places": [x and x[1].astype(np.int32) for x in made]}, dtype=object)

        return F.pandas_udf(of, PLACED)(text)

    def _placed(self, batches: Iterable[pa.RecordBatch], kept: list[str], column: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, start = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK, side="right")))
                part = batch.slice(start, stop - start)
                made = list(self.convert(part[column].to_pylist()))
                new, places = pa.array([x and x[0] for x in made], pa.string()), pa.array([x and x[1].astype(np.int32) for x in made], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part[k] for k in kept], new, places], [*kept, "text", "places"])
                start = stop

    def place(self, frame: DataFrame, column: str = "text") -> DataFrame:
        """The other columns of a frame with (text, places) as placed() has them, a block of texts at a time: a task holds the places of
        one block, while a function of a column returns those of all texts that Arrow hands over at once."""
        kept = [f for f in frame.schema.fields if f.name != column]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return self._placed(batches, [f.name for f in kept], column)

        return frame.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
