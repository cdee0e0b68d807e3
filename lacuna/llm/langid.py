"""Language identification by interpolated Kneser-Ney character models, one per language.

A text becomes lower-case letters with one boundary symbol for each run of anything else. All training texts are
counted: executors count character 4-grams by language, the counts are summed, and the driver turns them into
interpolated Kneser-Ney probabilities. The model keeps, for each order, one sorted array of 64-bit n-gram hashes
and beside it the log-probabilities of every language, so that one search serves all languages. No count is dropped:
the model grows with the number of distinct 4-grams times the number of languages, and driver and workers hold it.

A text gets the language of the lowest cross-entropy per symbol. The score is a softmax over negative
cross-entropies at a temperature fitted on `calibration_rows` training texts. `accepted` is false where the
cross-entropy is above what nearly all training texts of that language stay below, or where the score is below
`min_score`: such texts are written in no language that was learned.

Cases: a null text, or one without a letter, gets `und`, score 0 and accepted false, and so does every text where
nothing was learned. Rows with a null language teach nothing. Ties go to the language that sorts first. Repeated
rows count as often as they stand there. Very long texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import tokens
from lacuna.llm.storage import small_batches

ORDER = 4
_U = np.uint64
_MASKS = [_U((1 << (16 * (k + 1))) - 1) for k in range(ORDER - 1)]
_SYMBOLS: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    calibration_rows: int = 4_000
    min_score: float = 0.5
    accepted_share: float = 0.999


def _symbols() -> np.ndarray:
    """The symbol of each code point: its lower-case letter, or 0. Letters beyond the basic plane share 8,448 symbols that no
    letter has; nothing is a letter beyond the end of the table."""
    if not _SYMBOLS:
        table = np.zeros(0x40000, dtype=np.uint16)
        for c in range(len(table)):
            if chr(c).isalpha():
                low = chr(c).lower()
                low = ord(low) if len(low) == 1 else c
                table[c] = low if low < 0x10000 else 0xD800 + (low - 0x10000) % 0x2100
        _SYMBOLS.append(table)
    return _SYMBOLS[0]


def keys(column: pa.Array, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of rows: the first row, for each symbol its row, and its 4-gram packed 16 bits a symbol."""
    data, offsets = tokens.utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, side="right")) - 1)
        at, last = int(offsets[lo]), int(offsets[hi])
        while at < last:
            stop = min(last, at + 2 * block)
            while stop < last and data[stop] & 0xC0 == 0x80:
                stop += 1
            raw = data[at:stop]
            lead = (raw & 0xC0) != 0x80
            points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
            row = np.searchsorted(offsets[lo + 1 : hi + 1], np.flatnonzero(lead)[: len(points)] + at, side="right")
            symbol = _symbols()[np.minimum(points, 0x3FFFF)]
            solid = symbol > 0
            keep = solid.copy()
            keep[1:] |= solid[:-1] & (row[1:] == row[:-1])
            symbol, row = symbol[keep].astype(np.uint64), row[keep]
            packed = symbol.copy()
            for k in range(1, ORDER):
                packed[k:] |= symbol[:-k] << _U(16 * k)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            for k, mask in enumerate(_MASKS):
                head = first + k
                head = head[head < len(row)]
                head = head[row[head] == row[head - k]] if k else head
                packed[head] &= mask
            yield lo, row, packed
            at = stop
        lo = hi


@dataclass
class Table:
    """Sorted hashes with a row of values each; buckets of leading bits give the place to look."""

    hash: np.ndarray
    value: np.ndarray
    bits: int = field(init=False)
    start: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.bits = max(4, int(len(self.hash)).bit_length() + 1)
        edges = np.searchsorted(self.hash >> _U(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.start, self.longest = edges.astype(np.int32), int(np.diff(edges).max(initial=0))

    @classmethod
    def of(cls, packed: np.ndarray, value: np.ndarray) -> Table:
        h = tokens.mix(packed + _U(1))
        order = np.argsort(h)
        return cls(h[order], value[order].astype(np.float32, copy=False))

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each n-gram and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(packed), dtype=np.int64), np.zeros(len(packed), dtype=bool)
        h = tokens.mix(packed + _U(1))
        at = self.start[(h >> _U(64 - self.bits)).astype(np.int64)].astype(np.int64)
        top = len(self.hash) - 1
        np.minimum(at, top, out=at)
        short = np.flatnonzero(self.hash[at] < h)
        for _ in range(self.longest):
            if not len(short):
                break
            at[short] = np.minimum(at[short] + 1, top)
            short = short[(self.hash[at[short]] < h[short]) & (at[short] < top)]
        return at, self.hash[at] == h


@dataclass
class Model:
    languages: list[str]
    grams: dict[int, Table]  # by order: log-probabilities
    contexts: dict[int, Table]  # by order of the n-gram above: log of the weight left to the order below
    floor: np.ndarray
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_probability(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row of log-probabilities, one for each language, for each n-gram."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.languages)))
        if order < ORDER:
            packed = packed & _MASKS[order - 1]
        at, there = self.grams[order].find(packed)
        out = self.grams[order].value[at]
        if not there.all():
            miss = np.flatnonzero(~there)
            below = np.array(self.log_probability(packed[miss], order - 1), dtype=np.float32)
            if order > 1:
                above, known = self.contexts[order].find(packed[miss] >> _U(16))
                below[known] += self.contexts[order].value[above[known]]
            out[miss] = below
        return out


def build(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], pruned: bool) -> Model:
    """counts: for each language its packed 4-grams and how often they stand there."""
    alphabet = len(np.unique(np.concatenate([k & _MASKS[0] for k, _ in counts]))) + 1
    floor = np.full(len(languages), -np.log(alphabet), dtype=np.float32)
    per: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for k, c in counts:
        levels = [(k, c.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):
            below, n = np.unique(levels[-1][0] & _MASKS[order - 1], return_counts=True)
            levels.append((below, n.astype(np.float64)))
        per.append(levels[::-1])
    model = Model(languages, {}, {}, floor)
    for order in range(1, ORDER + 1):
        every = np.unique(np.concatenate([levels[order - 1][0] for levels in per]))
        below = model.log_probability(every, order - 1)
        context, where = np.unique(every >> _U(16), return_inverse=True)
        value, weight = np.zeros((len(every), len(languages)), np.float32), np.zeros((len(context), len(languages)), np.float32)
        for i, levels in enumerate(per):
            k, c = levels[order - 1]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice and not (pruned and order == ORDER) else 0.75
            slot = np.searchsorted(every, k)
            full = np.zeros(len(every))
            full[slot] = c
            total = np.bincount(where, full, len(context))
            kinds = np.bincount(where, full > 0, len(context))
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            value[:, i] = np.log(np.maximum(full - discount, 0) / np.maximum(total[where], 1) + left[where] * np.exp(below[:, i].astype(np.float64)))
            weight[:, i] = np.log(left)
        model.grams[order] = Table.of(every, value)
        if order > 1:
            model.contexts[order] = Table.of(context, weight)
        else:
            model.floor = floor + weight[0]  # what is left to a symbol that no language has
    return model


def cross_entropies(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol of each row under each language, and the number of letters."""
    total, n = np.zeros((len(column), len(model.languages))), np.zeros(len(column), dtype=np.int64)
    letters = np.zeros(len(column), dtype=np.int64)
    for lo, row, packed in keys(column):
        if not len(row):
            continue
        first = np.flatnonzero(np.diff(row, prepend=-1))
        at = row[first] + lo
        total[at] -= np.add.reduceat(model.log_probability(packed), first, axis=0, dtype=np.float64)
        n[at] += np.diff(np.append(first, len(row)))
        letters[at] += np.add.reduceat((packed & _MASKS[0]) > 0, first, dtype=np.int64)
    return total / np.maximum(n, 1)[:, None], letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, packed, n), summed where memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
            for i in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k[i : i + 100_000]), pa.string()), "packed": pa.array(k[i : i + 100_000].view(np.int64)), "n": pa.array(c[i : i + 100_000])})
        held.clear()

    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        for lo, row, packed in keys(batch.column(1)):
            own = code[row + lo]
            for i in np.unique(own):
                k, n = np.unique(packed[own == i], return_counts=True)
                held.setdefault(names[i], []).append((k, n))
                size += len(k)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def fit(documents: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from (doc_id, text, lang); rows with a null text or language teach nothing."""
    small_batches(documents.sparkSession)
    rows = documents.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = rows.select("lang", "text").mapInArrow(tokens.tidy(_count), "lang string, packed bigint, n bigint").groupBy("lang", "packed").agg(F.sum("n").alias("n")).cache()
    try:
        languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        code = F.array_position(F.lit(languages), F.col("lang")).cast("int") if languages else F.lit(0)
        got = counts.select(code.alias("code"), "packed", "n").toArrow()
    finally:
        counts.unpersist()
    if not languages:
        return Model([], {}, {}, np.zeros(0))
    code, packed, n = (got.column(c).to_numpy() for c in ("code", "packed", "n"))
    packed = packed.view(np.uint64)
    order = np.lexsort((packed, code))
    edges = np.searchsorted(code[order], np.arange(1, len(languages) + 2))
    model = build(languages, [(packed[order[i:j]], n[order[i:j]]) for i, j in zip(edges, edges[1:])], False)
    return calibrate(model, rows, s)


def calibrate(model: Model, rows: DataFrame, s: Settings) -> Model:
    """Temperature and limits from at most s.calibration_rows training rows, those of the lowest hash of their id."""
    chosen = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.calibration_rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, letters = cross_entropies(batch.column(1), shared.value)
            some = letters > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(list(h[some]), pa.list_(pa.float64()))], names=["lang", "h"])

    got = rows.join(F.broadcast(chosen), "doc_id").select("lang", "text").mapInArrow(tokens.tidy(run), "lang string, h array<double>").toPandas()
    got = got[got["lang"].isin(model.languages)]
    model.limits = np.full(len(model.languages), np.inf)
    if len(got):
        h = np.stack(got["h"].to_numpy())
        truth = np.searchsorted(model.languages, got["lang"].to_numpy())
        best = (np.inf, 1.0)
        for t in np.geomspace(1, 200, 40):
            z = -t * (h - h.min(axis=1, keepdims=True))
            best = min(best, (float(-(z[np.arange(len(h)), truth] - np.log(np.exp(z).sum(axis=1))).mean()), float(t)))
        model.temperature = best[1]
        for i in range(len(model.languages)):
            own = h[truth == i, i]
            if len(own):
                model.limits[i] = np.quantile(own, s.accepted_share) * 1.02
    return model


def identify(documents: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """documents with lang_pred, score, accepted and cross_entropy appended, replacing columns of those names."""
    small_batches(documents.sparkSession)
    documents = documents.drop("lang_pred", "score", "accepted", "cross_entropy")
    added = T.StructType.fromDDL("lang_pred string, score double, accepted boolean, cross_entropy double")
    schema = T.StructType([*documents.schema.fields, *added.fields])
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            rows = batch.num_rows
            best, score, lowest = np.full(rows, len(names) - 1), np.zeros(rows), np.full(rows, np.nan)
            if m.languages:
                h, letters = cross_entropies(batch.column(at), m)
                some = letters > 0
                best = np.where(some, h.argmin(axis=1), best)
                lowest = np.where(some, h.min(axis=1), np.nan)
                score = np.where(some, 1 / np.exp(-m.temperature * (h - h.min(axis=1, keepdims=True))).sum(axis=1), 0.0)
            limit = np.append(m.limits if m.limits is not None else np.full(len(names) - 1, np.inf), -np.inf)
            accepted = (score >= s.min_score) & (np.nan_to_num(lowest, nan=np.inf) <= limit[best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted), pa.array(lowest, from_pandas=True)], names=schema.names)

    return documents.mapInArrow(tokens.tidy(run), schema)
