"""N-gram Jaccard join: all links between texts whose sets of 5-word shingles have a similarity of 0.8 or more.

Equal sets are one class from the start: sets of one 64-bit digest, and where those of a second digest differ, of both.
Of each class one text is read again, and its shingles (48 bits of their hash) go to an inverted index that is dealt by
ranges of shingles, packed and sorted, a few MB to a task. Texts are indexed in units of some ten thousand; a shingle that
several texts of a unit hold goes there once, with their number, so the most frequent shingle brings a task one entry from
each unit. A shingle that only one class holds can't be shared and ends there; the others go back to their unit with the
number of classes that hold them. A class that shares less than 0.8 of its shingles with anyone is done. The rest sort theirs rarest first;
two classes that link share one of the first s - ceil(0.8 n) + 1 of s shared out of n shingles, so classes that share such a prefix
shingle form a cluster, found as components of stars: a hot shingle sends one row from each unit of index and never a pair.

Clusters are joined where they fit one task; sets of larger ones are dealt to blocks by size, as those that link differ by
a quarter at most, and each pair of blocks of the same or neighbouring sizes is a task.
Inside a task, set relations save work twice. Index lists are kept in blocks by position, and a set without similar
predecessor reads just those blocks that its prefix can meet. A set that is highly similar to one whose answers are known
(overlap counts with all sets at hand) derives its own from them: it adds the lists of the shingles it has more and
takes off those of the shingles it has less.

Cases: a null or empty text has no shingle and links with nothing, not even its like; a text of fewer than five words
is one shingle; repeated rows are one class, and rows of one id with different texts are sets of their own. A document
without id belongs to its class and component and gets the least id there, if any. A component is named by its least
doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import tokens
from lacuna.llm.components import components
from lacuna.llm.skew import hot_join
from lacuna.llm.storage import discard, keep, small_batches

BROADCAST_ROWS = 1_000_000
RANGE_POSTINGS = 1_000_000
UNIT_POSTINGS = 1_000_000
UNIT_DOCS = 60_000
BUCKET_BYTES = 8 << 20
CLUSTER_BYTES = 16 << 20
_U = np.uint64
_LOW = _U(0xFFFF)
LEVEL = 1.26  # sizes of one level of blocks; a little more than the 1.25 that sets which link can differ by
MOST_CLASHES = 10_000


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """Two digests of a set: the same for equal sets."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            out.append(int(tokens.mix(tokens.mix(shingles ^ _U(seed)).sum(dtype=np.uint64, keepdims=True) + _U(len(shingles)))[0].astype(np.int64)))
    return out[0], out[1]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, own = [], []
        for w in tokens.words(batch.column(2)):
            for s in tokens.shingle_sets(w):
                n.append(len(s))
                own.append(class_of(s) if len(s) else (None, None))
        columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array([x[k] for x in own], pa.int64()) for k in range(2))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "of_text", "n_shingles", "class", "second"])


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """Byte planes of 64-bit numbers: sorted numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unplaned(raw: bytes, width: int = 8) -> np.ndarray:
    x = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    x[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return x.reshape(-1).view(np.uint64)


def _postings(ranges: int, clashes: frozenset[int]):
    """text to (key, unit, body): of each unit its shingles by range, and under a key below 0 what it needs itself.

    The low 16 bits of a shingle are the row in the unit that holds it, or all ones where several do; then their number
    follows, and the rows stay with the unit."""

    def flush(unit: int, held: list[np.ndarray], classes: list[int], sizes: list[int]) -> pa.RecordBatch:
        every = np.concatenate(held)
        every.sort()
        shingle = every >> _U(16)
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        n = np.diff(np.append(starts, len(every)))
        own = np.concatenate([np.array([len(classes), *classes, *sizes], dtype=np.int64).view(np.uint64), every[np.repeat(n > 1, n)]])
        sent, several = every[starts], n[n > 1].astype(np.uint32)
        sent[n > 1] |= _LOW
        behind = np.append(0, np.cumsum(n > 1))
        place = ((sent >> _U(32)) * _U(ranges)) >> _U(32)
        at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        keys, bodies = [-1 - unit % ranges], [own.tobytes()]
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(sent)]):
            keys.append(int(place[lo]))
            bodies.append(np.int64(hi - lo).tobytes() + planes(sent[lo:hi]) + several[behind[lo] : behind[hi]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([unit] * len(keys), pa.int64()), pa.array(bodies, pa.binary())], names=["key", "unit", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, seen = TaskContext.get().partitionId() << 24, set()
        held, classes, sizes, total = [], [], [], 0
        for batch in batches:
            for w in tokens.words(batch.column(0)):
                for s in tokens.shingle_sets(w):
                    if not len(s):
                        continue
                    own, second = class_of(s)
                    own = own ^ second if own in clashes else own
                    if own in seen:
                        continue
                    seen.add(own)
                    bare = s & ~_LOW
                    if len(bare) > 1:
                        bare = bare[np.append(True, bare[1:] != bare[:-1])]
                    held.append(bare | _U(len(classes)))
                    classes.append(own)
                    sizes.append(len(s))
                    total += len(bare)
                    if total >= UNIT_POSTINGS or len(classes) >= UNIT_DOCS:
                        yield flush(unit, held, classes, sizes)
                        unit, held, classes, sizes, total = unit + 1, [], [], [], 0
        if classes:
            yield flush(unit, held, classes, sizes)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """One range: of shingles to those that two classes or more hold, by unit, with their number."""
    key, units, bodies = table.column(0)[0].as_py(), table.column(1).to_pylist(), table.column(2).to_pylist()
    if key < 0:
        return pa.table({"unit": pa.array(units, pa.int64()), "names": pa.array([True] * len(units), pa.bool_()), "body": pa.array(bodies, pa.binary())})
    lengths = [int(np.frombuffer(b, np.int64, 1)[0]) for b in bodies]
    every = np.concatenate([unplaned(b[8 : 8 + 8 * n]) for b, n in zip(bodies, lengths)])
    holders = np.ones(len(every), dtype=np.int64)
    holders[every & _LOW == _LOW] = np.concatenate([np.frombuffer(b, np.uint32, offset=8 + 8 * n) for b, n in zip(bodies, lengths)])
    source = np.repeat(np.arange(len(bodies)), lengths)
    order = np.argsort(every, kind="stable")
    every, source, holders = every[order], source[order], holders[order]
    shingle = every >> _U(16)
    starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    held_by = np.repeat(np.add.reduceat(holders, starts), np.diff(np.append(starts, len(shingle))))
    more = held_by > 1
    every, source, shingle, held_by = every[more], source[more], shingle[more], held_by[more]
    order = np.argsort(source, kind="stable")
    source = source[order]
    filled = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, int)
    names, out = [], []
    for lo, hi in zip(filled, np.append(filled[1:], len(source))):
        own = order[lo:hi]
        names.append(units[source[lo]])
        out.append((every[own] & _LOW).astype(np.uint16).tobytes() + np.minimum(held_by[own], 0xFFFF).astype(np.uint16).tobytes() + planes(shingle[own], 6))
    return pa.table({"unit": pa.array(names, pa.int64()), "names": pa.array([False] * len(names), pa.bool_()), "body": pa.array(out, pa.binary())})


def least_overlap(n: np.ndarray) -> np.ndarray:
    """What a set of n shares at least with any set it links with."""
    return (8 * n + 9) // 10


_PARTS = "kind int, a bigint, b bigint, n bigint, body binary"


def _clusters(table: pa.Table) -> pa.Table:
    """One unit: the classes that may link (kind 0), stars inside the unit (1), and a row for each prefix shingle (2)."""
    names, bodies = table.column(1).to_pylist(), table.column(2).to_pylist()
    about = np.frombuffer(bodies[names.index(True)], dtype=np.int64)
    count = int(about[0])
    classes, n, within = about[1 : 1 + count], about[1 + count : 1 + 2 * count], about[1 + 2 * count :].view(np.uint64)
    raw = [b for b, is_names in zip(bodies, names) if not is_names]
    m = [len(b) // 10 for b in raw]
    row = np.concatenate([np.frombuffer(b, np.uint16, k) for b, k in zip(raw, m)] or [np.zeros(0, np.uint16)])
    rarity = np.concatenate([np.frombuffer(b, np.uint16, k, 2 * k) for b, k in zip(raw, m)] or [np.zeros(0, np.uint16)])
    shingle = np.concatenate([unplaned(b[4 * k :], 6) for b, k in zip(raw, m)] or [np.zeros(0, np.uint64)])
    many = np.flatnonzero(row == 0xFFFF)
    if len(many):  # rows of shingles that several of this unit hold are here
        many = many[np.argsort(shingle[many])]
        theirs, one = within >> _U(16), row != 0xFFFF
        common = rarity[many][np.searchsorted(shingle[many], theirs)]
        row = np.concatenate([row[one], (within & _LOW).astype(np.uint16)])
        rarity, shingle = np.concatenate([rarity[one], common]), np.concatenate([shingle[one], theirs])
    shared = np.bincount(row, minlength=len(n))
    alive = shared >= least_overlap(n)
    use = alive[row]
    shingle, row, rarity = shingle[use], row[use], rarity[use]
    order = np.lexsort((shingle, rarity, row))
    row, shingle = row[order], shingle[order]
    rows = np.flatnonzero(alive)
    cut = np.searchsorted(row, np.append(rows, len(n)))
    bodies = [planes(shingle[cut[i] : cut[i + 1]], 6) for i in range(len(rows))]

    place = np.arange(len(row)) - np.searchsorted(row, row)
    prefix = place <= (shared - least_overlap(n))[row]
    shingle, row = shingle[prefix], row[prefix]
    order = np.argsort(shingle, kind="stable")
    shingle, row = shingle[order], row[order]
    first = np.append(True, shingle[1:] != shingle[:-1]) if len(shingle) else np.zeros(0, bool)
    lead = row[first][np.cumsum(first) - 1] if len(shingle) else row
    star = np.unique(np.stack([lead[~first], row[~first]]), axis=1) if len(shingle) else np.zeros((2, 0), int)
    star = star[:, star[0] != star[1]]
    kind = np.repeat([0, 1, 2], [len(rows), star.shape[1], int(first.sum())])
    a = np.concatenate([classes[rows], classes[star[0]], shingle[first].astype(np.int64)])
    b = np.concatenate([np.zeros(len(rows), np.int64), classes[star[1]], classes[row[first]]])
    sizes = np.concatenate([n[rows], np.zeros(len(kind) - len(rows), np.int64)])
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(sizes, pa.int64()), "body": pa.array([*bodies, *[None] * (len(kind) - len(rows))], pa.binary())})


class Joined:
    """Sets of a cluster, by size, with an index of blocks by position and the answers of a few pivots."""

    PIVOTS = 4

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.ptr = np.append(0, np.cumsum([len(s) for s in sets]))
        kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = ids
        owner = np.repeat(np.arange(len(sets)), np.diff(self.ptr))
        position = np.arange(len(ids)) - self.ptr[owner]
        self.reach = np.diff(self.ptr) - least_overlap(sizes)  # the last place of each prefix
        self.band = np.frexp(position + 1.0)[1].astype(np.int64)  # blocks 1, 2-3, 4-7, ...
        self.bands = int(self.band.max(initial=0)) + 1
        key = ids * self.bands + self.band
        order = np.lexsort((owner, key))
        self.owner, self.position, key = owner[order], position[order], key[order]
        self.block = np.searchsorted(key, np.arange(len(kinds) * self.bands + 1))
        self.held = np.zeros(len(kinds), dtype=bool)
        self.pivots: list[tuple[np.ndarray, np.ndarray]] = []

    def own(self, x: int) -> np.ndarray:
        return self.ids[self.ptr[x] : self.ptr[x + 1]]

    def lists(self, ids: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Places in the index of the lists of these shingles, whole or up to a block."""
        lo = self.block[ids * self.bands]
        hi = self.block[ids * self.bands + (self.bands if upto is None else min(upto + 1, self.bands))]
        n = hi - lo
        return np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def answers(self, x: int) -> np.ndarray | None:
        """Overlap with every set at hand; None if no set can link."""
        mine = self.own(x)
        for at, (theirs, known) in enumerate(self.pivots):
            self.held[theirs] = True
            common = self.held[mine]
            self.held[theirs] = False
            shared = int(common.sum())
            if len(mine) + len(theirs) - 2 * shared <= len(mine) // 3:
                more = mine[~common]
                self.held[mine] = True
                less = theirs[~self.held[theirs]]
                self.held[mine] = False
                m = len(known)
                self.pivots.insert(0, self.pivots.pop(at))
                return known + np.bincount(self.owner[self.lists(more)], minlength=m) - np.bincount(self.owner[self.lists(less)], minlength=m)
        lo, hi = np.searchsorted(self.sizes, [least_overlap(self.sizes[x : x + 1])[0], self.sizes[x] * 5 // 4 + 1])
        deepest = int(self.reach[lo:hi].max())
        at = self.lists(mine[: self.reach[x] + 1], int(np.frexp(deepest + 1.0)[1]))
        near = self.owner[at]
        near = near[(near >= lo) & (near < hi) & (near != x) & (self.position[at] <= self.reach[near])]
        if not len(near):
            return None
        known = np.bincount(self.owner[self.lists(mine)], minlength=len(self.sizes))
        self.pivots = [(mine, known), *self.pivots[: self.PIVOTS - 1]]
        return known

    def links(self, x: int) -> np.ndarray:
        o = self.answers(x)
        if o is None:
            return np.zeros(0, dtype=np.int64)
        hit = np.flatnonzero(100 * o >= 80 * (self.sizes[x] + self.sizes - o))
        return hit[hit != x]


def join_sets(classes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes in order of size, the least class that each reaches, and its number of links; with blocks, across two blocks alone."""
    order = np.lexsort((classes, sizes))
    classes, sizes, sets = classes[order], sizes[order], [sets[i] for i in order]
    block = None if block is None or len(np.unique(block)) < 2 else block[order]
    joined, label, count = Joined(sets, sizes), np.arange(len(classes)), np.zeros(len(classes), dtype=np.int64)
    for x in range(len(classes)):
        hit = joined.links(x)
        if block is not None:
            hit = hit[block[hit] != block[x]]
        count[x] = len(hit)
        if len(hit):
            groups = np.unique(label[np.append(hit, x)])
            if len(groups) > 1:
                label[np.isin(label, groups[1:])] = groups[0]
    least = np.full(len(classes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, classes)
    return classes, least[label], count


def _joined(table: pa.Table) -> pa.Table:
    """One bucket of clusters, or one pair of blocks of a cluster."""
    cluster, block = (table.column(c).to_numpy() for c in ("cluster", "block"))
    classes, sizes, bodies = table.column("class").to_numpy(), table.column("n").to_numpy(), table.column("body")
    order = np.lexsort((classes, cluster))
    order = order[np.append(True, (cluster[order][1:] != cluster[order][:-1]) | (classes[order][1:] != classes[order][:-1]))]
    cut = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
    out = []
    for lo, hi in zip(cut, np.append(cut[1:], len(order))):
        own = order[lo:hi]
        if len(own) > 1:
            out.append(join_sets(classes[own], sizes[own], [unplaned(bodies[int(i)].as_py(), 6) for i in own], block[own]))
    a, b, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array(n, pa.int64())})


def _sized(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def signatures(documents: DataFrame) -> DataFrame:
    """(doc_id, of_text, n_shingles, class, second) of each row, written; of_text is a hash of the whole text."""
    small_batches(documents.sparkSession)
    long = [T.StructField(x, T.LongType()) for x in ("of_text", "n_shingles", "class", "second")]
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *long])
    return keep(documents.select("doc_id", F.xxhash64("text").alias("of_text"), "text").mapInArrow(tokens.tidy(_signatures), schema), "jaccard-signatures")


def _classes(signed: DataFrame) -> DataFrame:
    by = signed.where("class is not null").groupBy("class")
    return keep(by.agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.min("second").alias("lowest"), F.max("second").alias("highest")), "jaccard-classes")


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """Signatures and classes in which no class holds two sets, and the digests that had to be told apart.

    A clash of 64 bits is expected among some 10^9.6 different sets; MOST_CLASHES would need 10^11.5."""
    classes = _classes(signed)
    clashes = frozenset(r["class"] for r in classes.where("lowest != highest").select("class").limit(MOST_CLASHES + 1).collect())
    if not clashes:
        return signed, classes, clashes
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError("too many sets share a digest")
    signed = signed.withColumn("class", F.when(F.col("class").isin(list(clashes)), F.col("class").bitwiseXOR(F.col("second"))).otherwise(F.col("class")))
    return signed, _classes(signed), clashes


def class_links(documents: DataFrame, signed: DataFrame, classes: DataFrame, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(a, b, n_links): each class that may link, one it is joined to (itself where there is none), and its links in one task."""
    copies = signed.where("doc_id is not null").select("doc_id").distinct().join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    copies = keep(copies.withColumnRenamed("doc_id", "copy"), "jaccard-copies")
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(8, -(-total // RANGE_POSTINGS))
    single = documents.join(_sized(copies), F.col("doc_id") == F.col("copy"), "left_anti").select("text")
    index = single.mapInArrow(tokens.tidy(_postings(ranges, clashes)), "key int, unit bigint, body binary")
    shared = index.groupBy("key").applyInArrow(tokens.tidy(_shared), "unit bigint, names boolean, body binary")
    parts = keep(shared.groupBy("unit").applyInArrow(tokens.tidy(_clusters), _PARTS), "jaccard-parts")
    discard(copies)

    prefix = parts.where("kind = 2").select(F.col("a").alias("shingle"), F.col("b").alias("class"))
    lead = prefix.groupBy("shingle").agg(F.min("class").alias("lead"), F.count("*").alias("n")).where("n > 1")
    stars = hot_join(prefix, keep(lead, "jaccard-leads"), "shingle", F.col("n"), prefix.count()).where("class != lead").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct()
    found = components(parts.where("kind = 1").select("a", "b").union(stars))
    cluster = found.select(F.col("node").alias("class"), F.col("root").alias("cluster"))

    sets = parts.where("kind = 0").select(F.col("a").alias("class"), "n", "body").dropDuplicates(["class"]).join(cluster, "class")
    sets = keep(sets.withColumn("level", F.floor(F.log("n") / F.log(F.lit(LEVEL))).cast("int")), "jaccard-sets")
    levels = keep(sets.groupBy("cluster", "level").agg(F.sum(F.length("body")).alias("bytes")), "jaccard-levels")
    buckets = max(1, -(-(levels.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    large = keep(levels.groupBy("cluster").agg(F.sum("bytes").alias("whole")).where(F.col("whole") > CLUSTER_BYTES).select("cluster"), "jaccard-large")
    blocks = levels.join(_sized(large), "cluster").select("cluster", "level", F.ceil(F.col("bytes") / CLUSTER_BYTES).cast("int").alias("blocks"))
    blocks = keep(blocks, "jaccard-blocks")
    alone = sets.join(_sized(large), "cluster", "left_anti").select(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).alias("task"), F.lit(False).alias("several"), "cluster", F.lit(0).cast("bigint").alias("block"), "class", "n", "body")

    def block(level: str, number: str) -> Column:
        return (F.col(level).cast("bigint") * (1 << 32) + F.col(number)).cast("bigint")

    own = sets.join(_sized(blocks), ["cluster", "level"]).withColumn("number", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks")
    own = own.withColumn("near", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    others = blocks.select(F.col("cluster").alias("of"), F.col("level").alias("other_level"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = own.join(_sized(others), (F.col("cluster") == F.col("of")) & (F.col("near") == F.col("other_level")))
    dealt = dealt.withColumn("block", block("level", "number")).withColumn("beside", block("other_level", "other"))
    pair = F.xxhash64("cluster", F.least("block", "beside"), F.greatest("block", "beside"))
    dealt = dealt.select(pair.alias("task"), F.lit(True).alias("several"), "cluster", "block", "class", "n", "body")
    links = keep(alone.union(dealt).groupBy("task", "several").applyInArrow(tokens.tidy(_joined), "a bigint, b bigint, n_links bigint"), "jaccard-links")
    discard(parts, found, sets, levels, large, blocks)
    return links


def grouped(documents: DataFrame) -> DataFrame:
    """(doc_id, of_text, n_shingles, class, class_id, n_links, component, component_id) of each row; component is unique, component_id as good as doc_id."""
    signed, classes, clashes = told_apart(signatures(documents))
    links = class_links(documents, signed, classes, clashes)
    roots = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n_links").alias("n_links"))
    names = classes.select("class", "class_id", "n")
    linked = keep(names.drop("n").join(roots, F.col("class") == F.col("node")).select("class", "class_id", "root"), "jaccard-linked")
    least = keep(linked.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")), "jaccard-least")
    reached = hot_join(linked.select("class", "root"), least, "root", F.col("n"), linked.count()).select("class", "root", "component_id")
    named = names.join(reached, "class", "left").join(counts, F.col("class") == F.col("a"), "left")
    named = keep(named.select("class", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "class").alias("component"), F.coalesce("component_id", "class_id").alias("component_id"), "n"), "jaccard-named")
    discard(links, roots, linked, least)
    with_words = hot_join(signed.where("class is not null"), named, "class", F.col("n"), signed.count()).drop("n")
    found = with_words.unionByName(signed.where("class is null"), allowMissingColumns=True)
    return found.select("doc_id", "of_text", "n_shingles", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def join(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id) of each row of documents (doc_id, text).

    class_id is the least doc_id with the same set; n_links counts the other classes that it links with."""
    return grouped(documents).select("doc_id", "n_shingles", "class_id", "n_links", "component_id")


def dedup(documents: DataFrame) -> DataFrame:
    """One row of each component: of the rows with its least doc_id that of the lowest hash of its text, and of rows alike in
    both that of the lowest hash of all columns. Rows without id or words stay. All columns pass through."""
    rows = keep(grouped(documents.select("doc_id", "text")), "jaccard-grouped")
    named = rows.where("doc_id is not null and class is not null")
    heads = keep(named.where("doc_id = component_id").groupBy("component", "doc_id", "of_text").agg(F.count("*").alias("n")), "jaccard-heads")
    first = heads.groupBy("component").agg(F.min("of_text").alias("first"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    others = heads.join(first, "component").where("of_text != first").select("doc_id", "of_text")
    key = [F.col("doc_id").alias("__doc"), F.col("of_text").alias("__of")]
    gone = keep(named.where("doc_id != component_id").select("doc_id", "of_text").union(others).distinct().select(*key), "jaccard-gone")
    again = keep(heads.where("n > 1").select("doc_id", "of_text").distinct().select(*key), "jaccard-again")
    same = (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__of"))
    left = documents.join(_sized(gone), same, "left_anti")
    discard(rows)
    if not again.count():
        return left
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    many = left.join(_sized(again), same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(one.alias("__row")).select("__row.*")
    return left.join(_sized(again), same, "left_anti").union(many)
