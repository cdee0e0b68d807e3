"""A prefix trie of conversations from chained digests.

A turn's digest is the SHA-256 of its role and text, with the role's length before both. The digest of a prefix is the
SHA-256 of the digest of the prefix one turn shorter and the last turn's digest, so it names the whole sequence. Every
conversation is exploded into its prefixes, and a group by (depth, digest) makes the nodes. Texts stay where they are: what is
shuffled are digests, numbers of words and ids.

Sums over subtrees come from exploding to ancestors. A node belongs to its smallest member; the nodes of one owner are a
stretch at the end of that conversation's path, since a longer prefix of it keeps its smallest member. Sums along a stretch
are a window, and each stretch goes as one to all ancestors above it: no more rows than there are prefixes, where node by
node a conversation of n shared turns would give n * n / 2.

The ids of a node's ended members are joined and hashed as a stream: tasks over ranges of (node, id) join them to pieces of PIECE
bytes, and one task for each node hashes its pieces in order, holding one at a time.

Turns are in order of `turn`, null first; turns that tie, by digest. Null role or text is empty; rows without conv_id belong to no conversation;
an empty table has no node. Repeated rows are repeated turns. Extra columns aren't read. A conversation's own turns are
chained in one task, as a chain has to be, from 32 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.skew import hot_join
from lacuna.llm.storage import discard, keep, small_batches
from lacuna.llm.tokens import tidy

ROOT = bytes(32)
PIECE, ROWS = 1 << 16, 8_192
PREFIXES = "conv_id bigint, depth bigint, node binary, parent binary, words bigint, ended boolean"
KEY = ["conv_id", "part", "place", "turn", "digest"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))


def _as_own(turns: DataFrame, skip: Column) -> DataFrame:
    return turns.select("conv_id", F.lit(1).alias("part"), F.lit(0).alias("place"), "turn", "digest", "words", skip.cast("int").alias("skip"))


def sequences(turns: DataFrame) -> DataFrame:
    """Each conversation as it is."""
    return _as_own(turns, F.lit(0))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c after the first h turns of conversation c - c % block, in place of its own first h; h = crc32(c) % heads."""
    of = F.col("conv_id")
    h = F.crc32(of.cast("string").cast("binary")) % heads
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    first = turns.where(of % block == 0).withColumn("place", F.row_number().over(order)).where(F.col("place") < heads)
    wanted = turns.select("conv_id").distinct().select(of.alias("conv_id"), (of - of % block).alias("__base"), h.alias("__h"))
    lent = first.select(of.alias("__base"), "place", "digest", "words").join(wanted.where("__h > 0"), "__base").where(F.col("place") <= F.col("__h"))
    lent = lent.select("conv_id", F.lit(0).alias("part"), "place", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), "digest", "words", F.lit(0).alias("skip"))
    return _as_own(turns, h).unionByName(lent)


def prefixes(sequence: DataFrame) -> DataFrame:
    """Every prefix of every conversation, from the root: (conv_id, depth, node, parent, words of the last turn, whether it ends there)."""
    small_batches(sequence.sparkSession, ROWS)

    @tidy
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, out = hashlib.sha256, []
        conv, depth, node, parent, last, left = None, 0, ROOT, None, 0, 0

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["conv_id", "depth", "node", "parent", "words", "ended"])

        for batch in batches:
            for c, part, digest, words, skip in zip(*(batch[x].to_pylist() for x in ("conv_id", "part", "digest", "words", "skip")), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, depth, node, parent, last, True))
                    conv, depth, node, parent, last, left = c, 0, ROOT, None, 0, None
                if part:
                    left = skip if left is None else left
                    if left:
                        left -= 1
                        continue
                out.append((conv, depth, node, parent, last, False))
                depth, parent, node, last = depth + 1, node, sha(node + digest).digest(), words
            if len(out) >= ROWS:
                yield made()
                out = []
        if conv is not None:
            out.append((conv, depth, node, parent, last, True))
        if out:
            yield made()

    dealt = sequence.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place", F.asc_nulls_first("turn"), "digest")
    return dealt.select(*KEY[:2], "digest", "words", "skip").mapInArrow(chain, PREFIXES)


def ends(prefix: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end: the hash of their ids in order, joined by commas."""

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for n, c in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if n != node or size >= PIECE:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, size = n, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield _pieces(out)
        if ids:
            yield _pieces([(node, first, ",".join(ids))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, piece in zip(batch["node"].to_pylist(), batch["piece"], strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(piece.as_buffer())
            if out:
                yield _hashes(out)
        if state:
            yield _hashes([(node, state.hexdigest())])

    ended = prefix.where("ended").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ended.mapInArrow(join, "node binary, first bigint, piece string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(run, "node binary, ends_sha256 string")


def _pieces(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    node, first, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(piece, pa.string())], ["node", "first", "piece"])


def _hashes(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    node, found = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])


def trie(sequence: DataFrame) -> DataFrame:
    """A row for each node of the conversations that sequences() or rebuilt() gives."""
    prefix = keep(prefixes(sequence), "trie-prefixes")
    nodes = prefix.groupBy("depth", "node", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = keep(nodes, "trie-nodes")
    below = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    full = keep(nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    discard(nodes)

    onward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = full.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("bigint"))
    own = weighed.withColumn("saved", F.sum("saved").over(onward)).withColumn("leaves", F.sum("leaf").over(onward)).drop("leaf")
    stretch = weighed.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves")).where("more_saved > 0 or more_leaves > 0")
    hung = prefix.select("conv_id", "depth", "node").join(stretch, "conv_id").where("depth < top").groupBy("node").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))

    total = full.count()
    parents = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    of_parent = hot_join(full.where("depth > 0").select("node", "parent"), parents, "parent", F.col("n_children"), total).select("node", "parent_conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    joined = own.join(hung, "node", "left").join(of_parent, "node", "left").join(ends(prefix), "node", "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
