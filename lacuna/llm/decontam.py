"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame expressions alone.

A test item is found in a document that holds at least 0.8 of its distinct 5-word shingles (an item of fewer words is
one shingle, its whole sequence, and so is such a document). Items are parted by size, powers of two. The sketch of an
item holds its shingles of lowest hash, as many as make a miss impossible at the partition's largest size: a
document that lacks at most a fifth of n shingles holds one of any n/5 + 1. Because sketches are of the short side
only, the length of documents doesn't matter: every shingle of a document is looked up among the sketches, in one pass
without a shuffle of texts. Candidates are then verified by exact containment, shingle text against shingle text.

Texts and their shingles are never shuffled. Sketches are broadcast, BROADCAST_ROWS at a time: beyond that the items, a
stated query set, are taken in blocks, one pass over the documents for each. The texts of items that have candidates
are broadcast in the same way, BROADCAST_BYTES at a time. The list of candidate documents is broadcast where it counts at
most BROADCAST_ROWS items, else joined by a shuffle.

Cases: a null or empty text has no shingle: it is never found and finds nothing. A-Z and other capitals count as
small letters. A repeated item or document row is found as often as it stands there, once in the result. Rows with a null
id, documents and items alike, are compared under that id. Ties don't arise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import keep

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 8 << 20  # of item texts; their shingles take some ten times as much


def words_of(text: Column) -> Column:
    """Lower-case words; null where there is none."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_texts(text: Column) -> Column:
    """The distinct shingles of a text, as texts. The words are bound once: a lambda would split the text for each shingle."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
        return F.array_distinct(F.when(F.size(words) < SHINGLE, F.array(F.array_join(words, " "))).otherwise(many))

    return F.element_at(F.transform(F.array(words_of(text)), of), 1)


def _hash_at(h: str, i: str) -> Column:
    """The hash of the shingle at place i of word hashes; of a short sequence, of all it has."""
    return F.when(F.size(h) >= SHINGLE, F.xxhash64(*[F.get(h, F.col(i) + k) for k in range(SHINGLE)])).otherwise(F.xxhash64(h))


def shingle_hashes(frame: DataFrame, *columns: str) -> DataFrame:
    """A row for each shingle of `text`: the columns and `shingle`."""
    hashed = frame.select(*columns, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("__h")).where("__h is not null")
    placed = hashed.select(*columns, "__h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__h") - SHINGLE, F.lit(0)))).alias("__i"))
    return placed.select(*columns, _hash_at("__h", "__i").alias("shingle"))


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, shingle): of each item its lowest shingles, by the partition of its size."""
    distinct = shingle_hashes(items, "item_id").groupBy("item_id").agg(F.sort_array(F.collect_set("shingle")).alias("all"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("all"))) + 1) - 1
    enough = F.floor(largest * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int") + 1
    return distinct.select("item_id", F.explode(F.slice("all", F.lit(1), enough)).alias("shingle"))


def _sized(frame: DataFrame, rows: Column) -> DataFrame:
    total = frame.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(frame) if total <= BROADCAST_ROWS else frame


def _in_blocks(left: DataFrame, right: DataFrame, on: Column, key: str, size: Column, most: int) -> DataFrame:
    """left joined to right, of which no more than about `most` is broadcast at a time; left is read once for each block."""
    total = right.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // max(1, most)))
    parts = [right.where(F.pmod(F.xxhash64(F.lit(blocks), key), F.lit(blocks)) == i) if blocks > 1 else right for i in range(blocks)]
    return reduce(DataFrame.unionByName, [left.join(F.broadcast(p), on) for p in parts])


def find(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for all documents (doc_id, text) that hold an item (item_id, text)."""
    items = keep(items.select("item_id", "text"), "decontam-items")
    lowest = keep(sketches(items).withColumnRenamed("shingle", "lowest"), "decontam-sketches")
    hits = _in_blocks(shingle_hashes(documents, "doc_id"), lowest, F.col("shingle") == F.col("lowest"), "lowest", F.lit(1), BROADCAST_ROWS)
    candidates = keep(hits.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.collect_set(F.struct("item_id")).alias("items")), "decontam-candidates")
    candidates = candidates.withColumnRenamed("doc_id", "of_doc")

    texts = documents.select("doc_id", "text").join(_sized(candidates, F.size("items") + 1), F.col("doc_id").eqNullSafe(F.col("of_doc")))
    texts = texts.select("doc_id", shingle_texts(F.col("text")).alias("in_doc"), F.explode("items.item_id").alias("of_item"))
    hit = keep(candidates.select(F.explode("items.item_id").alias("hit_item")).distinct(), "decontam-hit")
    wanted = keep(items.join(hit, F.col("item_id").eqNullSafe(F.col("hit_item")), "left_semi").distinct(), "decontam-wanted")
    wanted = wanted.select("item_id", shingle_texts(F.col("text")).alias("in_item"), F.octet_length("text").alias("bytes"))
    pairs = _in_blocks(texts, wanted, F.col("of_item").eqNullSafe(F.col("item_id")), "item_id", F.col("bytes"), BROADCAST_BYTES)
    counted = pairs.select("doc_id", "item_id", F.size("in_item").cast("bigint").alias("n_item"), F.size(F.array_intersect("in_item", "in_doc")).cast("bigint").alias("n_shared"))
    found = counted.where(F.col("n_shared") * 100 >= F.col("n_item") * int(SIMILARITY * 100))
    best = found.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item was found; all columns pass through."""
    found = keep(find(documents, items).select(F.col("doc_id").alias("__found")).distinct(), "decontam-found")
    return documents.join(_sized(found, F.lit(1)), F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")
