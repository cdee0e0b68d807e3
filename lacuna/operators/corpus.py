"""Corpus ETL: raw poems to works, authors, poems, lines, gram postings and statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.config import HAN, Profile
from lacuna.functions import keys, text
from lacuna.storage import checkpointed

BUCKETS = 256
#: Of stored grams, which each task writes for its own lines.
GRAM_BUCKETS = 32
#: Hashes of grams, and numbers of lines, that are broadcast.
BROADCAST_GRAMS, BROADCAST_LINES = 4_000_000, 1_000_000


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus. lines: poem_id, work_id, line_no, text_display, text_match."""

    works: DataFrame
    authors: DataFrame
    poems: DataFrame
    lines: DataFrame
    profile: Profile


def authors_of(raw: DataFrame, profile: Profile = HAN) -> DataFrame:
    """raw (name, dynasty, bio, file): one author for each match name, the first by file and name."""
    named = raw.where(F.length(F.trim("name")) > 0).withColumn("name_match", text.match_form(F.col("name"), profile))
    first = Window.partitionBy("name_match").orderBy("file", "name")
    kept = named.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select(F.sha2("name_match", 256).substr(1, 32).alias("author_id"), F.col("name").alias("name_display"), "name_match", "dynasty", "bio", F.col("file").alias("source_file"))


def prepared(raw: DataFrame, profile: Profile = HAN) -> DataFrame:
    """raw (title, author, paragraphs, upstream_id, dataset, file): poems with forms and keys; empty ones drop out."""
    shown = F.array_join(F.transform("paragraphs", lambda p: text.display_form(p)), "\n")
    frame = raw.withColumn("text_display", shown).withColumn("lines", F.flatten(F.transform("paragraphs", lambda p: text.corpus_lines(text.display_form(p), profile))))
    frame = frame.withColumn("line_forms", text.match_forms(F.col("lines"), profile)).withColumn("text_match", F.array_join("line_forms", ""))
    frame = frame.where(F.length("text_match") > 0)
    title_match, author_match = (text.match_form(F.coalesce(F.col(c), F.lit("")), profile) for c in ("title", "author"))
    return frame.withColumns({
        "work_id": keys.work_key(author_match, title_match, F.get("line_forms", F.lit(0))),
        "content_hash": keys.content_hash(F.col("dataset"), F.col("file"), F.coalesce(F.col("title"), F.lit("")), F.col("text_match")),
        "author_match": author_match,
        "char_count": F.length("text_match"),
        "line_count": F.size("lines"),
    })


def last_by(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the last in order."""
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[o.desc() for o in order]))).where("__n = 1").drop("__n")


def build(raw: DataFrame, authors: DataFrame, profile: Profile = HAN) -> Corpus:
    """All tables of a corpus. Copies of a poem (content hash) keep their last; the last title names a work."""
    poems = last_by(prepared(raw, profile), "content_hash", F.col("file"), F.col("upstream_id"))
    who = authors.select("author_id", F.col("name_match").alias("author_match"))
    poems = poems.join(who, "author_match", "left").withColumn("poem_id", F.col("content_hash"))
    works = last_by(poems.select("work_id", "title", "author_id", "poem_id"), "work_id", F.col("poem_id")).drop("poem_id")
    return Corpus(works, authors, poems.drop("lines", "line_forms"), lines_of(poems), profile)


def lines_of(poems: DataFrame) -> DataFrame:
    """A row for each line that has a match form; poems carry lines and line_forms."""
    each = poems.select("poem_id", "work_id", F.posexplode(F.arrays_zip("lines", "line_forms")).alias("line_no", "x"))
    rows = each.select("poem_id", "work_id", "line_no", F.col("x.lines").alias("text_display"), F.col("x.line_forms").alias("text_match"))
    return rows.where(F.length("text_match") > 0).withColumns({"char_count": F.length("text_match"), "rhyme_char": F.substring("text_match", -1, 1)})


def stride(profile: Profile) -> int:
    """How far apart the indexed places of a line may be: a window of the least length still holds a whole gram at one of them."""
    return profile.min_window - profile.seed + 1


def postings(lines: DataFrame, size: int, step: int = 1) -> DataFrame:
    """(gram, place, and the line): an inverted index of the grams at every `step`-th place of a line."""
    n = F.length("text_match")  # short lines drop out here: a filter would make their match forms a second time
    placed = lines.select("*", F.explode(F.when(n >= size, F.sequence(F.lit(1), n - (size - 1), F.lit(step)))).alias("place"))
    return placed.withColumn("gram", F.substring("text_match", F.col("place"), F.lit(size)))


def term_postings(poems: DataFrame) -> DataFrame:
    """(poem_id, work_id, char_count, term): the distinct bigrams of each poem, with what scores need of it."""
    return poems.select("poem_id", "work_id", "char_count", F.explode(F.array_distinct(text.bigrams(F.col("text_match")))).alias("term"))


@dataclass(frozen=True)
class Index:
    """Stored postings in buckets of their gram or term, and the statistics of the corpus they were made from.

    grams (gram, poem_id, line_no) name lines by hashes of their grams; their texts are in `lines` once. terms leave out the
    works, which `works` (poem_id, char_count, work_id) names once for each document; they and `stats` are for terms. Kinds of postings
    that weren't written are None. Those of sources.segments have seeds in place of grams, blocks of postings
    (packed, a row for each block; `blocks` and `terms` are views of them; marks, packed seeds; `seeds` is made of lines), and what of both is removed."""

    grams: DataFrame | None
    terms: DataFrame | None
    stats: DataFrame | None
    works: DataFrame | None = None
    seeds: DataFrame | None = None
    marks: DataFrame | None = None
    lines: DataFrame | None = None
    packed: DataFrame | None = None
    blocks: DataFrame | None = None
    removed: DataFrame | None = None
    removed_terms: DataFrame | None = None
    frequency: bytes = field(default=b"", repr=False)
    buckets: int = BUCKETS


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


KINDS = ("grams", "terms")


def write_index(poems: DataFrame, lines: DataFrame, profile: Profile, folder: str, spread: int = 4, kinds: tuple[str, ...] = KINDS) -> None:
    """Write the postings that searches read, once for a corpus. poem_id has to be unique.

    kinds: exact search reads grams, BM25 reads terms. Terms are stored in blocks of documents (operators.blocks), written by a task for
    `spread` buckets; of a document, its distinct terms are shuffled. A posting of a gram is a hash and the number of a line, and is written where its
    line is read: lines are stored once, and neither their texts nor postings are shuffled. The match forms of lines are those of text_display."""
    if "grams" in kinds:
        lines.select("poem_id", "work_id", "line_no", "text_display").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/lines")
        stored = postings(read_lines(poems.sparkSession, folder, profile), profile.seed, stride(profile)).select("poem_id", "line_no", gram_hash("gram").alias("gram"))
        dealt = stored.withColumn("bucket", bucket("gram", GRAM_BUCKETS)).sortWithinPartitions("bucket")
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/grams")
    if "terms" in kinds:
        from lacuna.operators import blocks

        blocks.postings(poems, BUCKETS, spread).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/terms")
        poems.select("poem_id", "char_count", "work_id").distinct().write.mode("overwrite").parquet(f"{folder}/works")
        stats(poems).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


def read_lines(spark: SparkSession, folder: str, profile: Profile) -> DataFrame:
    return spark.read.parquet(f"{folder}/lines").withColumn("text_match", text.match_form(F.col("text_display"), profile))


def read_index(spark: SparkSession, folder: str, kinds: tuple[str, ...] = KINDS, profile: Profile | None = None) -> Index:
    """profile: that of the postings, which grams need."""
    packed = terms = stats = works = None
    if "terms" in kinds:
        from lacuna.operators import blocks

        packed, works = (spark.read.parquet(f"{folder}/{name}").withColumn("segment", F.lit("")) for name in ("terms", "works"))
        terms = blocks.documents(blocks.rows_of(packed, works.schema["poem_id"].dataType.simpleString(), BUCKETS)).drop("segment", "block")
        stats = spark.read.parquet(f"{folder}/stats")
    grams = lines = None
    if "grams" in kinds:
        lines = read_lines(spark, folder, profile)
        ids = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("poem_id", "line_no"))
        grams = spark.read.schema(f"{ids}, gram int, bucket int").parquet(f"{folder}/grams")
    return Index(grams, terms, stats, works, lines=lines, packed=packed)


def gram_hash(gram: str) -> Column:
    """What stored postings know of a gram. Grams that share a hash cost lines that are looked at in vain."""
    return F.hash(gram)


def of_grams(stored: DataFrame, key: str, grams: DataFrame) -> DataFrame:
    """Rows whose hash of a gram (key) is that of one of the grams, which are broadcast; without key."""
    return stored.join(F.broadcast(grams.select(gram_hash("gram").alias(key)).distinct()), key, "left_semi").drop(key)


def lines_with(grams: DataFrame, index: Index) -> DataFrame:
    """The stored lines that hold one of these grams (gram) at an indexed place, and the few whose grams share a hash with one.

    Only the buckets of the grams are read. The numbers of the lines meet the texts by poem, broadcast up to BROADCAST_LINES of them."""
    hashes = grams.select(gram_hash("gram").alias("gram")).distinct()
    stored = touched(index.grams, hashes, "gram", GRAM_BUCKETS)
    return numbered(of_grams(stored, "gram", grams) if hashes.count() <= BROADCAST_GRAMS else stored.join(hashes, "gram", "left_semi"), index.lines)


def numbered(few: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines with these numbers (poem_id, line_no)."""
    named = few.select(F.xxhash64("poem_id").alias("__poem"), "line_no").distinct()
    named = checkpointed(named.groupBy("__poem").agg(F.collect_list("line_no").alias("__lines")))
    size = named.agg(F.coalesce(F.sum(F.size("__lines")), F.lit(0))).first()[0]
    named = F.broadcast(named) if size <= BROADCAST_LINES else named
    met = lines.withColumn("__poem", F.xxhash64("poem_id")).join(named, "__poem")
    return met.where(F.array_contains("__lines", F.col("line_no"))).drop("__poem", "__lines")


def touched(stored: DataFrame, wanted: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The buckets of stored postings that a batch of keys can meet: as many numbers as buckets at most reach the driver."""
    found = [r["b"] for r in wanted.select(bucket(key, buckets).alias("b")).distinct().collect()]
    return stored.where(F.col("bucket").isin(found) if found else F.lit(False)).drop("bucket")


def stats(poems: DataFrame) -> DataFrame:
    """One row: total_docs and avg_doc_len."""
    return poems.agg(F.count("*").alias("total_docs"), F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("avg_doc_len"))


def new_rows(batch: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """What to append under insert-or-ignore: rows of a batch whose key isn't held."""
    return batch.join(held.select(key), key, "left_anti")


def merged(held: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """What the table holds after an upsert in which the batch wins."""
    return held.join(batch.select(key), key, "left_anti").unionByName(batch)
