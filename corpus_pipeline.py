"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

Toxicity drops what the classifier rejects; the n-gram Jaccard join keeps one document of each group; decontamination
drops documents that hold a benchmark item; mixing repeats or leaves out documents to meet the sources' targets, in order of
training position; sharding stores what is left and says where each document lies. All stages but the last return the
columns of documents.

Mixing takes whole documents: one whose last copy would be cut is taken in full. Rows that share an id are placed
alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontam, jaccard, mixing, sharding, toxicity
from lacuna.llm.queries import remainder, table
from lacuna.llm.storage import keep, shared_folder

BROADCAST_ROWS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    own = docs.withColumnRenamed("toxicity", "__toxicity")  # a column of that name stays what it was
    kept = toxicity.score(own, model).where(F.col("toxicity") < toxicity.Settings().threshold)
    return kept.drop("toxicity").withColumnRenamed("__toxicity", "toxicity").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).where(F.size("placements") > 0)
    placed = keep(mixed.groupBy(F.col("doc_id").alias("__of")).agg(F.max("placements").alias("__placements")), "pipeline-placements")
    placed = F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed
    rows = docs.join(placed, F.col("doc_id").eqNullSafe(F.col("__of"))).select(*docs.columns, F.explode("__placements").alias("__placement"))
    by = [F.col("__placement.position"), F.col("doc_id"), F.col("__placement.copy")]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*docs.columns)


def store_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}").assignment()


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", store_shards),
]

#: The classifier of the first stage can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
