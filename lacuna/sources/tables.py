"""Tables of the engine as Parquet: insert-or-ignore, upsert, append-only logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import corpus, events


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(place)


def insert_or_ignore(batch: DataFrame, path: str, key: str, *order: str) -> int:
    """Append rows whose key isn't held; of rows with the same key in the batch the last in order counts. How many were new."""
    spark = batch.sparkSession
    rows = corpus.last_by(batch, key, *[F.col(o) for o in order or (key,)])
    if exists(spark, path):
        rows = corpus.new_rows(rows, spark.read.parquet(path), key)
    rows = rows.cache()
    n = rows.count()
    if n or not exists(spark, path):
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def upsert(batch: DataFrame, folder: str, key: str) -> int:
    """Write the next version of a table in which the batch wins; the version number. Readers take the highest that is complete."""
    spark = batch.sparkSession
    held = latest_version(spark, folder)
    merged = corpus.merged(spark.read.parquet(f"{folder}/v{held}"), batch, key) if held else batch
    merged.write.parquet(f"{folder}/v{held + 1}")
    return held + 1


def replace(frame: DataFrame, folder: str) -> int:
    """Write the next version of a table whole; the version number."""
    held = latest_version(frame.sparkSession, folder)
    frame.write.parquet(f"{folder}/v{held + 1}")
    return held + 1


def latest_version(spark: SparkSession, folder: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not fs.exists(place):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))), default=0)


def ranked_results(outcomes: DataFrame) -> DataFrame:
    """(run_id, evidence array) to (run_id, rank, evidence): rank from 1."""
    return outcomes.select("run_id", F.posexplode("evidence").alias("rank", "evidence")).withColumn("rank", F.col("rank") + 1)


def finalised(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Runs with what their log says: cost, flags, whether they ended."""
    folded = events.fold_runs(log).select("run_id", F.col("flags").alias("final_flags"), F.col("total_cost_usd").alias("cost_usd"), "finished")
    return runs.drop("final_flags", "cost_usd", "finished").join(folded, "run_id", "left")


def write_prosody(tone: DataFrame, rhyme: DataFrame, folder: str) -> None:
    """The tone table (ch, ping, ze) and the rhyme groups (ch, group_id) as the next version of each."""
    replace(tone.select("ch", "ping", "ze"), f"{folder}/tone")
    replace(rhyme.select("ch", "group_id"), f"{folder}/rhyme")


def read_prosody(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The last versions of both tables; empty ones where nothing was written."""
    out = []
    for name, schema in (("tone", "ch string, ping bigint, ze bigint"), ("rhyme", "ch string, group_id string")):
        version = latest_version(spark, f"{folder}/{name}")
        out.append(spark.read.schema(schema).parquet(f"{folder}/{name}/v{version}") if version else spark.createDataFrame([], schema))
    return out[0], out[1]


def report(frame: DataFrame, path: str) -> None:
    """A report as JSON lines in one file: for summaries of a few rows."""
    frame.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
