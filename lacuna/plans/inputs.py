"""What the catalogue's queries read: driver tables in the roles of a corpus, and small inline tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.config import LETTERS
from lacuna.functions import keys, text

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, each with its SQL counterpart where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """The frame on all cores: a table of fewer splits than cores is small, and is dealt out anew."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


class Inline:
    """A small table that both engines can read: kinds are SQL types known to either."""

    def __init__(self, kinds: dict[str, str], *rows: tuple) -> None:
        self.kinds, self.rows = kinds, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join(f"{k} {v.replace('varchar', 'string')}" for k, v in self.kinds.items())
        return spark.createDataFrame(list(self.rows), schema)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(f"cast({literal(v)} as {k})" for v, k in zip(r, self.kinds.values())) + ")" for r in self.rows)
        return f"(select * from (values {values}) as t({', '.join(self.kinds)}))"


#: What a text needs for a match form that isn't empty: found in its first letters, while a condition on the form would make the form anew.
LETTER = r"\p{L}"


def poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as poems."""
    return poems_of(spread(table(spark, sf_dir, "documents")))


def poems_of(documents: DataFrame) -> DataFrame:
    """A text is a work of its language, so copies are editions of one."""
    formed = documents.where(F.col("text").rlike(LETTER)).withColumn("text_match", text.match_form(F.col("text"), LETTERS))
    return formed.select(F.col("doc_id").alias("poem_id"), keys.work_key(F.col("lang"), F.lit(""), F.col("text_match")).alias("work_id"), F.col("lang").alias("dataset"), F.col("source").alias("edition"), F.col("text").alias("text_display"), "text_match", F.length("text_match").alias("char_count"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of documents."""
    return lines_of(poems(spark, sf_dir))


def lines_of(poems: DataFrame) -> DataFrame:
    each = poems.select("poem_id", "work_id", F.posexplode(text.corpus_lines(F.col("text_display"), LETTERS)).alias("line_no", "text_display"))
    return each.where(F.col("text_display").rlike(LETTER)).withColumn("text_match", text.match_form(F.col("text_display"), LETTERS))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Ideographs in place of letters, so that the tables hold texts in Han as well.
LATIN, IN_HAN = "abcdefghijklmnopqrstuvwxyz", "細草微風岸危檣獨夜舟星垂平野闊月湧大江流名豈文章著官"
HAN_OF = f"translate(lower({{0}}), '{LATIN}', '{IN_HAN}')"


def in_han(column: Column) -> Column:
    return F.translate(F.lower(column), LATIN, IN_HAN)


class WithTable:
    """An inline table together with rows that are made from a driver table: `sql` and `made` say the same."""

    def __init__(self, inline: Inline, sql: str, made: Query) -> None:
        self.inline, self.made, self.sql = inline, made, f"({inline.sql[1:-1]} union all {sql})"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        made = self.made(spark, sf_dir)
        return self.inline.frame(spark).unionByName(made)


# Shared pieces of the SQL counterparts.
MATCH = r"lower(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
POEMS_SQL = f"""
poem as (
  select doc_id as poem_id, substr(sha256(coalesce(lang, '') || '||' || m), 1, 32) as work_id, lang, source, text, m, length(m) as char_count
  from (select *, {MATCH.format("text")} as m from documents) where length(m) > 0
)"""
LINES_SQL = (
    POEMS_SQL
    + f""", line as (
  select poem_id, work_id, line_no, text_display, {MATCH.format("text_display")} as m from (
    select poem_id, work_id, unnest(parts) as text_display, generate_subscripts(parts, 1) - 1 as line_no from (
      select poem_id, work_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n.!?;]'), lambda x: trim(x)), lambda x: x <> '') as parts from poem))
)"""
)
QUERY_SQL = f"query as (select item_id as query_id, text, {MATCH.format('text')} as r from benchmark)"
