"""JSONL: rows numbered over lines that aren't blank; malformed lines stay as rows with an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n").withColumn("value", F.trim(F.regexp_replace("value", "^\\x{FEFF}|\\r$", "")))
    return lines.where("value != ''")


def read(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(row_index, raw, values VARIANT, parse_error): an object a line, else null values and the reason.

    zipWithIndex numbers lines in file order without moving them; it counts the lines of each partition first."""
    numbered = _lines(spark, path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    rows = spark.createDataFrame(numbered, T.StructType([T.StructField("row_index", T.LongType()), T.StructField("raw", T.StringType())]))
    if limit is not None:
        rows = rows.where(F.col("row_index") < limit)
    parsed = rows.withColumn("values", F.try_parse_json("raw"))
    is_object = F.coalesce(F.schema_of_variant("values").startswith("OBJECT"), F.lit(False))
    error = F.when(F.col("values").isNull(), "not valid JSON").when(~is_object, "not a JSON object")
    return parsed.select("row_index", "raw", F.when(is_object, F.col("values")).alias("values"), error.alias("parse_error"))


def count(spark: SparkSession, path: str) -> int:
    """Rows, without parsing them."""
    return _lines(spark, path).count()


def write(rows: DataFrame, path: str, original: str = "raw", result: str = "result", key: str = "han") -> None:
    """Each original object with the result as one more key, nulls included. rows are written in order of row_index."""
    fields = F.from_json(F.col(original), "map<string,string>")
    plain = F.try_parse_json(original).isNotNull()
    body = F.when(plain & (F.size(fields) > 0), F.concat(F.regexp_replace(F.col(original), r"\s*\}\s*$", ""), F.lit(f', "{key}": '), F.to_json(result, {"ignoreNullFields": "false"}), F.lit("}")))
    alone = F.concat(F.lit(f'{{"{key}": '), F.to_json(result, {"ignoreNullFields": "false"}), F.lit("}"))
    rows.repartitionByRange("row_index").sortWithinPartitions("row_index").select(F.coalesce(body, alone).alias("value")).write.text(path)
