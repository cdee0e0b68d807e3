"""Which column of a user's file holds the text to search: profiles and a suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import text

LEAST_RATIO, LEAST_FILLED, MARGIN = 0.5, 0.5, 1.5


def names_of(rows: DataFrame) -> list[str]:
    """The keys of objects in a VARIANT column `values`, in order of first appearance."""
    keyed = rows.select("row_index", F.posexplode(F.map_keys(F.from_json(F.to_json("values"), "map<string,string>"))).alias("place", "name"))
    first = keyed.groupBy("name").agg(F.min(F.struct("row_index", "place")).alias("first")).orderBy("first")
    return [r["name"] for r in first.collect()]


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows (row_index, values VARIANT) to (row_index, ord, name, value): a row for each cell, as text."""
    listed = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.try_variant_get("values", f"$['{n}']", "variant").alias("v")) for i, n in enumerate(names)]
    each = rows.select("row_index", F.explode(F.array(*listed)).alias("c")).select("row_index", "c.*")
    return each.select("row_index", "ord", "name", text.cell_text(F.col("v")).alias("value"))


def profile(filled: DataFrame) -> DataFrame:
    """(row_index, ord, name, value) to (name, ord, cjk_ratio, filled, mean_length, samples, score); samples are the first three."""
    some = F.col("value") != ""
    counted = filled.groupBy("ord", "name").agg(
        F.coalesce(F.avg(F.when(some, text.cjk_ratio(F.col("value")))), F.lit(0.0)).alias("cjk_ratio"),
        (F.count_if(some) / F.count("*")).alias("filled"),
        F.coalesce(F.avg(F.when(some, F.length("value"))), F.lit(0.0)).alias("mean_length"),
    )
    first = Window.partitionBy("ord", "name").orderBy("row_index")
    shown = filled.where(some).withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy("ord", "name").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("s"))
    score = F.col("cjk_ratio") * F.col("filled") * F.log1p("mean_length")
    samples = F.coalesce(F.transform("s", lambda x: x["value"]), F.array().cast("array<string>"))
    return counted.join(shown, ["ord", "name"], "left").select("name", "ord", "cjk_ratio", "filled", "mean_length", samples.alias("samples"), score.alias("score"))


def suggest(profiles: DataFrame) -> DataFrame:
    """One row: the column that clearly holds ideographs, or why there is none."""
    fit = profiles.where((F.col("cjk_ratio") >= LEAST_RATIO) & (F.col("filled") >= LEAST_FILLED))
    ranked = fit.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).where("n <= 2")
    best = ranked.agg(F.max(F.when(F.col("n") == 1, F.struct("score", "name"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("b"))
    reason = F.when(F.col("a").isNull(), "no_cjk").when(F.col("a.score") < F.coalesce("b", F.lit(-1.0)) * MARGIN, "ambiguous")
    return best.select(F.when(reason.isNull(), F.col("a.name")).alias("suggested"), reason.alias("abstain_reason"))
