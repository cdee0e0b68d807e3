"""Candidate reading orders of a query: as written, reversed, and as a grid read in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.config import HAN, Profile
from lacuna.functions import text
from lacuna.functions.text import let

LEAST_COLS, MOST_COLS, USUAL_COLS = 2, 12, (5, 7, 4)


def _reading(strategy: str, places: Column, cols: Column | None = None) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), (cols if cols is not None else F.lit(None)).cast("int").alias("cols"), places.alias("source_index"))


def candidate_cols(widths: Column, total: Column) -> Column:
    """Grid widths to try, in order: the width that all lines share, divisors of the total, and the usual ones."""
    filled = F.filter(widths, lambda n: n > 0)
    first = F.get(filled, F.lit(0))
    common = F.when((F.size(filled) > 0) & (F.size(F.array_distinct(filled)) == 1) & (first >= LEAST_COLS), F.array(first)).otherwise(F.array().cast("array<int>"))
    divisors = F.filter(F.sequence(F.lit(LEAST_COLS), F.lit(MOST_COLS)), lambda c: (c <= total) & (total % c == 0))
    usual = F.filter(F.array(*[F.lit(c) for c in USUAL_COLS]), lambda c: c <= total)
    return F.array_distinct(F.concat(common, divisors, usual))


def grid(total: Column, cols: Column, right_to_left: bool) -> Column:
    """Places of a text of that length written in rows of that width and read column by column."""
    rows = F.ceil(total / cols).cast("int")
    order = F.sequence(cols - 1, F.lit(0), F.lit(-1)) if right_to_left else F.sequence(F.lit(0), cols - 1)
    return F.flatten(F.transform(order, lambda c: F.filter(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: r * cols + c), lambda p: p < total)))


def enumerate_readings(queries: DataFrame, profile: Profile = HAN, most: int | None = None) -> DataFrame:
    """queries (query_id, text) to (query_id, ord, strategy, cols, source_index, chars, reordered).

    Texts that equal an earlier reading or are empty drop out; a query has profile.all_readings of them at most."""
    forms = text.match_forms(text.visual_lines(F.col("text")), profile)
    frame = queries.select("query_id", forms.alias("forms"))
    frame = frame.withColumns({"stream": F.array_join("forms", ""), "widths": F.transform("forms", lambda x: F.length(x))}).where(F.length("stream") > 0)

    def of(offsets: Column) -> Column:
        total = F.length("stream")
        lines = F.transform(F.col("widths"), lambda w, i: F.struct(F.get(offsets, i).alias("at"), w.alias("w")))

        def run(x: Column) -> Column:
            return F.when(x["w"] > 0, F.sequence(x["at"], x["at"] + x["w"] - 1)).otherwise(F.array().cast("array<int>"))

        plain = F.sequence(F.lit(0), total - 1)
        several = F.array(_reading("line_reverse", F.flatten(F.transform(F.reverse(lines), run))), _reading("line_chars_reverse", F.flatten(F.transform(lines, lambda x: F.reverse(run(x))))))
        grids = F.flatten(F.transform(candidate_cols(F.col("widths"), total), lambda c: F.array(_reading("grid_rtl", grid(total, c, True), c), _reading("grid_ltr", grid(total, c, False), c))))
        none = F.filter(several, lambda r: F.lit(False))
        return F.concat(F.array(_reading("as_written", plain)), F.when(F.size("forms") > 1, several).otherwise(none), F.array(_reading("stream_reverse", F.reverse(plain))), grids)

    offsets = F.transform(F.sequence(F.lit(0), F.size("widths") - 1), lambda i: F.aggregate(F.slice("widths", F.lit(1), i), F.lit(0), lambda a, b: a + b))

    def spelled(characters: Column) -> Column:
        def text_of(r: Column) -> Column:
            return F.struct(r["strategy"].alias("strategy"), r["cols"].alias("cols"), r["source_index"].alias("source_index"), F.array_join(F.transform(r["source_index"], lambda p: F.get(characters, p)), "").alias("chars"))

        return F.transform(let(offsets, of), text_of)

    listed = frame.select("query_id", let(F.split("stream", ""), spelled).alias("found")).withColumn("texts", F.transform("found", lambda r: r["chars"]))
    kept = F.filter("found", lambda r, i: F.array_position("texts", r["chars"]) == i + 1)
    listed = listed.select("query_id", F.posexplode(F.slice(kept, 1, most or profile.all_readings)).alias("ord", "r"))
    return listed.select("query_id", "ord", "r.*").withColumn("reordered", F.col("strategy") != "as_written")


def span_to_source(source_index: Column, start: Column, end: Column) -> Column:
    """Half-open span of the input that a span of a reading came from; null for an empty one."""
    part = F.slice(source_index, start + 1, F.greatest(end - start, F.lit(0)))
    return F.when(F.size(part) > 0, F.struct(F.array_min(part).alias("start"), (F.array_max(part) + 1).alias("end")))
