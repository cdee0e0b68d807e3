"""Scores, estimates, costs and order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def rounded(x: Column, places: int = 3) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def idf(df: Column, total: Column) -> Column:
    return F.log(1 + (total - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_term(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    """One term's part of BM25; an average of 0 counts as a ratio of 1, and so does a denominator of 0."""
    ratio = F.when(average > 0, length / average).otherwise(F.lit(1.0))
    below = tf + K1 * (1 - B + B * ratio)
    return weight * tf * (K1 + 1) / F.when(below == 0, F.lit(1.0)).otherwise(below)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def token_cost(tokens_in: Column, tokens_out: Column, cached: Column, rate_in: Column, rate_out: Column, rate_cached: Column) -> Column:
    """USD; null where the usage or the price isn't known. Cached tokens are within those of the input."""
    held = F.least(F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0)), tokens_in)
    return (tokens_in - held) / 1e6 * rate_in + held / 1e6 * F.coalesce(rate_cached, rate_in) + tokens_out / 1e6 * rate_out


# What a row costs without and with an agent, how many rows need one, and rows in flight.
ROW_SECONDS, AGENT_SECONDS, AGENT_RATE, IN_FLIGHT = 0.75, 45.0, 0.3, 4


def estimate(rows: Column, agent: Column, rate: Column | None = None, in_flight: Column | None = None) -> Column:
    """struct(rows, agent_rows, seconds) for a batch."""
    n = F.greatest(F.lit(0), rows.cast("bigint"))
    share = F.when(agent, clamped(F.coalesce(rate if rate is not None else F.lit(None).cast("double"), F.lit(AGENT_RATE)))).otherwise(F.lit(0.0))
    lanes = F.greatest(F.lit(1), F.coalesce(in_flight if in_flight is not None else F.lit(None).cast("int"), F.lit(IN_FLIGHT)))
    asked = F.ceil(n * share)
    seconds = F.floor((n * F.lit(ROW_SECONDS) + asked * F.lit(AGENT_SECONDS)) / lanes + F.lit(0.5))
    return F.struct(n.alias("rows"), asked.alias("agent_rows"), seconds.cast("bigint").alias("seconds"))


def human_seconds(seconds: Column) -> Column:
    """struct(value, unit)."""
    def of(value: Column, unit: str) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"))

    return (
        F.when(seconds < 90, of(rounded(seconds, 0), "second"))
        .when(seconds < 5400, of(rounded(seconds / 60, 1), "minute"))
        .when(seconds < 172800, of(rounded(seconds / 3600, 1), "hour"))
        .otherwise(of(rounded(seconds / 86400, 1), "day"))
    )


def iso_milliseconds(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_percentile(values: Column, share: float) -> Column:
    """The value at floor(n * share) of the sorted values, the last at most. values: an aggregate of a column."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(share)).cast("int")))


def upper_median(values: Column) -> Column:
    return floor_percentile(values, 0.5)
