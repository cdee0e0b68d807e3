"""Every query of the catalogue against its SQL counterpart on the smallest tables."""

import importlib
import re

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def signed(seed, value, width):
    """Spark's chained xxhash64 of a long and then an int, by the reference implementation."""
    first = xxhash.xxh64_intdigest(seed.to_bytes(8, "little", signed=True), 42)
    return int.from_bytes(xxhash.xxh64_digest(value.to_bytes(width, "little"), first), "big", signed=True)


def brute_damage(lines, kind, seed):
    chance = lambda value: signed(seed, value, 4) % 1_000_003 / 1_000_003
    stream = "".join(lines)
    if kind == "window":
        start = int(chance(1) * max(len(lines) - 1, 1))
        return "\n".join(lines[start : start + 2])
    if kind == "line_reverse":
        return "\n".join(lines[::-1])
    if kind == "grid_transpose":
        cols = max(len(lines), 1)
        rows = -(-len(stream) // cols)
        down = ["".join(stream[c * rows + r : c * rows + r + 1] for c in reversed(range(cols))) for r in range(max(rows, 1))]
        return "\n".join(x for x in down if x)
    if kind == "char_drop":
        return "\n".join(x if len(x) < 3 else x[: (at := int(chance(i) * len(x)))] + x[at + 1 :] for i, x in enumerate(lines))
    return "\n".join(stream if kind == "one_per_line" else lines)


def test_damage_against_brute_force(spark):
    from lacuna.config import LETTERS
    from lacuna.functions import text

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    split = {i: [x for x in map(str.strip, re.split(r"[\n.!?;]", t)) if x] for i, t in texts.items()}
    got = entry.queries()["eval_damage"](spark, SF).collect()
    assert len(got) >= 7 * 190
    for r in got:
        lines = split[r["work_id"]]
        assert r["query"] == brute_damage(lines, r["damage"], r["work_id"]), (r["work_id"], r["damage"])
    assert text and LETTERS


def test_simplified_damage(spark):
    from lacuna.operators import evaluate

    works = spark.createDataFrame([(1, ["風岸", "獨舟"])], "work_id bigint, lines array<string>")
    assert {r["damage"]: r["query"] for r in evaluate.cases(works).collect()}["simplified"] == "风岸\n独舟"


def test_grid_of_a_long_text(spark):
    """Letters are taken by place from one array: a text of 60,000 letters in 5,000 lines takes seconds."""
    import random
    import time

    from lacuna.operators import evaluate

    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefgh風岸", k=rng.randrange(1, 24))) for _ in range(5000)]
    cases = {"long": lines, "one": ["風"], "none": [], "blank": ["", "a"]}
    works = spark.createDataFrame(list(cases.items()), "work_id string, lines array<string>").select("*", F.lit("grid_transpose").alias("damage"))
    began = time.time()
    got = {r["work_id"]: r["q"] for r in works.select("work_id", evaluate.damaged(F.col("lines"), F.col("damage"), F.col("work_id")).alias("q")).collect()}
    assert time.time() - began < 30
    assert got == {k: brute_damage(v, "grid_transpose", 0) for k, v in cases.items()}


def test_nothing_is_left_without_a_test():
    """Queries without SQL have a brute-force test of their own."""
    assert set(entry.catalogue.QUERIES) - set(entry.catalogue.SQL) == {"eval_damage"}


def test_entry(spark):
    assert entry.entry(spark).count() == 40


def test_no_nested_loops(spark):
    """Windows and terms meet the corpus through equi-joins."""
    for name in ("exact_hits", "bm25_df"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
