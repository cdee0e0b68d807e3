"""Exact vector search in one Arrow pass and search by product codes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import vectors

SF = "/root/testdata/sf0.001"


def brute(queries, points, limit):
    out = []
    for q, a in queries:
        if a is None:
            continue
        norm = lambda x: np.array(x) / (np.linalg.norm(x) or 1.0)
        every = sorted((-round(float(norm(a) @ norm(b)), 9), p) for p, b in points if b is not None and len(b) == len(a))
        out += [(q, p, k) for k, (_, p) in enumerate(every[:limit])]
    return sorted(out, key=str)


def rows(found):
    return sorted(((r["query_id"], r["point_id"], r["position"]) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    points = [(f"p{i:04d}", x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))]
    points += [(f"t{i}", [1.0] + [0.0] * 7) for i in range(30)] + [("none", None), ("short", [1.0, 2.0]), ("zero", [0.0] * 8)]
    queries = [("a", [1.0] + [0.0] * 7), ("b", points[5][1]), ("none", None), ("short", [2.0, 1.0]), ("zero", [0.0] * 8), ("odd", [1.0])]
    return queries, points


def frames(spark, queries, points):
    return spark.createDataFrame(queries, "query_id string, vector array<double>"), spark.createDataFrame(points, "point_id string, vector array<float>").repartition(3)


def test_exact_search(spark, table, monkeypatch):
    queries, points = table
    points = [(p, v and np.float32(v).tolist()) for p, v in points]
    assert rows(vectors.search(*frames(spark, queries, points), 20)) == brute(queries, points, 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)  # several blocks
    assert rows(vectors.search(*frames(spark, queries, points), 7)) == brute(queries, points, 7)
    none = frames(spark, [], points)
    assert vectors.search(*none, 5).count() == 0 and vectors.search(frames(spark, queries, points)[0], none[1].limit(0), 5).count() == 0


def test_codes(spark, tmp_path):
    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.col("label").alias("work_id"))
    queries = points.where("point_id % 25 = 0").select(F.col("point_id").alias("query_id"), "vector")
    made = vectors.Coded.of(points, vectors.Quantiser.trained(points, lists=16), probes=16, survivors=4)
    made.write(str(tmp_path / "coded"))
    coded = vectors.Coded.read(spark, str(tmp_path / "coded"), probes=16, survivors=4)
    assert coded.points.count() == points.count() and coded.points.select(F.max(F.length("code"))).first()[0] == 16
    true = {(q, p) for q, p, _ in rows(vectors.search(queries, points, 10))}
    found, read = coded.search(queries, 10)
    got = found.collect()
    assert len({(r["query_id"], r["point_id"]) for r in got} & true) >= 0.9 * len(true)
    exact = {(r["query_id"], r["point_id"]): r["score"] for r in vectors.search(queries, points, 500).collect()}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["point_id"]], abs=1e-8) for r in got)  # survivors are scored exactly
    assert all(r["bytes_read"] <= 0.2 * r["bytes_all"] for r in read.collect()) and read.count() == queries.count()
    fewer = vectors.Coded.read(spark, str(tmp_path / "coded"), probes=2, survivors=4).search(queries, 10)[1]
    assert fewer.agg(F.max("bytes_read")).first()[0] < read.agg(F.min("bytes_read")).first()[0]


def test_codes_of_all_lists_and_survivors_are_exact(spark, table):
    queries, points = table
    points = [(p, v and np.float32(v).tolist()) for p, v in points if p != "short"]
    asked, held = frames(spark, queries, points)
    coded = vectors.Coded.of(held, vectors.Quantiser.trained(held, lists=4, parts=4), probes=4, survivors=100, share=1.0)
    wanted = [q for q in queries if q[0] in ("a", "b", "zero")]
    assert rows(coded.search(asked, 10)[0]) == brute(wanted, points, 10)


def test_codes_of_nothing(spark, table):
    asked, held = frames(spark, table[0], table[1])
    none = vectors.Coded.of(held.limit(0), vectors.Quantiser.trained(held.limit(0)))
    found, read = none.search(asked, 5)
    assert found.count() == 0 and read.count() == 0
