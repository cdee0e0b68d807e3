"""Conversion by phrases against a brute-force longest match, and in a corpus."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lacuna.config import HAN
from lacuna.functions import script, text
from lacuna.functions.script import Script
from lacuna.operators import corpus, exact

TABLE = {"头": "頭", "发": "發", "头发": "頭髮", "白发": "白髮", "白发三千丈": "白髮三千丈", "缘": "緣", "个": "個", "台风": "颱風"}


def brute(given, table):
    out, places, i = "", [], 0
    while i < len(given):
        entry = max((e for e in table if given.startswith(e, i)), key=len, default=None)
        new = given[i] if entry is None else table[entry]
        size = len(entry or "x")
        out, places, i = out + new, places + [i + min(j, size - 1) for j in range(len(new))], i + size
    return out, places


def test_longest_match(monkeypatch):
    pick = random.Random(1)
    for _ in range(300):
        monkeypatch.setattr(script, "BLOCK", pick.choice([1, 30, 1 << 20]))
        letters = "ab\U00020000c"[: pick.randint(1, 4)]

        def word(n):
            return "".join(pick.choice(letters) for _ in range(n))

        table = {word(pick.randint(1, 5)): word(pick.randint(0, 4)) for _ in range(pick.randint(0, 8))}
        texts = [pick.choice([None, "", word(pick.randint(1, 30))]) for _ in range(pick.randint(0, 6))]
        got = [x and (x[0], list(x[1])) for x in Script(table).convert(texts)]
        assert got == [None if t is None else brute(t, table) for t in texts]


def test_columns(spark):
    texts = ["白发三千丈，缘愁似个长", "头发白", "", None, "发头发发"]
    rows = spark.createDataFrame([(i, t, [t, "发", None] if i % 2 else [] if i else None) for i, t in enumerate(texts)], "id int, t string, all array<string>").repartition(2)
    s = Script(TABLE)
    got = {r["id"]: r for r in rows.select("id", s.converted(F.col("t")).alias("c"), s.all_converted(F.col("all")).alias("all"), s.placed(F.col("t")).alias("p")).collect()}
    want = [None if t is None else brute(t, TABLE) for t in texts]
    for i, t in enumerate(texts):
        assert got[i]["c"] == (want[i] and want[i][0])
        assert got[i]["all"] == ([want[i] and want[i][0], "發", None] if i % 2 else [] if i else None)
        assert t is None or (got[i]["p"]["text"], got[i]["p"]["places"]) == want[i]


def test_tables(tmp_path):
    a, b = tmp_path / "phrases.txt", tmp_path / "characters.txt"
    a.write_text("# phrases\n头发\t頭髮\n发\t髮\n", encoding="utf-8")
    b.write_text("发\t發 髮\r\n头\t頭\n\nno tab\n删\t\n", encoding="utf-8")
    assert Script.load(str(a), str(b)) == Script({"头发": "頭髮", "发": "髮", "头": "頭", "删": ""})
    assert Script(TABLE) != Script({}) and list(Script({}).convert(["头"]))[0][0] == "头"
    with pytest.raises(ValueError):
        Script({"": "x"})


def test_places_in_the_display_form(spark):
    """Characters that grow and vanish: places lead back to the given text."""
    han = replace(HAN, script=Script({"台风": "大颱風", "的": "", "里": "裏"}))
    rows = spark.createDataFrame([("a台风，的里b",)], "t string").select(text.match_form(F.col("t"), han).alias("m"), text.match_to_display(F.col("t"), han).alias("p"))
    assert tuple(rows.first()) == ("大颱風裏", [1, 2, 2, 5])


def test_a_corpus_with_phrases(spark):
    """A line that characters alone convert wrongly is found in either script."""
    han = replace(HAN, script=Script(TABLE))
    raw = spark.createDataFrame([("秋浦歌", "李白", ["白髮三千丈，緣愁似個長。", "不知明鏡裏，何處得秋霜。"], "1", "t", "f")], "title string, author string, paragraphs array<string>, upstream_id string, dataset string, file string")
    authors = corpus.authors_of(raw.select(F.col("author").alias("name"), F.lit(None).cast("string").alias("dynasty"), F.lit(None).cast("string").alias("bio"), "file"), han)
    queries = spark.createDataFrame([(1, "白发三千丈"), (2, "丈千三发白\n长个似愁缘")], "query_id int, text string")
    found = {}
    for profile in (HAN, han):
        outcome, _ = exact.search(queries, corpus.build(raw, authors, profile).lines, profile)
        found[profile is han] = {r["query_id"]: r["kind"] for r in outcome.collect()}
    assert found[True][1] == "full" and found[False][1] == "none" and found[True][2] == "none"


def test_places_of_a_block_at_a_time(spark, monkeypatch):
    """place() gives what placed() gives, and hands on one block of texts after another, however many Arrow hands over."""
    import pyarrow as pa

    table = Script({"ab": "xyz", "c": "", "風": "风"})
    texts = ["abc" * 40, None, "", "風ab", "cc", *["a" * (n % 30) for n in range(200)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    want = {r["k"]: (r["s"]["text"], r["s"]["places"]) for r in frame.select("k", table.placed(F.col("text")).alias("s")).collect()}
    assert {r["k"]: (r["text"], r["places"]) for r in table.place(frame).collect()} == want
    monkeypatch.setattr(script, "BLOCK", 64)
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    blocks = list(table._placed([batch], ["k"], "text"))
    assert len(blocks) > 10 and all(sum(len(texts[k] or "") for k in b["k"].to_pylist()) <= 64 for b in blocks[1:])
    assert {r["k"]: (r["text"], r["places"]) for b in blocks for r in b.to_pylist()} == want
