"""Stored postings that follow their corpus, rarest-gram seeds and block-max BM25 against search without an index."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import api
from lacuna.config import HAN, LETTERS
from lacuna.functions import text
from lacuna.operators import blocks, bm25, corpus, exact, seeds
from lacuna.operators.readings import enumerate_readings
from lacuna.plans import retrieval
from lacuna.sources import segments

WORDS = ["river", "moon", "boat", "grass", "evening", "lantern", "mountain", "crane", "autumn", "frost", "willow", "gate", "snow", "harbour", "bell", "the", "of", "and"]
LICENSE = "permission is hereby granted free of charge to any person obtaining a copy"


def verse(rng):
    lines = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 25))]
    return "\n".join([*lines, LICENSE] if rng.random() < 0.4 else lines)


def corpus_of(spark, texts):
    """texts: poem_id to text."""
    rows = spark.createDataFrame([(i, f"w{i % 50}", t) for i, t in texts.items()], "poem_id bigint, work_id string, text_display string")
    poems = rows.withColumn("text_match", text.match_form(F.col("text_display"), LETTERS)).withColumn("char_count", F.length("text_match"))
    each = poems.select("poem_id", "work_id", F.posexplode(text.corpus_lines(F.col("text_display"), LETTERS)).alias("line_no", "text_display"))
    return poems, each.withColumn("text_match", text.match_form(F.col("text_display"), LETTERS)).where(F.length("text_match") > 0)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return {i: verse(rng) for i in range(120)}


@pytest.fixture(scope="module")
def queries(spark, texts):
    rng = random.Random(6)
    rows = [(i, texts[i * 7][3 : 3 + rng.randrange(14, 80)]) for i in range(12)] + [(90, LICENSE), (91, "q"), (92, ""), (93, "zzzz qqqq xxxx jjjj vvvv")]
    return spark.createDataFrame(rows, "query_id int, text string").cache()


def swept(queries):
    return exact.sweep(enumerate_readings(queries, LETTERS), LETTERS).cache()


def hit_rows(found):
    return sorted(map(tuple, found.select("query_id", "ord", "at", "win", "poem_id", "line_no", "text_display").collect()))


def scores(found):
    return sorted((r["query_id"], r["position"], r["poem_id"], r["matched_terms"], round(r["score"], 7)) for r in found.collect())


def full_scores(queries, poems, limit=50):
    """Every document of every term scored, the best by score and id."""
    from pyspark.sql import Window

    wanted, stats = bm25.terms(queries, LETTERS), corpus.stats(poems)
    met = bm25.term_hits(wanted, poems, LETTERS, true_df=True).join(wanted, "term").join(F.broadcast(stats))
    part = bm25.numbers.bm25_term(F.lit(1.0), F.col("char_count"), F.col("avg_doc_len"), bm25.numbers.idf(F.col("n"), F.col("total_docs")))
    scored = met.groupBy("query_id", "poem_id", "work_id").agg(F.count("*").alias("matched_terms"), F.round(F.sum(part), 9).alias("score"))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "poem_id")) - 1).where(F.col("position") < limit)


# Seeds


def brute_seeds(line, profile, table):
    hashes = [int(seeds.gram_hashes([line[i : i + profile.seed]], profile.seed)[0][0]) for i in range(len(line) - profile.seed + 1)]
    rank = [(int(table[h % seeds.SLOTS]), h >> 8, i) for i, h in enumerate(hashes)]
    w = corpus.stride(profile)
    return sorted({min(rank[i : i + w])[2] for i in range(len(line) - profile.min_window + 1)})


@pytest.mark.parametrize("profile", [HAN, LETTERS])
def test_seeds_against_brute_force(profile):
    rng = random.Random(1)
    table = np.frombuffer(bytes(rng.randrange(20) for _ in range(seeds.SLOTS)), dtype=np.uint8)
    lines = ["".join(rng.choices("abc\U00020000漢", k=rng.randrange(60))) for _ in range(80)] + ["", "a" * 40]
    of, place, _ = seeds.chosen(lines, profile, table)
    got = {}
    for o, p in zip(of.tolist(), place.tolist(), strict=True):
        got.setdefault(o, []).append(p)
    assert [got.get(i, []) for i in range(len(lines))] == [brute_seeds(x, profile, table) for x in lines]


def test_equal_windows_have_equal_seeds():
    rng = random.Random(2)
    table = np.frombuffer(bytes(rng.randrange(3) for _ in range(seeds.SLOTS)), dtype=np.uint8)
    lines = ["".join(rng.choices("ab", k=60)) for _ in range(200)]
    of, place, found = seeds.chosen(lines, LETTERS, table)
    stored = {(int(o), int(p)): int(s) for o, p, s in zip(of, place, found, strict=True)}
    for n, line in enumerate(lines):
        for at in range(0, 49, 7):
            _, offset, seed = seeds.chosen([line[at : at + 12]], LETTERS, table)
            assert stored[n, at + int(offset[0])] == int(seed[0])


def test_frequencies(spark):
    lines = spark.createDataFrame([("abcdefghi",)] * 40 + [("zzzzzzzzz",), (None,), ("short",)], "text_match string")
    table = seeds.frequencies(lines, LETTERS)
    slot = lambda gram: int(seeds.gram_hashes([gram], 8)[0][0]) % seeds.SLOTS
    assert len(table) == seeds.SLOTS and table[slot("abcdefgh")] == int(math.log2(41)) and table[slot("zzzzzzzz")] == int(math.log2(3)) and sum(map(bool, table)) == 3


# Segments


def test_stored_seeds_are_small(spark, texts, queries, tmp_path):
    """Of a seed its hash and the number of its line are stored, without letters, where the line is read; every line once."""
    poems, lines = corpus_of(spark, texts)
    index = segments.Segments(spark, str(tmp_path), LETTERS, kinds=("seeds",)).create(poems, lines)
    assert index.marks.columns == ["ids", "nos", "steps", "at", "segment"] and index.lines.count() == lines.count()
    plan = seeds.packed(lines, LETTERS, index.frequency)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    few = seeds.named(index.marks, seeds.chosen([LICENSE.replace(" ", "")], LETTERS, np.frombuffer(index.frequency, dtype=np.uint8))[2])
    assert 0 < few.count() < lines.count()
    assert hit_rows(exact.hits(swept(queries), None, LETTERS, index=index)) == hit_rows(exact.hits(swept(queries), lines, LETTERS))


def same_results(spark, texts, queries, index):
    poems, lines = corpus_of(spark, texts)
    windows = swept(queries)
    assert hit_rows(exact.hits(windows, None, LETTERS, index=index)) == hit_rows(exact.hits(windows, lines, LETTERS))
    assert scores(bm25.search(queries, None, LETTERS, index=index)) == scores(bm25.search(queries, poems, LETTERS))
    assert scores(blocks.search(queries, index, LETTERS, 10).best) == scores(full_scores(queries, poems, 10))


def test_postings_follow_the_corpus(spark, texts, queries, tmp_path):
    store = segments.Segments(spark, str(tmp_path), LETTERS)
    first = {i: t for i, t in texts.items() if i < 80}
    assert exact.hits(swept(queries), None, LETTERS, index=store.follow(*corpus_of(spark, first))).count() > 0

    changed = {i: (t.upper() + "\nriver moon boat grass evening" if i % 9 == 0 else t) for i, t in texts.items() if i % 10 != 3}
    with pytest.raises(segments.StaleIndex, match="changed"):
        store.read(corpus_of(spark, changed)[0])
    same_results(spark, changed, queries, store.follow(*corpus_of(spark, changed)))
    number, content = store.generation()
    assert number == 2 and len(content["segments"]) == 2 and content["hidden"] == sum(i not in changed or changed[i] != t for i, t in first.items()) and content["docs"] == len(changed)
    store.follow(*corpus_of(spark, changed))
    assert store.generation()[0] == 2  # nothing to do

    store.follow(*corpus_of(spark, texts))  # what was removed comes back
    assert store.vacuum() == 0
    store.compact()
    assert len(store.generation()[1]["segments"]) == 1 and store.generation()[1]["hidden"] == 0
    assert store.vacuum() > 0
    same_results(spark, texts, queries, store.read(corpus_of(spark, texts)[0]))


def test_much_removed_is_compacted(spark, texts, queries, tmp_path):
    store = segments.Segments(spark, str(tmp_path), LETTERS)
    store.create(*corpus_of(spark, texts))
    few = {i: t for i, t in texts.items() if i < 20}
    same_results(spark, few, queries, store.follow(*corpus_of(spark, few)))
    assert store.generation()[1]["hidden"] == 0 and store.generation()[0] == 3
    none = spark.createDataFrame([], "query_id int, text string")
    assert blocks.search(none, store.read(), LETTERS).best.count() == 0


def test_an_empty_corpus(spark, queries, tmp_path):
    store = segments.Segments(spark, str(tmp_path), LETTERS)
    empty = corpus_of(spark, {1: "x"})
    index = store.create(empty[0].limit(0), empty[1].limit(0))
    assert exact.hits(swept(queries), None, LETTERS, index=index).count() == 0
    assert blocks.search(queries, index, LETTERS).best.count() == 0


def test_other_postings_are_refused(spark, texts, tmp_path):
    some = {i: texts[i] for i in range(5)}
    store = segments.Segments(spark, str(tmp_path), LETTERS)
    with pytest.raises(segments.StaleIndex, match="no postings"):
        store.read()
    store.create(*corpus_of(spark, some))
    with pytest.raises(segments.StaleIndex, match="another profile"):
        segments.Segments(spark, str(tmp_path), HAN).read()
    with pytest.raises(segments.StaleIndex, match="changed"):
        store.read(corpus_of(spark, {i: texts[i + 1] for i in range(5)})[0])


def test_a_second_writer_of_a_generation_fails(spark, texts, tmp_path):
    store = segments.Segments(spark, str(tmp_path), LETTERS)
    store.create(*corpus_of(spark, {1: texts[1]}))
    number, content = store.generation()
    with pytest.raises(Exception, match="exist"):
        store._commit(number, content)


# Block-max


def test_blocks_that_cannot_matter_are_not_read(spark, queries, tmp_path):
    rng = random.Random(9)
    long = {i: " ".join(rng.choices(WORDS, k=rng.choice([10, 40, 200, 1500]))) for i in range(400)}
    poems, lines = corpus_of(spark, long)
    index = segments.Segments(spark, str(tmp_path), LETTERS).create(poems, lines)
    found = blocks.search(queries, index, LETTERS, 5, first=3)
    assert scores(found.best) == scores(full_scores(queries, poems, 5))
    read = {r["query_id"]: r["blocks_read"] / r["blocks"] for r in found.read.collect()}
    assert sum(read.values()) / len(read) < 0.7 and max(read.values()) <= 1


def every_score(texts, queries, limit=50):
    """All documents by all bigrams of each query, in Python."""
    forms = {i: "".join(c for c in t.lower() if c.isalpha()) for i, t in texts.items()}
    held = {i: {m[k : k + 2] for k in range(len(m) - 1)} for i, m in forms.items()}
    mean, rows = sum(map(len, forms.values())) / len(forms), []
    for q, t in queries:
        r = "".join(c for c in t.lower() if c.isalpha())
        terms = {r[k : k + 2] for k in range(len(r) - 1)}
        weight = {x: math.log(1 + (len(forms) - n + 0.5) / (n + 0.5)) for x in terms if (n := sum(x in h for h in held.values()))}
        found = [(-round(sum(weight[x] for x in terms & h) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(forms[i]) / mean)), 9), i, len(terms & h)) for i, h in held.items() if terms & h]
        rows += [(q, k, i, n, round(-s, 7)) for k, (s, i, n) in enumerate(sorted(found)[:limit])]
    return sorted(rows)


def test_all_bigrams_of_a_query_are_searched(spark, texts, tmp_path, monkeypatch):
    """A query's last words find documents, whatever passes queries come in and however many documents are hidden."""
    tail = "zyx wvu quartz"
    changed = {**texts, 500: tail, 501: f"river {tail}"}
    asked = [(1, " ".join([*WORDS, tail])), (2, tail), (3, "x"), (4, texts[3])]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    store = segments.Segments(spark, str(tmp_path), LETTERS, kinds=("blocks",))
    store.create(*corpus_of(spark, {**changed, 3: tail, 502: tail}))
    index = store.follow(*corpus_of(spark, changed))
    assert store.generation()[1]["hidden"] == 2
    want = every_score(changed, asked)
    assert scores(blocks.search(queries, index, LETTERS, every=True).best) == want
    assert {r["poem_id"] for r in blocks.search(queries, index, LETTERS, 2, every=True).best.where("query_id = 2").collect()} == {500, 501}
    monkeypatch.setattr(blocks, "QUERIES", 2)
    monkeypatch.setattr(blocks, "MOST_HIDDEN", 0)
    assert scores(blocks.search(queries, index, LETTERS, every=True).best) == want


def test_following_compares_ids_alone(spark, texts, tmp_path, monkeypatch):
    """No texts are kept or shuffled to find what is new; results are the same where ids aren't broadcast."""
    asked = [(1, texts[3]), (2, texts[50])]
    queries = spark.createDataFrame(asked, "query_id int, text string")
    stores = [segments.Segments(spark, str(tmp_path / x), LETTERS, kinds=("blocks",)) for x in ("a", "b")]
    changed = {i: (t + " quartz" if i % 9 == 0 else t) for i, t in texts.items() if i % 10 != 3}
    for store, most in zip(stores, (500_000, -1)):
        monkeypatch.setattr(segments, "BROADCAST_REMOVED", most)
        store.create(*corpus_of(spark, texts))
        monkeypatch.setattr(type(queries), "cache", lambda self: pytest.fail("texts are kept"))
        index = store.follow(*corpus_of(spark, changed))
        monkeypatch.undo()
        assert scores(blocks.search(queries, index, LETTERS, every=True).best) == every_score(changed, asked)


def test_stored_terms_have_no_cap(spark, tmp_path):
    """The best document of a term counts though 400 documents with lower ids have it, and 200 with more of the query's terms."""
    held = {**{i: "abcd " + "xyz " * 40 for i in range(450)}, 900: "ab", 901: "abq"}
    queries = spark.createDataFrame([(1, "abcd")], "query_id int, text string")
    poems, lines = corpus_of(spark, held)
    corpus.write_index(poems, lines, LETTERS, str(tmp_path), 1, ("terms",))
    index = corpus.read_index(spark, str(tmp_path), ("terms",))
    found = blocks.search(queries, index, LETTERS)
    assert scores(found.best) == every_score(held, [(1, "abcd")])
    assert index.packed.count() < 40 and set(index.works.columns) >= {"poem_id", "char_count", "work_id"}
    sql = retrieval.C.sql["bm25_stored"]
    assert "<= 400" not in sql and "<= 200" not in sql


def test_blocks_of_documents_are_rows(spark, texts, tmp_path):
    """What is shuffled and stored of a document grows with its distinct bigrams, and its id is stored once."""
    poems, lines = corpus_of(spark, texts)
    index = segments.Segments(spark, str(tmp_path), LETTERS, kinds=("blocks",)).create(poems, lines)
    ids = [i for r in index.packed.select("ids").collect() for i in r["ids"]]
    assert sorted(ids) == sorted(r["poem_id"] for r in poems.where("char_count > 1").collect())
    stored = blocks.documents(index.blocks).select("term", "poem_id", "char_count")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, corpus.term_postings(poems).select("term", "poem_id", "char_count").collect()))


# Additions


def test_added_poems_are_found(spark, tmp_path):
    night = "細草微風岸，危檣獨夜舟。\n星垂平野闊，月湧大江流。"
    raw = spark.createDataFrame([("旅夜書懷", "杜甫", night.split("\n"), "u1", "tang", "a.json")], "title string, author string, paragraphs array<string>, upstream_id string, dataset string, file string")
    who = spark.createDataFrame([("杜甫", "唐", "", "authors.json")], "name string, dynasty string, bio string, file string")
    engine = api.Engine(spark, corpus.build(raw, corpus.authors_of(who), HAN))
    over = engine.indexed(str(tmp_path / "index"))
    store = api.Additions(over, str(tmp_path / "added"))
    added = "國破山河在\n城春草木深\n感時花濺淚"
    rows = spark.createDataFrame([(0, "春望", "杜甫", added), (1, "登高", "某人", "風急天高猿嘯哀\n渚清沙白鳥飛回"), (2, "春望", "杜甫", added)], "row_index int, title string, author string, text string")
    assert [r["result"] for r in store.add(rows.where("row_index != 1")).orderBy("row_index").collect()] == ["added", "duplicate"]
    assert store.add(rows.where("row_index = 1"), "agent").first()["result"] == "added"

    asked = spark.createDataFrame([(0, "國破山河在城春草木深"), (1, "渚清沙白鳥飛回"), (2, "星垂平野闊月湧大江"), (3, "感時城春")], "query_id int, text string")
    windows = exact.sweep(enumerate_readings(asked, HAN, most=1), HAN).cache()

    def found(some):
        """Queries with a line that holds a window of theirs, and those that share a term with a poem, of additions."""
        lines = None if some.index else some.library.lines
        exact_hits = exact.hits(windows, lines, HAN, index=some.index).select("query_id", "work_id").distinct().collect()
        terms = bm25.search(asked, some.library.poems, HAN, index=some.index).where("work_id like 'added:%'").collect()
        return sorted(r["query_id"] for r in exact_hits), sorted(r["query_id"] for r in terms)

    assert found(over) == ([2], [])
    grown = store.searchable()
    assert grown.index is not None and found(grown) == found(api.replace(store, engine=engine).searchable()) == ([0, 2], [0, 3])
    assert grown.library.works.count() == 2 and grown.library.authors.count() == 1
    grown.over(engine.library)
    with pytest.raises(segments.StaleIndex):
        grown.indexed(str(tmp_path / "index"))
    pending = store.listed("pending").first()["addition_id"]
    decision = spark.createDataFrame([(pending, "accepted")], "addition_id string, decision string")
    assert store.review(decision).first()["review"] == "applied"
    store.compact()
    assert store.review(decision).first()["review"] == "not_pending"
    grown = store.searchable()
    assert found(grown) == ([0, 1, 2], [0, 1, 3]) and grown.library.authors.count() == 2 and grown.library.lines.count() == 9
    assert found(grown.over(engine.library)) == ([2], [])  # additions taken back


def test_long_lines(spark, tmp_path, monkeypatch):
    """A line's postings hold what windows can cover, not the line; lines over a piece are cut with an overlap."""
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefgh", k=30_000))
    whole = seeds.chosen([line], LETTERS, np.zeros(seeds.SLOTS, dtype=np.uint8))
    monkeypatch.setattr(seeds, "PIECE", 1_000)
    got = set()
    for rows, at, texts in seeds.pieces(["x", line, "", "abcdefghijkl"], LETTERS.min_window):
        of, place, _ = seeds.chosen(texts, LETTERS, np.zeros(seeds.SLOTS, dtype=np.uint8))
        got |= {(rows[o], at[o] + p) for o, p in zip(of.tolist(), place.tolist(), strict=True)}
    assert {p for r, p in got if r == 1} == set(whole[1].tolist()) and sum(r == 3 for r, _ in got) == 1
    poems, lines = corpus_of(spark, {1: line + "." + line[:50], 2: line[5_000:5_100]})
    index = segments.Segments(spark, str(tmp_path), LETTERS).create(poems, lines)
    assert index.seeds.agg(F.max(F.length("around"))).first()[0] <= 24
    asked = swept(spark.createDataFrame([(1, line[5_010:5_060]), (2, line[29_950:])], "query_id int, text string"))
    assert hit_rows(exact.hits(asked, None, LETTERS, index=index)) == hit_rows(exact.hits(asked, lines, LETTERS))


def test_inversions():
    import itertools
    import time

    rng = random.Random(7)
    for n in [0, 1, 2, 3, 4, 5, 8, 17, 64, 100]:
        order = rng.sample(range(1_000), n)
        assert exact.inversions(np.array(order, dtype=np.int64)) == sum(a > b for a, b in itertools.combinations(order, 2))
    many, began = np.arange(100_000)[::-1], time.monotonic()
    assert exact.inversions(many) == 100_000 * 99_999 // 2 and time.monotonic() - began < 10


def test_order_of_many_lines(spark):
    rows = [(i, 100_000 - i) for i in range(100_000)]
    frame = spark.createDataFrame([(1, rows), (2, [(a, -b) for a, b in rows]), (3, rows[:2]), (4, [])], "id int, p array<struct<at:int,line_no:int>>")
    assert {r["id"]: r["x"] for r in frame.select("id", exact.inverted(F.col("p")).alias("x")).collect()} == {1: True, 2: False, 3: False, 4: False}


# Kinds of postings and their size


def test_stored_terms_are_small(spark, texts, queries, tmp_path):
    """BM25 reads stored terms alone: an id and a length for each posting, without the work."""
    poems, lines = corpus_of(spark, texts)
    corpus.write_index(poems, lines, LETTERS, str(tmp_path), 1, ("terms",))
    assert not (tmp_path / "grams").exists()
    index = corpus.read_index(spark, str(tmp_path), ("terms",))
    assert set(index.terms.columns) == {"poem_id", "char_count", "term", "bucket"}
    assert scores(bm25.search(queries, None, LETTERS, index=index)) == scores(bm25.search(queries, poems, LETTERS))


def test_blocks_alone_are_shuffled_once(spark, texts, queries, tmp_path):
    poems, lines = corpus_of(spark, texts)
    plan = blocks.postings(poems, 8, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    store = segments.Segments(spark, str(tmp_path), LETTERS, kinds=("blocks",))
    index = store.create(poems, lines)
    assert not (tmp_path / "seeds").exists() and not (tmp_path / "lines").exists()
    assert index.blocks.select(F.explode("docs").alias("d")).select("d.*").columns == ["poem_id", "char_count"]
    assert scores(blocks.search(queries, index, LETTERS).best) == scores(full_scores(queries, poems))
    fewer, of_fewer = corpus_of(spark, {i: t for i, t in texts.items() if i % 5})
    assert scores(blocks.search(queries, store.follow(fewer, of_fewer), LETTERS).best) == scores(full_scores(queries, fewer))
    with pytest.raises(segments.StaleIndex):
        segments.Segments(spark, str(tmp_path), LETTERS).read()


def test_stored_grams_are_small(spark, texts, queries, tmp_path, monkeypatch):
    """A posting of a gram is a hash and the number of a line, whose text is stored once; broadcast or shuffled, hits are those of the lines themselves."""
    poems, lines = corpus_of(spark, texts)
    odd = [(None, "w", 0, texts[0]), (7, "w7", 0, "another line of this number " + texts[7].split("\n")[0]), (8, None, 900, "x" * 3_000)]
    more = spark.createDataFrame(odd, "poem_id bigint, work_id string, line_no int, text_display string").withColumn("text_match", text.match_form(F.col("text_display"), LETTERS))
    lines = lines.unionByName(more)
    corpus.write_index(poems, lines, LETTERS, str(tmp_path), 1, ("grams",))
    assert not (tmp_path / "terms").exists()
    index = corpus.read_index(spark, str(tmp_path), ("grams",), LETTERS)
    assert set(index.grams.columns) == {"gram", "poem_id", "line_no", "bucket"} and index.grams.schema["gram"].dataType.simpleString() == "int"
    assert spark.read.parquet(f"{tmp_path}/lines").columns == ["poem_id", "work_id", "line_no", "text_display"] and index.lines.count() == lines.count()

    def rows(found):
        return sorted(map(str, found.select("query_id", "ord", "at", "win", "poem_id", "work_id", "line_no", "text_display").collect()))

    asked = swept(queries)
    want = rows(exact.hits(asked, lines, LETTERS))
    assert any("poem_id=None" in r for r in want) and want == rows(exact.hits(asked, None, LETTERS, index=index))
    few = corpus.lines_with(corpus.postings(lines.where("poem_id = 7"), LETTERS.seed, 1), index)
    assert 0 < few.count() < lines.count()
    monkeypatch.setattr(corpus, "BROADCAST_GRAMS", -1)
    monkeypatch.setattr(corpus, "BROADCAST_LINES", -1)
    assert want == rows(exact.hits(asked, None, LETTERS, index=index))


def test_an_empty_index_of_grams(spark, texts, queries, tmp_path):
    poems, lines = corpus_of(spark, {1: texts[1]})
    corpus.write_index(poems.limit(0), lines.limit(0), LETTERS, str(tmp_path), 1, ("grams",))
    index = corpus.read_index(spark, str(tmp_path), ("grams",), LETTERS)
    assert exact.hits(swept(queries), None, LETTERS, index=index).count() == 0


def test_postings_of_other_grams_are_not_shuffled(spark, texts, queries, monkeypatch):
    """Beyond the windows that are broadcast, only lines whose grams are wanted meet them in a shuffle."""
    _, lines = corpus_of(spark, texts)
    asked = swept(queries)
    want = hit_rows(exact.hits(asked, lines, LETTERS))
    monkeypatch.setattr(exact, "BROADCAST_WINDOWS", 0)
    met = exact.touched(asked, lines, LETTERS)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "__gram" not in met.columns
    assert want and hit_rows(exact.hits(asked, lines, LETTERS)) == want
    monkeypatch.setattr(corpus, "BROADCAST_GRAMS", 0)
    assert "LeftSemi" not in exact.touched(asked, lines, LETTERS)._jdf.queryExecution().optimizedPlan().toString()
    assert hit_rows(exact.hits(asked, lines, LETTERS)) == want
