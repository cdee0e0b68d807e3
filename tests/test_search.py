import pytest
from pyspark.sql import functions as F

from lacuna.config import HAN
from lacuna.operators import corpus, exact, fusion, hybrid, readings, vectors

GRID = "地何病著名涌平夜岸細\n一所休官章江野舟危草\n沙似老應文大闊星檣微\n鷗天飄飄豈流月垂獨風"
REVERSED = "話涕霑巾\n諫丹墀有故人向來論社稷爲\n猶戀主久客羨歸秦黃閣長司\n羣盜至今在先朝赤子存君王"
REORDERED = "自下寒煙 卧松高 白鶴眠 語来江色暮 獨 尋古道 倚石聽流泉 花暖青牛 羣峭碧摩天 逍遥不記年 撥雲"
NIGHT = "細草微風岸，危檣獨夜舟。星垂平野闊，月湧大江流。名豈文章著，官應老病休。飄飄何所似，天地一沙鷗。"
SEEKING = "羣峭碧摩天，逍遙不記年。撥雲尋古道，倚石聽流泉。花暖青牛臥，松高白鶴眠。語來江色暮，獨自下寒煙。"


@pytest.fixture(scope="module")
def library(spark):
    raw = spark.createDataFrame(
        [("旅夜書懷", "杜甫", [NIGHT], "1", "tang", "a.json"), ("尋雍尊師隱居", "李白", [SEEKING], "2", "tang", "a.json"), ("登鸛雀樓", "無名", ["白日依山盡，黃河入海流。"], "3", "tang", "b.json"), ("空", "x", ["..."], "4", "tang", "b.json")],
        "title string, author string, paragraphs array<string>, upstream_id string, dataset string, file string",
    )
    authors = corpus.authors_of(spark.createDataFrame([("杜甫", "唐", None, "a"), ("杜甫", "宋", None, "b"), ("李白", "唐", "bio", "a")], "name string, dynasty string, bio string, file string"))
    return corpus.build(raw, authors, HAN)


def test_build(library):
    assert library.poems.count() == 3 and library.works.count() == 3
    assert library.lines.count() == 8 + 8 + 2
    du = library.poems.join(library.authors, "author_id").where("title = '旅夜書懷'").first()
    assert du["dynasty"] == "唐" and du["char_count"] == 40 and du["line_count"] == 8
    assert library.poems.where("author_id is null").count() == 1


def found(spark, library, *texts):
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    outcome, _ = exact.search(queries, library.lines, HAN)
    return [r.asDict(True) for r in outcome.orderBy("query_id").collect()]


def test_exact(spark, library):
    clean, nonsense, grid, back, shuffled, empty = (found(spark, library, "撥雲尋古道", "龘龘龘龘龘龘龘龘", GRID, "何所似 飄飄\n野闊 星垂平", REORDERED, "  ") + [None])[:6]
    assert clean["kind"] == "full" and clean["flags"] == ["exact_full_match"] and clean["strategy"] == "as_written"
    assert nonsense["kind"] == "none" and nonsense["flags"] == [] and nonsense["work_ids"] == []
    assert grid["kind"] == "full" and grid["strategy"] == "grid_rtl" and grid["cols"] == 10 and "input_reordered" in grid["flags"]
    assert shuffled["kind"] == "full" and "input_reordered" in shuffled["flags"]
    assert empty is None


def test_readings(spark):
    queries = spark.createDataFrame([(0, GRID), (1, REVERSED), (2, "水\n秋\n無\n淨\n泥\n春\n花\n開\n落\n自"), (3, "客\n莫\n基\n東\n幹\n觀\n歎\n執\n軍\n成\n名\n木"), (4, "")], "query_id int, text string")
    rows = readings.enumerate_readings(queries, HAN).collect()
    of = lambda q, s: [r for r in rows if r["query_id"] == q and r["strategy"] == s]
    assert of(0, "grid_rtl")[0]["cols"] == 10
    grid = next(r for r in of(0, "grid_rtl") if r["cols"] == 10)
    assert grid["chars"].startswith("細草微風岸") and grid["source_index"][:2] == [9, 19]
    assert of(1, "line_reverse")[0]["chars"] == "群盜至今在先朝赤子存君王猶戀主久客羨歸秦黃閣長司諫丹墀有故人向來論社稷為話涕霑巾"
    assert of(2, "as_written")[0]["chars"] == "水秋無淨泥春花開落自"
    assert any(r["chars"] == "自落開花春泥淨無秋水" for r in rows if r["query_id"] == 2)
    assert {3, 4} <= {r["cols"] for r in of(3, "grid_rtl")}
    assert not [r for r in rows if r["query_id"] == 4]
    for q in range(4):
        own = [r["chars"] for r in rows if r["query_id"] == q]
        assert len(own) == len(set(own)) <= HAN.all_readings
    span = spark.createDataFrame([(grid["source_index"],)], "i array<int>").select(readings.span_to_source(F.col("i"), F.lit(0), F.lit(1)).alias("s")).first()["s"]
    assert (span["start"], span["end"]) == (9, 10)


@pytest.mark.parametrize(
    "pairs, expected",
    [([(0, 5), (4, 3), (8, 1)], True), ([(0, 1), (4, 2), (8, 3)], False), ([(0, 2), (4, 1)], False), ([(0, 1), (4, 3), (8, 2), (9, 4)], False), ([(0, 4), (1, 3), (2, 2), (3, 1)], True), ([(0, 1), (2, 1), (4, 2), (9, 0)], True)],
)
def test_order(spark, pairs, expected):
    frame = spark.createDataFrame([(pairs,)], "p array<struct<at:int,line_no:int>>")
    assert frame.select(exact.inverted(F.col("p")).alias("x")).first()["x"] is expected


def test_hybrid(spark, library):
    queries = spark.createDataFrame([(0, "撥雲尋古道"), (1, "天地沙鷗"), (2, "龘龘龘龘"), (3, "黃河入海")], "query_id int, text string")
    result = hybrid.search(queries, library.poems, library.lines, HAN, scorer=hybrid.lexical_scorer)
    by = {r["query_id"]: r for r in result.outcomes.collect()}
    assert by[0]["status"] == "has_result" and by[0]["confidence"] == 1.0
    assert by[1]["status"] == "low_confidence"
    assert by[2]["status"] == "no_result"
    reports = {(r["query_id"], r["source"]): r["status"] for r in result.reports.collect()}
    assert reports[(0, "bm25")] == "skipped" and reports[(1, "vector")] == "unavailable" and reports[(2, "exact")] == "no_result" and reports[(2, "reranker")] == "skipped"
    without = hybrid.search(queries, library.poems, library.lines, HAN)
    assert {r["query_id"]: r["confidence"] for r in without.outcomes.collect()}[1] == 0.3


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, "a", 0, "x"), (1, 0, "a", 1, "y"), (1, 1, "b", 0, "y"), (1, 1, "b", 1, "z"), (1, 1, "b", 2, "z")], "query_id int, list_ord int, source string, position int, work_id string")
    rows = fusion.fuse(lists).orderBy("fused_position").collect()
    assert [r["work_id"] for r in rows] == ["y", "z", "x"]
    assert rows[0]["ranks"] == {"a": 2, "b": 1} and rows[0]["agreement"] == 2
    assert rows[1]["ranks"] == {"b": 3}
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    named = lists.withColumns({"title": F.when(F.col("source") == "b", F.lit("t")), "metadata": F.create_map(F.col("source"), F.lit("1"))})
    merged = {r["work_id"]: r for r in fusion.first_of(named, ["title"]).collect()}
    assert merged["y"]["title"] is None and merged["y"]["metadata"] == {"a": "1", "b": "1"} and merged["z"]["title"] == "t"


def test_vectors(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "point_id int, vector array<float>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, vector array<float>")
    assert [r["point_id"] for r in vectors.search(queries, points, 2).orderBy("position").collect()] == [1, 3]
    meta = {"model_id": "m", "dim": 2, "normalized": True, "conversion": "c"}
    vectors.assert_model(meta, dict(meta))
    with pytest.raises(vectors.CorpusNotIngested):
        vectors.assert_model(None, meta)
    with pytest.raises(vectors.ModelMismatch, match="dim"):
        vectors.assert_model(meta, meta | {"dim": 3})


def test_bm25_by_hand(spark, library):
    from lacuna.operators import bm25

    queries = spark.createDataFrame([(0, "天地沙")], "query_id int, text string")
    rows = bm25.search(queries, library.poems, HAN).collect()
    assert len(rows) == 1 and rows[0]["matched_terms"] == 1
    import math

    average = (40 + 40 + 10) / 3
    weight = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert rows[0]["score"] == pytest.approx(weight * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 40 / average)), abs=1e-6)


def brute_readings(text, profile):
    """(strategy, cols, places, characters) of a text, by hand."""
    forms = ["".join(c for c in x if "\u4e00" <= c <= "\u9fff") for x in text.split()]
    stream, at, runs = "".join(forms), 0, []
    for f in forms:
        runs.append(list(range(at, at + len(f))))
        at += len(f)
    total = len(stream)
    if not total:
        return []
    out = [("as_written", None, list(range(total)))]
    if len(forms) > 1:
        out += [("line_reverse", None, [p for run in reversed(runs) for p in run]), ("line_chars_reverse", None, [p for run in runs for p in reversed(run)])]
    out.append(("stream_reverse", None, list(reversed(range(total)))))
    widths = [len(f) for f in forms if f]
    cols = ([widths[0]] if len(set(widths)) == 1 and widths[0] >= 2 else []) + [c for c in range(2, 13) if c <= total and total % c == 0] + [c for c in (5, 7, 4) if c <= total]
    for c in dict.fromkeys(cols):
        columns = [[r * c + k for r in range(-(-total // c)) if r * c + k < total] for k in range(c)]
        out += [("grid_rtl", c, [p for col in reversed(columns) for p in col]), ("grid_ltr", c, [p for col in columns for p in col])]
    seen, kept = set(), []
    for strategy, c, places in out:
        chars = "".join(stream[p] for p in places)
        if chars not in seen:
            seen.add(chars)
            kept.append((strategy, c, places, chars))
    return kept[: profile.all_readings]


def brute_search(text, lines, profile):
    """(kind, strategy, longest_run) by looking for every window of every reading in every line."""
    best, decided = None, False
    for ord_, (strategy, _, _, chars) in enumerate(brute_readings(text, profile)[: profile.max_readings]):
        if ord_ and decided:
            break
        windows = list(dict.fromkeys(chars[i : i + n] for n in range(min(len(chars), profile.max_window), profile.min_window - 1, -1) for i in range(len(chars) - n + 1)))[: profile.max_windows]
        works = {}
        for w in windows:
            for work, line in lines:
                if w in line:
                    works.setdefault(work, set()).add(w)
        if works:
            top = max((max(map(len, found)), len(found)) for found in works.values())
            n = sum((max(map(len, found)), len(found)) == top for found in works.values())
            decided = decided or (not ord_ and top[0] >= profile.decisive and n == 1)
            if best is None or top[0] > best[0]:
                best = (top[0], top[1], n, strategy)
    if best is None:
        return "none", None, 0
    kind = ("full" if best[2] == 1 else "ambiguous") if best[0] >= profile.decisive else "partial" if best[1] >= 2 else "none"
    return kind, best[3], best[0]


def test_all_readings_against_brute_force(spark):
    import random

    rng = random.Random(7)
    poems = {f"w{k}": ["".join(rng.choices("細草微風岸危檣獨夜舟星垂平野闊月湧大江流名豈文章著官應老病休飄何所似天地一沙鷗", k=n)) for _ in range(6)] for k, n in enumerate((5, 7, 5, 7, 6))}
    poems["w9"] = poems["w0"][:3]
    lines = [(w, x) for w, own in poems.items() for x in own]
    asked = []
    for own in list(poems.values())[:5]:
        stream = "".join(own)
        asked += ["\n".join(own), "\n".join(own[::-1]), stream[::-1], "\n".join(x[::-1] for x in own), "\n".join(stream[i::6] for i in range(6)), " ".join(rng.sample(own, 3)), own[0][:4], own[1][:3], "".join(rng.sample(stream, 12))]
        asked += [own[0], "\n".join("".join(stream[c * 5 + r] for c in reversed(range(len(stream) // 5))) for r in range(5))]
    frame = spark.createDataFrame([(f"p{w}", w, i, x, x) for i, (w, x) in enumerate(lines)], "poem_id string, work_id string, line_no int, text_display string, text_match string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {r["query_id"]: (r["kind"], r["strategy"], r["longest_run"]) for r in exact.search(queries, frame, HAN)[0].collect()}
    want = {i: brute_search(q, lines, HAN) for i, q in enumerate(asked)}
    assert got == want
    assert {k for k, *_ in want.values()} >= {"full", "ambiguous", "none"} and len({s for _, s, _ in want.values()}) >= 5


def test_reports_score_terms_once(spark):
    """Fusion and reports share the lists of BM25: poems are passed over for statistics, terms and contents, each once."""
    from lacuna.config import LETTERS
    from lacuna.functions import text

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"w{i}", t) for i, t in enumerate(["the river under the evening moon", "lanterns on the autumn harbour", "frost on the mountain gate", "willow and crane in the snow"])]
    plain = spark.createDataFrame(rows, "poem_id bigint, work_id string, text_display string").withColumn("text_match", text.match_form(F.col("text_display"), LETTERS)).withColumn("char_count", F.length("text_match"))
    poems = plain.mapInArrow(counted, plain.schema)
    lines = plain.select("poem_id", "work_id", F.lit(0).alias("line_no"), "text_display", "text_match")
    queries = spark.createDataFrame([(1, "river evening lanterns"), (2, "mountain of snow"), (3, "qqqq")], "query_id int, text string")
    found = hybrid.search(queries, poems, lines, LETTERS, scorer=hybrid.lexical_scorer)
    got = {(r["query_id"], r["source"]): (r["status"], r["n"]) for r in found.reports.collect()}
    found.release()
    assert got[1, "bm25"][0] == got[2, "bm25"][0] == "has_result" and got[3, "bm25"] == ("no_result", 0) and len(got) == 12
    assert seen.value <= 3 * len(rows)
