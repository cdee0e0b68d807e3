from pyspark.sql import functions as F

from lacuna.config import HAN, ConfigError, Settings, load_prices, load_settings, override
from lacuna.functions import keys, records, text

import pytest

LINES = "細草微風岸 危檣獨夜舟 星垂平野闊 月湧大江流 名豈文章著 官應老病休 飄飄何所似 天地一沙鷗".split()


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


def test_match_form_is_idempotent(spark):
    form = one(spark, "羣峭碧摩天，Abc 独夜舟\n", text.match_form)
    assert form == "群峭碧摩天獨夜舟"
    assert one(spark, form, text.match_form) == form


def test_supplementary_ideographs_count_once(spark):
    assert one(spark, "𠀀天", lambda c: F.length(text.match_form(c))) == 2


def test_nfc(spark):
    assert one(spark, "é", text.nfc) == "é"
    assert one(spark, "豈", text.display_form) == "豈"


def test_splitters(spark):
    assert one(spark, "a　b\n c", text.visual_lines) == ["a", "b", "c"]
    assert one(spark, "天地，一沙 鷗。", text.prosody_lines) == ["天地", "一沙", "鷗"]
    assert one(spark, "天地，一沙；鷗。", text.corpus_lines) == ["天地", "一沙", "鷗"]
    assert one(spark, "天地\n一沙。", text.answer_lines) == ["天地", "一沙"]
    assert one(spark, None, text.visual_lines) is None


def test_windows(spark):
    assert one(spark, "一二三", lambda c: text.windows(c, HAN)) == []
    found = one(spark, "一二三四五", lambda c: text.windows(c, HAN))
    assert found == ["一二三四五", "一二三四", "二三四五"]


def test_bigrams(spark):
    assert one(spark, "abab", text.bigrams) == ["ab", "ba", "ab"]
    assert one(spark, "abab", text.query_terms) == ["ab", "ba"]
    assert one(spark, "a", text.bigrams) == []


def test_inscription(spark):
    found = one(spark, "細草微風岸\n危檣獨夜舟\n辛亥年秋月書\n某某先生雅正", text.split_inscription)
    assert found["body"] == LINES[:2] and found["inscription"] == ["辛亥年秋月書", "某某先生雅正"]
    assert found["cyclical_date"] == "辛亥年秋月" and found["title"] is None
    led = one(spark, "甲子年春\n細草微風岸\n危檣獨夜舟", text.split_inscription)
    assert led["body"] == LINES[:2] and led["title"] == "甲子年春"
    alone = one(spark, "辛亥年秋月書", text.split_inscription)
    assert alone["body"] == [] and alone["inscription"] == ["辛亥年秋月書"] and alone["title"] is None
    assert one(spark, "", text.split_inscription)["body"] == []


def test_highlight_marks_longest_first(spark):
    frame = spark.createDataFrame([("天地一沙鷗", ["天地", "天地一沙", "鷗"])], "x string, m array<string>")
    assert frame.select(text.highlighted(F.col("x"), F.col("m")).alias("y")).first()["y"] == "[天地一沙][鷗]"


def test_overlap_is_null_for_nothing(spark):
    assert one(spark, "", lambda c: text.lexical_overlap(c, F.lit("abc"))) is None
    assert one(spark, "abz", lambda c: text.lexical_overlap(c, F.lit("abc"))) == pytest.approx(2 / 3)


def test_cells(spark):
    values = ['"  a "', "12", "true", "null", "{}", "[1]"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [r["y"] for r in frame.orderBy("i").select(text.cell_text(F.parse_json("x")).alias("y")).collect()]
    assert got == ["a", "12", "true", "", "", ""]


def test_keys(spark):
    import hashlib

    assert one(spark, "天", lambda c: keys.work_key(F.lit(None).cast("string"), F.lit("t"), c)) == hashlib.sha256("|t|天".encode()).hexdigest()[:32]


def test_names_and_traces(spark):
    assert records.to_camel("work_id_x") == "workIdX" and records.to_snake("workIdX") == "work_id_x"
    frame = spark.sql("select named_struct('inner_key', array(named_struct('deep_key', 1))) as outer_key")
    assert records.convert_names(frame, records.to_camel).schema.simpleString() == "struct<outerKey:struct<innerKey:array<struct<deepKey:int>>>>"
    templates = {"a": "found {n}: {parts}", "b": "x{y}"}
    assert records.render({"code": "a", "params": {"n": 2}, "parts": [{"code": "b", "params": {"y": 1}}, {"code": "?"}]}, templates) == "found 2: x1"
    assert records.render({"code": "?"}, templates, "else") == "else"


def test_verdicts(spark):
    assert records.verdict('so: {"verdict": "sufficient", "confidence": 0.5, "notes": "a {b}"} ok') == {"verdict": "sufficient", "confidence": 0.5, "gaps": [], "notes": "a {b}"}
    assert records.verdict('{"verdict": "maybe", "confidence": 1}') is None and records.verdict("none") is None
    assert one(spark, '{"verdict": "conflicting", "confidence": 1}', records.verdicts)["verdict"] == "conflicting"
    assert one(spark, "no", records.verdicts)["verdict"] is None


def test_redaction(spark):
    got = spark.sql("select map('key', 'secret', 'q', 'x') as m").select(records.redacted(F.col("m"), ["key"]).alias("m")).first()["m"]
    assert got == {"key": "[redacted]", "q": "x"}


def test_settings(tmp_path):
    assert override(Settings(), {"top_k": 3, "rrf_k": None}).top_k == 3
    with pytest.raises(ConfigError) as wrong:
        override(Settings(), {"top_k": 0, "nope": 1, "agent_enabled": 1, "rrf_k": 1.5})
    assert len(str(wrong.value).splitlines()) == 4
    (tmp_path / "c.yaml").write_text("top_k: 4\n")
    assert load_settings(str(tmp_path / "c.yaml")).top_k == 4
    (tmp_path / "p.yaml").write_text("models:\n  a: {inputPerMTok: 3, outputPerMTok: 15}\n")
    assert load_prices(str(tmp_path / "p.yaml")) == [("a", 3.0, 15.0, None)]
    (tmp_path / "p.yaml").write_text("models:\n  a: {inputPerMTok: -3}\n")
    with pytest.raises(ConfigError):
        load_prices(str(tmp_path / "p.yaml"))
