import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lacuna.operators import additions, batch, columns, evaluate
from lacuna.sources import corpus_files, html, jsonl, sniff, xlsx
from lacuna.sources.vector_store import VectorStore


def test_jsonl(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('﻿{"a": "x", "n": 1}\n\n  {"a": null}\nnot json\n[1]\n{"a": "last"}', encoding="utf-8")
    rows = jsonl.read(spark, str(path)).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["parse_error"] for r in rows] == [None, None, "not valid JSON", "not a JSON object", None]
    assert jsonl.count(spark, str(path)) == 5 and jsonl.read(spark, str(path), 2).count() == 2
    assert columns.names_of(jsonl.read(spark, str(path)).where("parse_error is null")) == ["a", "n"]
    out = str(tmp_path / "out")
    done = jsonl.read(spark, str(path)).withColumn("result", F.struct(F.col("row_index").alias("i"), F.lit(None).cast("string").alias("none")))
    jsonl.write(done, out)
    written = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert {"a": "x", "n": 1, "han": {"i": 0, "none": None}} in written and {"han": {"i": 2, "none": None}} in written and len(written) == 5


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx.write(path, ["id", "", "poem", "poem"], [[1, True, "天地\n<&>", None], [None, None, None, None], [2.5, False, {"k": 1}, "x"]])
    names = ["id", "column_2", "poem", "poem_4"]
    got = [json.loads(r["raw"]) for r in xlsx.read(spark, path).orderBy("row_index").collect()]
    assert list(got[0]) == names
    assert got[0] == dict(zip(names, [1, True, "天地\n<&>", None])) and set(got[1].values()) == {None} and got[2]["poem"] == '{"k": 1}'
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("xlsx").option("path", path).load().count() == 3


def test_xlsx_in_pieces(spark, tmp_path):
    """Sheets cut at any size and several workbooks at once: the same rows as one process reads, gaps and all."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = [f"天 {i} <row r='1'>" for i in range(40)]

    def cell(r, c):
        at = f'r="{"ABC"[c]}{r}"'
        return f'<c {at} t="s"><v>{(r * 7 + c) % 40}</v></c>' if c != 1 else f'<c {at}><v>{r / 4}</v></c>'

    stored = [r for r in range(1, 90) if r % 9 != 5]
    body = "".join(f'<row r="{r}">{"".join(cell(r, c) for c in range(3) if (r + c) % 4 or r == 1)}</row>' if r % 11 else f'<row r="{r}"/>' for r in stored)
    sheets = {"a": f'<!-- <row r="7"/> --><worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>', "b": f'<x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="3"><x:c r="B3"><x:v>1</x:v></x:c></x:row><x:row/></x:sheetData></x:worksheet>', "c": f'<worksheet xmlns="{main}"><sheetData/></worksheet>'}
    for name, sheet in sheets.items():
        with zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as book:
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="/xl/worksheets/s.xml" Type="t"/></Relationships>')
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{x.replace("<", "&lt;")}</t></si>" for x in shared)}</sst>')
            book.writestr("xl/worksheets/s.xml", sheet)
    want = {(name, i): json.dumps(r, ensure_ascii=False) for name in sheets for i, r in enumerate(xlsx.records((tmp_path / f"{name}.xlsx").read_bytes()))}
    assert len([k for k in want if k[0] == "a"]) == 88 and [v for k, v in want.items() if k[0] == "b"] == ["{}", "{}"]
    first = json.loads(want["a", 0])
    assert list(first) == [shared[7], "0.25", shared[9]] and first[shared[7]] == shared[14] and set(json.loads(want["a", 3]).values()) == {None}
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.xlsx"))
    assert xlsx.pieces(files, 200).where("path like '%a.xlsx'").count() > 10
    for size in (60, 1000, xlsx.PIECE):
        got = {(r["path"][-6], r["row_index"]): r["raw"] for r in xlsx.parsed(files, size).collect()}
        assert got == want


def test_xlsx_books_by_executors(spark):
    rows = spark.range(0, 30_000, 1, 6).selectExpr("id as key", "case when id % 3 > 0 then concat('x ', id) end as text")
    made = xlsx.books(rows, F.floor(F.col("key") / 20_000), F.col("key"), ["key", "text"])
    back = xlsx.parsed(made, 1 << 16).withColumn("v", F.try_parse_json("raw")).select("path", "row_index", F.try_variant_get("v", "$.key", "long").alias("key"), F.try_variant_get("v", "$.text", "string").alias("text"))
    assert back.where("key = row_index + 20000 * cast(path as int) and not (text <=> case when key % 3 > 0 then concat('x ', key) end)").count() == 0
    assert back.count() == 30_000 and back.where("key <> row_index + 20000 * cast(path as int)").count() == 0


def test_xlsx_cells(tmp_path):
    path, main = tmp_path / "b.xlsx", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = '<c r="A2" s="1"><v>45292.5</v></c><c r="B2" t="s"><v>0</v></c><c r="C2" t="e"><v>#REF!</v></c><c r="D2" t="str"><f>A1</f><v>sum</v></c>'
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{c}</t></is></c>' for c in "ABCD")
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml" Type="t"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>rich </t></r><r><t>text</t></r></si></sst>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1">{head}</row><row r="2">{cells}</row><row r="4"><c r="A4"/></row></sheetData></worksheet>')
    rows = list(xlsx.records(path.read_bytes()))
    assert rows == [{"A": "2024-01-01T12:00:00.000Z", "B": "rich text", "C": None, "D": "sum"}, dict.fromkeys("ABCD")]


@pytest.mark.parametrize(
    "head, kind, reason",
    [
        (b"", None, "empty"), (b" \n", None, "empty"), (b"PK\x03\x04..", "xlsx", None), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None, "xls_legacy"), (b"\xff\xfea\x00", None, "not_utf8"),
        (b"\xc3\x28", None, "not_utf8"), (b"[1]", None, "json_array"), (b'{"a":1}\n{"b":2}\n', "jsonl", None), ("﻿{}\n".encode(), "jsonl", None), (b'{\n"a": 1\n}\n', None, "json_array"),
        (b'{"a":1}\nx\n', None, "unknown"), (b"a,b\n1,2\n", None, "csv_like"), (b"hello\n", None, "unknown"), (b'{"a": 1', "jsonl", None),
    ],
)
def test_sniff(head, kind, reason):
    found = sniff.sniff(head)
    assert (found.kind, found.reason) == (kind, reason)


def test_sniff_details(spark, tmp_path):
    assert sniff.sniff(b'{"a":1}\nx\n').line == 2 and sniff.sniff(b'{"a": 1').note == "single_record_unverified"
    assert sniff.sniff('{"a":1}\n{"b":"天'.encode()[:-1], whole=False).kind == "jsonl"
    (tmp_path / "f").write_bytes(b"PK\x03\x04")
    assert sniff.sniff_file(spark, str(tmp_path / "f")).kind == "xlsx"


def test_corpus_files(spark, tmp_path):
    (tmp_path / "poet.tang.0.json").write_text(json.dumps([{"title": "t", "author": "a", "paragraphs": ["天地。"], "id": "1"}, {"title": "no text"}, {"title": 5, "paragraphs": ["x"]}]))
    (tmp_path / "ci.song.0.json").write_text(json.dumps([{"rhythmic": "tune", "author": "b", "paragraphs": ["日月。"]}]))
    (tmp_path / "authors.tang.json").write_text(json.dumps([{"name": "a", "desc": "bio"}, {"desc": "nameless"}]))
    folder = str(tmp_path)
    poems = corpus_files.read_poems(spark, folder, "poet.tang").collect()
    assert sorted(p["upstream_id"] or "" for p in poems) == ["", "1"] and poems[0]["file"] == "poet.tang.0.json"
    ci = corpus_files.read_poems(spark, folder, "ci.song", title="rhythmic", dataset="ci").first()
    assert ci["title"] == "tune" and ci["upstream_id"] is None
    assert corpus_files.read_poems(spark, folder, "none").count() == 0
    authors = corpus_files.read_authors(spark, folder, {"authors.tang.json": ("desc", "唐"), "authors.song.json": ("short", "宋")}).collect()
    assert [(a["name"], a["bio"], a["dynasty"]) for a in authors] == [("a", "bio", "唐")]


PAGE = "<div id='poem_title_7' class='x'> <a href='/p/7'>旅夜<b>書懷</b></a> <span class='inlineComment1'>唐 · </span><a href='javascript:x()'>杜甫</a></div><div class='poemContent' id='poem_content_7'><div class='poemSentence'>細草微風岸，<div class='n'>1</div></div><div class='poemSentence'>&nbsp;</div></div>"


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>login</p>"), (3, "<p>没有找到</p>")], "page_id int, html string")
    poem = html.poems(pages).first()
    assert (poem["title"], poem["author"], poem["dynasty"], poem["lines"], poem["url"]) == ("旅夜書懷", "杜甫", "唐", ["細草微風岸，"], "https://sou-yun.cn/p/7")
    assert {r["page_id"]: r["status"] for r in html.outcomes(pages).collect()} == {1: "has_result", 2: "error", 3: "no_result"}


def test_pages_are_read_as_trees():
    long = "".join(f"<div class='poemSentence'>line {i}, <b>bold</b><br>x &amp; &lt;y<span>&nbsp;z</span></div>" for i in range(900))
    page = f"<div id='poem_title_1'><a href='http://a/1'>one</a><img src='x'><span class='a inlineComment1'>唐·</span></div><div id='poem_content_1' class='poemContent'>{long}</div><div class='poemSentence'>outside</div>"
    page += "<div id='poem_title_2'><b>no link</b></div><div id='poem_title_x'><a href='/'>odd</a></div><div id='poem_title_3'><a href='/3'> </a></div><div id='poem_title_4'><a href='/4'>four</a>"
    one, four = html.parsed(page)
    assert len(one["lines"]) == 900 and one["lines"][7] == "line 7, boldx & &lt;y z" and (one["dynasty"], one["author"], one["url"]) == ("唐", None, "http://a/1")
    assert (four["id"], four["title"], four["lines"], four["url"]) == ("4", "four", [], "https://sou-yun.cn/4")
    assert html.parsed(None) == html.parsed("") == html.parsed("<<div</p>") == []


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    assert store.live() is None and store.meta() is None and store.read().count() == 0
    points = spark.createDataFrame([(1, [0.5])], "point_id bigint, vector array<float>")
    assert store.write(points, {"dim": 1}) == 1 and store.write(points.union(points), {"dim": 2}) == 2
    assert store.live() == 2 and store.meta()["dim"] == 2 and store.read().count() == 2 and store.read(1).count() == 1
    store.flip(1)
    assert store.live() == 1


def test_pending_and_latest(spark):
    rows = spark.createDataFrame([("j", i) for i in range(4)], "job_id string, row_index int")
    results = spark.createDataFrame([("j", 0, "error", 1), ("j", 0, "has_result", 2), ("j", 1, "error", 1), ("j", 2, "skipped", 1)], "job_id string, row_index int, status string, finished_at int")
    left = lambda mode: sorted(r["row_index"] for r in batch.pending(rows, results, mode).collect())
    assert left("none") == [3] and left("unresolved") == [1, 3] and left("all") == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        batch.pending(rows, results, "odd")
    assert {r["status"]: r["n"] for r in batch.status_counts(results).collect()} == {"has_result": 1, "error": 1, "skipped": 1}


def test_export(spark):
    top = {"id": "1", "title": "T", "author": "A", "dataset": "user-added", "file": "f", "content": "abcdef", "span_start": 1, "span_end": 3, "score": 0.12349}
    outcome = {"run_id": "r", "status": "has_result", "confidence": 0.99951, "flags": ["exact_full_match", "input_reordered"], "evidence": [top, {"title": "U", "score": 0.5}], "form": "wulu", "verify_form": "pass"}
    silent = outcome | {"status": "no_result"}
    frame = spark.createDataFrame([(0, json.dumps(outcome)), (1, json.dumps(silent))], "row_index int, o string")
    results = frame.select("row_index", F.from_json("o", batch.OUTCOME).alias("outcome"))
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_index int, original string")
    every = [k for k, _, _ in batch.EXPORT_COLUMNS]
    got = {r["row_index"]: r.asDict() for r in batch.export(rows, results, every).collect()}
    assert len(every) == 36 and len(got[0]) == 38
    assert (got[0]["han_match_kind"], got[0]["han_confidence"], got[0]["han_matched_text"], got[0]["han_added"], got[0]["han_added_source"]) == ("full", 1.0, "bc", "user", "f")
    assert got[0]["han_alternatives"] == "U — ? (0.5)" and got[0]["han_form_label"] == "ngũ ngôn bát cú" and got[0]["han_reordered"] is True
    assert got[1]["han_title"] is None and got[1]["han_match_kind"] == "none" and got[1]["han_form"] is None and got[1]["han_confidence"] == 1.0
    assert got[2]["han_status"] == "not_executed" and got[2]["han_json"] is None
    assert batch.resolve_columns(["title", "nope", "match_kind"]) == ["status", "match_kind", "title"] and batch.resolve_columns(None)[0] == "status"


def test_jobs(spark):
    for status, column, left, code in ((None, "c", 1, 404), ("running", "c", 1, 409), ("done", None, 1, 400), ("done", "c", 0, 409)):
        with pytest.raises(batch.JobError) as refused:
            batch.start(status, column, left)
        assert refused.value.code == code
    assert batch.start("scanned", "c", 2) == "running"
    jobs = spark.createDataFrame([("a", "running"), ("b", "done")], "job_id string, status string")
    assert {r["job_id"]: r["status"] for r in batch.interrupted(jobs).collect()} == {"a": "interrupted", "b": "done"}
    files = spark.createDataFrame([("x", "a", 1), ("y", "z", 2)], "path string, job_id string, bytes int")
    assert batch.orphans(files, jobs).first()["path"] == "y"
    spend = spark.createDataFrame([(0, 0.3), (1, 0.3), (2, 0.0)], "row_index int, cost_usd double")
    assert [r["agent_allowed"] for r in batch.capped_spend(spend, 0.5).orderBy("row_index").collect()] == [True, True, False]


def test_row_status(spark):
    frame = spark.createDataFrame([("bad", "x", None), (None, " ", None), (None, "x", "has_result"), (None, "x", None)], "e string, c string, s string")
    assert [r["s"] for r in frame.select(batch.row_status(F.col("e"), F.col("c"), F.col("s")).alias("s")).collect()] == ["error", "skipped", "has_result", "error"]


def test_suggestion(spark):
    def suggest(*rows):
        frame = spark.createDataFrame([(i, o, n, v) for i, r in enumerate(rows) for o, (n, v) in enumerate(r.items())], "row_index int, ord int, name string, value string")
        return tuple(columns.suggest(columns.profile(frame)).first())

    assert suggest({"id": "1", "poem": "天地一沙鷗"}) == ("poem", None)
    assert suggest({"id": "1", "poem": "abc"}) == (None, "no_cjk")
    assert suggest({"a": "天地一沙", "b": "天地一沙"}) == (None, "ambiguous")
    assert suggest({"a": "天地"}, {"a": ""}, {"a": ""}) == (None, "no_cjk")


def test_additions(spark):
    rows = spark.createDataFrame([(1, "題", "人", "細草微風岸"), (2, "題", "人", "細草微風岸。"), (3, "", "人", "細"), (4, "題", "人", "星垂平野闊")], "row_index int, title string, author string, text string")
    held = additions.prepared(rows.where("row_index = 4")).select("content_hash")
    got = {r["row_index"]: r["result"] for r in additions.added(rows, held).collect()}
    assert got == {1: "added", 2: "duplicate", 3: "error", 4: "duplicate"}
    payloads = spark.createDataFrame([('{"title": "a", "x": 1}',), (json.dumps({"title": "a" * 201, "source_url": "nope"}),), ('{"source_url": "https://a.b/c"}',)], "p string")
    assert [r["i"] for r in payloads.select(additions.strict_issues(F.col("p")).alias("i")).collect()] == [["unknown:x"], ["long:title", "url:source_url"], []]
    queue = spark.createDataFrame([(1, "pending", "user", 1), (2, "accepted", "user", 2), (3, "pending", "agent", 3)], "addition_id int, status string, origin string, created_at int")
    decisions = spark.createDataFrame([(1, "accepted"), (2, "rejected"), (3, "maybe")], "addition_id int, decision string")
    after = {r["addition_id"]: (r["status"], r["review"]) for r in additions.reviewed(queue, decisions).collect()}
    assert after == {1: ("accepted", "applied"), 2: ("accepted", "not_pending"), 3: ("pending", "bad_decision")}
    assert [r["addition_id"] for r in additions.listed(queue, "pending", "all").collect()] == [3, 1]
    with pytest.raises(ValueError):
        additions.listed(queue, "odd")


def test_damage(spark):
    works = spark.createDataFrame([(1, ["天地一沙", "日月星辰", "山川"])], "work_id int, lines array<string>")
    got = {r["damage"]: r["query"] for r in evaluate.cases(works).collect()}
    assert got["clean"] == got["simplified"] == "天地一沙\n日月星辰\n山川"
    assert got["line_reverse"] == "山川\n日月星辰\n天地一沙" and got["one_per_line"].replace("\n", "") == "天地一沙日月星辰山川"
    assert got["window"] in ("天地一沙\n日月星辰", "日月星辰\n山川")
    assert [len(x) for x in got["char_drop"].split("\n")] == [3, 3, 2]
    stream, rows = "天地一沙日月星辰山川", 4
    assert got["grid_transpose"] == "\n".join("".join(stream[c * rows + r] for c in (2, 1, 0) if c * rows + r < len(stream)) for r in range(rows))


def test_tallies(spark):
    verified = spark.createDataFrame([("wulu", "pass", "pass"), ("wulu", "fail", "abstain"), ("ci", "abstain", None)], "candidate_form string, rhyme_check string, tone_check string")
    got = {r["form"]: r for r in evaluate.form_tallies(verified).collect()}
    assert got["wulu"]["rhyme_fail"] == 1 and got["wulu"]["tone_pass"] == 1 and got["ci"]["n"] == 1
