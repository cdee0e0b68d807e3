"""The Jaccard join, decontamination and line dedup against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lacuna.llm import components, decontam, jaccard, linededup, queries, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * len(a | b)


def brute(rows):
    """doc_id to (n, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if linked(sets[a][1], sets[b][1]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        ids = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(ids, default=None)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def family(seed, n, words=60, changes=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


CASES = [*family(1, 40), *family(2, 25, 80, 9), *family(3, 10, 12, 3), "a b c", "A b\tC", "a b c d", None, "", " \n", "one", "one", " ".join(f"l{i}" for i in range(30_000)), " ".join(f"l{i}" for i in range(29_000))]


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(list(enumerate(CASES)), SCHEMA).repartition(3)


def joined(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(frame).collect()), key=str)


def test_join(cases):
    assert joined(cases) == brute(list(enumerate(CASES)))


def test_link_counts(cases):
    sets = {}
    for i, t in enumerate(CASES):
        sets.setdefault(shingles(t), []).append(i)
    got = {r["class_id"]: r["n_links"] for r in jaccard.join(cases).where("n_shingles > 0").collect()}
    assert got == {min(ids): sum(linked(s, o) for o in sets if o != s) for s, ids in sets.items() if s}


def test_join_in_blocks(cases, monkeypatch):
    """Clusters dealt to blocks and ranges of a few postings give the same."""
    monkeypatch.setattr(jaccard, "CLUSTER_BYTES", 2_000)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 1_000)
    monkeypatch.setattr(jaccard, "RANGE_POSTINGS", 3_000)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert joined(cases) == brute(list(enumerate(CASES)))


def test_join_of_repeated_rows_and_null_ids(spark):
    rows = [(1, CASES[0]), (1, CASES[0]), (None, CASES[0]), (7, None), (7, None), (None, "q r s"), (3, CASES[1])]
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_rows_of_one_id_with_different_texts(spark):
    a, b, c = CASES[0], "only here " + CASES[40], CASES[70]
    rows = [(1, a), (2, a), (2, b), (1, c), (1, c), (2, None), (3, a.upper()), (3, None), (4, b)]
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    got = jaccard.dedup(spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], SCHEMA + ", other int")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted([(1, a), (2, b), (1, c)])
    assert sorted(r["doc_id"] for r in got if not r["text"]) == [2, 3]


def test_a_shingle_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT_DOCS", 7)
    monkeypatch.setattr(jaccard, "UNIT_POSTINGS", 300)
    rng = random.Random(9)
    line = "every text holds this line and this one too"
    rows = [(i, " ".join([line, *(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30)))])) for i in range(120)]
    rows += [(200 + i, line + f" x{i}") for i in range(40)]
    assert joined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)
    entries = [pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})]
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 1})())
    out = pa.Table.from_batches(list(jaccard._postings(8, frozenset())(iter(entries))))
    shared = [jaccard._shared(out.filter(pa.compute.equal(out["key"], k))) for k in range(8)]
    hot = [np.frombuffer(b, np.uint16, len(b) // 10, len(b) // 5) for t in shared for b in t["body"].to_pylist()]
    assert max(x.max() for x in hot) == len({t for _, t in rows})
    assert len(out) < 9 * len(set(out["unit"].to_pylist())) + 1


def test_digests_that_clash_are_told_apart(spark, monkeypatch):
    whole = jaccard.class_of
    monkeypatch.setattr(jaccard, "class_of", lambda s: (whole(s)[0] % 5, whole(s)[1]))
    rows = [(i, t) for i, t in enumerate(CASES[:60])]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {(len(s), *jaccard.class_of(s)): i for i, t in reversed(rows) for w in tokens.words(pa.array([t])) for s in tokens.shingle_sets(w)}
    signed = spark.createDataFrame([(i, 0, n, c, d) for (n, c, d), i in sets.items()], "doc_id bigint, of_text bigint, n_shingles bigint, class bigint, second bigint")
    again, classes, clashes = jaccard.told_apart(signed)
    assert clashes == {c for _, c, _ in sets} and classes.count() == len(sets) and again.select("class").distinct().count() == len(sets)
    run = jaccard._postings(8, clashes)
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 0})())
    out = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})]))))
    about = np.frombuffer(out.filter(pa.compute.less(out["key"], 0))["body"][0].as_py(), np.int64)
    assert set(about[1 : 1 + about[0]].tolist()) == {r["class"] for r in classes.collect()}
    assert docs.count() == 60


def test_join_of_nothing(spark):
    assert joined(spark.createDataFrame([], SCHEMA)) == []


def test_join_on_table(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_jaccard(spark, SMALL).collect()), key=str)
    assert got == brute(rows)


def test_answers_are_derived(monkeypatch):
    """Near copies take their answers from a pivot, and they equal those computed afresh."""
    rng = np.random.default_rng(5)
    base = np.arange(1000, 1200)
    sets = [np.unique(np.append(np.delete(base, rng.integers(0, 200, 4)), rng.integers(5000, 9000, 3))).astype(np.uint64) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    fresh = [jaccard.Joined(sets, sizes).links(x) for x in range(len(sets))]
    one = jaccard.Joined(sets, sizes)
    assert all(np.array_equal(one.links(x), f) for x, f in enumerate(fresh)) and len(one.pivots) < 5
    want = [[y for y in range(len(sets)) if y != x and 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (sizes[x] + sizes[y] - o)] for x in range(len(sets))]
    assert [list(f) for f in fresh] == want


def test_dedup_keeps_one_of_each_group(spark, cases):
    roots = {c for _, _, c in brute(list(enumerate(CASES)))}
    assert {r["doc_id"] for r in jaccard.dedup(cases).collect()} == roots
    again = spark.createDataFrame([(1, CASES[0]), (1, CASES[0]), (2, CASES[0]), (None, "x")], SCHEMA)
    assert sorted((r["doc_id"] or 0) for r in jaccard.dedup(again).collect()) == [0, 1]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (5, 5), (None, 3), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}


def test_words_match_the_pattern():
    texts = ["Ab\x1ccd e\x0bf\x85g", "é\u3000ü x", None, "", "  a", "b  ", "x" * 70_000 + " y", "\x00 \x7f"]
    for block in (8, 1 << 20):
        counts = [c for w in tokens.words(pa.array(texts), block) for c in w.counts]
        assert counts == [len(WORD.findall(t or "")) for t in texts]
    low, up = (next(tokens.words(pa.array([t]))).hash for t in ("abc é", "ABC É"))
    assert low[0] == up[0] and low[1] != up[1]


def contained(documents, items):
    out = set()
    for i, t in documents:
        d = {tuple(s) for s in shingles((t or "").lower())}
        for j, u in items:
            q = {tuple(s) for s in shingles((u or "").lower())}
            if q and 100 * len(q & d) >= 80 * len(q):
                out.add((i, j, len(q), len(q & d)))
    return out


def found(spark, documents, items):
    rows = decontam.find(spark.createDataFrame(documents, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    return {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in rows}


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate((3, 5, 6, 9, 20, 21, 40, 77))] + [(90, None), (91, "")]
    documents = []
    for i in range(60):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(300))]
        part = items[rng.randrange(8)][1].split()
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = "zz"
        at = rng.randrange(len(words) + 1)
        documents.append((i, " ".join(words[:at] + part + words[at:])))
    documents += [(100, items[0][1].upper()), (101, None), (102, ""), (103, " ".join(["w"] * 20_000) + " " + items[4][1]), (103, "again"), (None, items[5][1])]
    assert found(spark, documents, items) == contained(documents, items)
    assert found(spark, [], items) == set() and found(spark, documents, []) == set()
    kept = decontam.clean(spark.createDataFrame([(*d, "x") for d in documents], SCHEMA + ", of_doc string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == ["doc_id", "text", "of_doc"]
    gone = {i for i, *_ in contained(documents, items)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in documents if i not in gone)


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))) for i, n in enumerate((3, 5, 9, 20, 40, 41))] + [(None, "q w e r t y")]
    documents = [(i, f"x y {t} z") for i, t in items[:6]] * 2 + [(50, f"{items[2][1]} {items[4][1]}"), (None, items[3][1]), (60, "a Q w e r t y b"), (None, items[6][1])]
    want = contained(documents, items)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 100)
    assert found(spark, documents, items) == want and (60, None, 2, 2) in want
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert found(spark, documents, items) == want


def chunked(text):
    """(first line, number of lines) of the chunks of a text."""
    return [(int(f), int(n)) for *_, f, n, _, _ in ((r, p, f, n, h, s) for row in linededup.chunks(pa.array([text])) for r, p, f, n, h, s in zip(*row))]


def brute_dedup(rows):
    seen, places = {}, {}
    for i, t in rows:
        if i is None or t is None:
            continue
        lines = t.split("\n")
        for p, (f, n) in enumerate(chunked(t)):
            part = lines[f : f + n]
            if n > 1 and sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in part) > 1:
                places.setdefault("\n".join(part), set()).add((i, p))
    first = {c: min(x) for c, x in places.items()}
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        lines, kept = t.split("\n"), []
        for p, (f, n) in enumerate(chunked(t)):
            part = lines[f : f + n]
            if first.get("\n".join(part), (i, p)) == (i, p):
                kept += part
        out.append((i, "\n".join(kept)))
    del seen
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, -1])
def test_line_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    passage = [f"shared line {i} of the passage" for i in range(12)]
    rows = []
    for i in range(30):
        own = [f"own {rng.randrange(10**9)}" for _ in range(rng.randrange(1, 15))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (passage if i % 2 else []) + own[at:])))
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (None, "\n".join(passage)), (53, rows[1][1]), (54, "same\n" * 40), (55, "é\nü\nß")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", n_removed_lines int")
    got = linededup.dedup(frame)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute_dedup(rows)
    total = got.agg({"n_removed_lines": "sum"}).first()[0]
    assert total == sum(len(t.split("\n")) - len(u.split("\n")) + (not u and bool(t)) for (_, t), (_, u) in zip(sorted(rows, key=lambda r: str(r[0])), sorted(brute_dedup(rows), key=lambda r: str(r[0]))) if t)


def brute_pairs(spark, rows):
    """Pairs of adjacent lines, one with a word: each line that only gone pairs cover goes. Boundaries are line breaks alone."""
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    solid = lambda x: bool(WORD.search(x))
    places = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for p, pair in enumerate(zip(lines, lines[1:])):
            if i is not None and any(map(solid, pair)):
                places.setdefault(pair, set()).add((i, hashes[t], p))
    first = {pair: min(x) for pair, x in places.items()}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        pairs = list(zip(lines, lines[1:]))
        gone = {p for p, x in enumerate(pairs) if i is not None and x in first and first[x] != (i, hashes[t], p)}
        lost = set()
        for p in gone:
            lost |= {p + 1} if p and p - 1 not in gone and pairs[p - 1] == pairs[p] else {p, p + 1}
        for a, b in itertools.combinations(sorted(lost), 2):
            if not any(x in lost or solid(lines[x]) for x in range(a + 1, b)):
                lost |= set(range(a + 1, b))
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in lost)))
    return sorted(out, key=str)


def test_line_dedup_of_repeated_ids(spark):
    a, b = "\n".join(f"line {i} of the text" for i in range(9)), "\n".join(["own", *(f"line {i} of the text" for i in range(3, 7)), "b"])
    for rows in ([(0, a), (1, a), (1, b)], [(0, a), (1, "short"), (1, a)], [(1, a), (1, None), (0, a)], [(1, a), (1, b), (1, a), (None, a), (2, b + "\nx\nx\nx\nx")]):
        frame = spark.createDataFrame(rows, SCHEMA)
        got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup(frame, linededup.pairs, words=1).collect()), key=str)
        assert got == brute_pairs(spark, rows)
        assert linededup.dedup(frame).count() == len(rows)


@pytest.mark.parametrize("limit", [500_000, -1])
def test_repeated_runs_go_whole(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    rows, want = [], []
    for n in range(2, 9):
        run = [f"line {k} of the run of {n}" if k != 1 else "" for k in range(n)]
        for i in range(6):
            head, tail = ([f"own {rng.randrange(10**9)}" for _ in range(rng.randrange(1, 9))] for _ in range(2))
            rows.append((10 * n + i, "\n".join(head + run + tail)))
            want.append((10 * n + i, "\n".join(head + (run if not i else []) + tail), n if i else 0, 1 if i else 0))
    for i, (text, kept, n, stretches) in enumerate([
        ("x\nx\nx\nx\nend", "x\nx\nend", 2, 1), ("p\n\n\n\n\nq\nz", "p\n\n\n\n\nq\nz", 0, 0), ("0\np\n\n\n\n\nq\n1", "0\n1", 6, 1),
        (None, None, 0, 0), ("", "", 0, 0), ("\n\n\n", "\n\n\n", 0, 0), ("\n\n\n\n", "\n\n\n\n", 0, 0), ("0\n\n1", "0\n\n1", 0, 0),
    ]):
        rows.append((100 + i, text))
        want.append((100 + i, kept, n, stretches))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed_lines"], r["n_removed_chunks"]) for r in got) == sorted(want)


def test_boundaries_shift_with_their_lines():
    lines = [f"line {i * i % 97} {i}" for i in range(60)]
    plain = {lines[f] for f, _ in chunked("\n".join(lines))}
    moved = {x for f, _ in chunked("\n".join(["new", "lines", *lines])) for x in [(["new", "lines", *lines])[f]]}
    assert len(plain - moved) <= 2


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_join_where_nothing_is_shared(spark):
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(5)]
    assert joined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
