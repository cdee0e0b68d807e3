"""Hard negatives, the conversation trie and token counts against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import convtrie, hardneg, queries, tokencount

public = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Hard negatives


def mined(rows, positives=5, negatives=5):
    """Rows (id, vector, label); anchors are ids divisible by 4."""
    held = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if sum((abs(x * 256) + 1) * (abs(x * 256) + 1) for x in v) < hardneg.LONGEST:
            held.append((n, i, [math.floor(x * 256) for x in v], label))
    out = []
    for n, i, v, label in held:
        if i is None or i % 4:
            continue
        every = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, m, k) for m, j, w, k in held if len(w) == len(v) and m != n))
        for p in [x for x in every if x[4] == label][:positives]:
            fit = [x for x in every if x[4] != label and -80 * p[0] <= -100 * x[0] <= -100 * p[0]][:negatives]
            out += [(i, None if p[1] else p[2], r, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def found(spark, rows, **changes):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    frame = frame.withColumns({c: F.lit("x") for c in ("id", "row", "score", "anchor")}).repartition(3)
    return sorted(map(tuple, hardneg.mine(frame, F.col("id") % 4 == 0, hardneg.Settings(**changes)).collect()), key=str)


def vectors(seed, n, dim=6, near=0.3):
    rng = random.Random(seed)
    centre = [rng.uniform(-1, 1) for _ in range(dim)]
    return [(i, [c + rng.uniform(-near, near) for c in centre], rng.randrange(3)) for i in range(n)]


def test_hard_negatives(spark):
    rows = vectors(1, 150)
    assert len(mined(rows)) > 300
    assert found(spark, rows) == mined(rows)
    assert found(spark, rows, anchors=7, block=16) == mined(rows)
    assert found(spark, rows, positives=2, negatives=9) == mined(rows, 2, 9)


def test_hard_negatives_ties_and_copies(spark):
    rows = [(i, [0.5, 0.25], i % 3) for i in range(60)] + [(4, [0.5, 0.25], 1)] * 3 + [(8, [0.0, 0.0], 0), (12, [-0.5, 0.1], 0)]
    got = [(a, p, r, n, x, y) for a, p, r, n, x, y in found(spark, rows, block=8)]
    assert collections.Counter(got) == collections.Counter(mined(rows))


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 40) + [
        (100, None, 1), (104, [0.1] * 6, None), (108, [0.1, None, 0.2, 0.3, 0.1, 0.2], 1), (112, [nan] * 6, 1), (116, [inf] * 6, 1), (None, [0.9] * 6, 1), (None, [0.8] * 6, 2),
        (120, [], 1), (124, [], 1), (125, [], 2), (128, [1.0], 1), (129, [1.0], 1), (130, [0.9], 2), (-4, [0.3] * 6, 1), (132, [1e300] * 6, 1),
        (136, [2e6] * 6, 1), (137, [2.1e6] * 6, 1), (138, [1.9e6] * 6, 2), (140, [1e15] + [0.0] * 5, 1),
    ]
    assert found(spark, rows) == mined(rows)
    assert any(x[4] > 1 << 53 for x in found(spark, rows))
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 1)]) == []


def test_hard_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    held = [(i, [math.floor(x * 256) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    out = []
    for i, v, label in (x for x in held if x[0] % 100 == 0):
        every = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, w, k in held if j != i)
        for p in [x for x in every if x[2] == label][:5]:
            fit = [x for x in every if x[2] != label and -80 * p[0] <= -100 * x[0] <= -100 * p[0]][:5]
            out += [(i, p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(fit, 1)]
    assert out and sorted(map(tuple, queries.op11_hard_negatives(spark, SMALL).collect())) == sorted(out)


# The trie


def paths_of(rows, rebuild):
    """conv_id to its turns (role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(own[c])] for c in own}
    if not rebuild:
        return own
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def nodes_of(paths):
    """Each node by looking at all conversations and all nodes below it."""
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        kids = sum(len(x) == d + 1 for x in below)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ended = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == d)))
        out.append((min(convs), d, min(members[node[:-1]]) if d else None, len(convs), kids, leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, rebuild):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(7) for c in ("digest", "words", "depth", "part", "node")}).repartition(3)
    turns = convtrie.turns_of(frame)
    return sorted(map(tuple, convtrie.trie((convtrie.rebuilt if rebuild else convtrie.sequences)(turns)).collect()), key=str)


def talk(seed, n, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d  e\tf", "ü 漢字"])) for c in range(-n // 3, n) for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie(spark, rebuild):
    rows = talk(3, 90)
    rows += [(5, None, "user", "null turn"), (5, None, "user", "null turn"), (5, 2, "bot", "x"), (5, 2, "bot", "y"), (None, 1, "user", "nobody"), (10**12, 1, None, None)]
    rows += [(c, t, "user", f"w{t} x") for c in range(200, 230) for t in range(40)] + [(300, t, "user", f"w{t} x") for t in range(60)]
    assert nodes(spark, rows, rebuild) == nodes_of(paths_of(rows, rebuild))


def test_trie_of_long_lists_of_ends(spark):
    """Ids that take many pieces, over several ranges."""
    rows = [(10**15 + c, 1, "user", "same words here") for c in range(30_000)]
    got = nodes(spark, rows, False)
    ids = ",".join(str(r[0]) for r in rows)
    assert got == sorted([(10**15, 0, None, 30_000, 1, 1, 29_999 * 3, hashlib.sha256(b"").hexdigest()), (10**15, 1, 10**15, 30_000, 0, 1, 29_999 * 3, hashlib.sha256(ids.encode()).hexdigest())], key=str)


def test_trie_of_no_conversation(spark):
    assert nodes(spark, [], True) == []
    assert nodes(spark, [(None, 1, "a", "b")], False) == []


def test_stretches_cost_no_more_than_prefixes(spark):
    """Two copies of a conversation of 3,000 turns: 4.5 million pairs of node and ancestor, 6,002 prefixes."""
    rows = [(c, t, "user", f"w{t}") for c in (1, 2) for t in range(3_000)]
    got = {r[1]: r for r in nodes(spark, rows, False)}
    assert len(got) == 3_001 and all(got[d][6] == 3_000 - max(0, d - 1) for d in got) and got[0][5] == 1


def test_role_and_text_do_not_run_together(spark):
    assert len(nodes(spark, [(1, 1, "ab", "c"), (2, 1, "a", "bc")], False)) == 3


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_trie(spark, SMALL).collect()), key=str) == nodes_of(paths_of(rows, True))


# Token counts

TEXTS = [
    None, "", " ", "one", "One  ONE\n", " one", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "don't we'LL  it's", "É J̌ ẞ ß", " nbsp wide　", "x" * 3_000, "漢字かな", "1234 5.6",
    "a\x1cb\x85c", "́ ̸<", "= ̸", "\U0001f600 \U0001f1e9\U0001f1ea", "word " * 20_000, "word\t" * 20_000, "\x00 \x7f",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return lambda text: len(model.encode(text or "", add_special_tokens=False))


def counts(frame, tokenizer, cache):
    return sorted((tuple(r) for r in tokencount.count(frame, tokenizer, cache).collect()), key=str)


def brute_counts(rows, library):
    return sorted(((i, len((t or "").encode()), library(t)) for i, t in rows), key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(-1) for c in ("digest", "n_tokens", "n_bytes", "rows")}).repartition(3)


def stored(spark, tokenizer, folder):
    return sorted(r["digest"].hex() for r in spark.read.parquet(f"{folder}/{tokenizer.version}").collect())


def test_counts(spark, library, tmp_path):
    rows = [(i % 15 if i % 4 else None, t) for i, t in enumerate(TEXTS * 3)]
    tokenizer, cache = tokencount.load(public.path("word_bpe_49k.json")), tokencount.Cache(spark, str(tmp_path))
    assert tokenizer.spaced
    assert counts(documents(spark, rows), tokenizer, cache) == brute_counts(rows, library)
    first = stored(spark, tokenizer, tmp_path)
    assert len(first) == len(set(first)) == len({" ".join(re.split(r"[\x20\x09-\x0D]+", t or "")).strip(" ") for t in TEXTS})
    more = [*rows, (99, "some new text"), (98, "some  new text\n")]
    assert counts(documents(spark, more), tokenizer, cache) == brute_counts(more, library)
    assert len(stored(spark, tokenizer, tmp_path)) == len(first) + 1  # only the miss was encoded, once
    assert counts(documents(spark, []), tokenizer, cache) == []


def test_counts_come_from_the_cache(spark, tmp_path):
    tokenizer, cache = tokencount.load(public.path("word_bpe_49k.json")), tokencount.Cache(spark, str(tmp_path))
    cache.append(tokenizer, spark.createDataFrame([(bytearray(hashlib.sha256(b"a b").digest()), 77)] * 2, tokencount.COUNTS))
    assert counts(documents(spark, [(1, "a b"), (2, " a\nb "), (3, "a b c")]), tokenizer, cache) == [(1, 3, 77), (2, 5, 77), (3, 5, 3)]


def test_versions_are_apart(spark, library, tmp_path):
    import sentencepiece

    words, pieces = (tokencount.load(public.path(x)) for x in ("word_bpe_49k.json", "piece_bpe_32k.model"))
    plain, cache = tokencount.load(public.path("byte_bpe_50k.json")), tokencount.Cache(spark, str(tmp_path))
    assert len({words.version, pieces.version, plain.version}) == 3 and not pieces.spaced and not plain.spaced
    rows, model = list(enumerate(TEXTS[:-3])), sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    assert counts(documents(spark, rows), words, cache) == brute_counts(rows, library)
    assert counts(documents(spark, rows), pieces, cache) == brute_counts(rows, lambda t: len(model.encode(t or "")))
    from tokenizers import Tokenizer

    bytewise = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert counts(documents(spark, rows), plain, cache) == brute_counts(rows, lambda t: len(bytewise.encode(t or "", add_special_tokens=False)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "'s", "<|endoftext|>", "<|", "́", "̸", "=", " ", "\x1c", "\x85", "1", "ᄀ", "ᅡ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "漢"]), max_size=12))
def test_counts_add_up_over_words(library, parts):
    text = "".join(parts)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    assert library(text) == sum(map(library, words)) == library(" ".join(words))


def test_memo_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokencount, "MEMO", 4)
    size = tokencount.by_words(lambda words: [library(w.decode()) for w in words])
    texts = ["a b c", "d e f", "a b c d e f", "g", "y" * 100, "a " + "z" * 70 + " b", "h i j k " + "q" * 80]
    assert size([t.encode() for t in texts]) == [library(t) for t in texts]


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokencount.load(public.path("byte_bpe_50k.tiktoken"))


def test_counts_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_token_counts(spark, SMALL).collect()))
    assert got == sorted((*x, x[2] > 2048) for x in brute_counts(rows, library))
