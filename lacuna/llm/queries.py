"""Queries of the operators, each over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import convtrie, decontam, hardneg, jaccard, langid, linededup, mixing, quality, secrets, sharding, tokencount, toxicity, urlfilter
from lacuna.llm.storage import keep, shared_folder

ARRIVALS = 4
TOKENIZER, MOST_TOKENS = "word_bpe_49k.json", 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int) -> Column:
    """crc32 of the document's id as text, modulo divisor; null ids count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor, F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(remainder(5) != 0))
    held = remainder(5) == 0
    return langid.identify(documents.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), linededup.pairs, words=1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_first_position(mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.size("placements").alias("copies"), F.round("position", 9).alias("position"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    scored = toxicity.score(documents, model)
    predicted = (F.col("toxicity") >= toxicity.Settings().threshold).cast("int")
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["layers"] == "")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], digest, joined("secrets").alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    store = sharding.shard(table(spark, sf_dir, "documents"), folder, arrivals=ARRIVALS)
    facts = [F.lit(store.version() > ARRIVALS).alias("compacted"), F.lit(store.settled()).alias("settled")]
    return store.stored().select("doc_id", "source", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), (F.col("shard_bytes") > 0).alias("in_shard"), *facts)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.col("vec_id")
    label = F.when(of % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine(vectors, F.col("id") % 100 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = convtrie.turns_of(table(spark, sf_dir, "conversations"))
    return convtrie.trie(convtrie.rebuilt(keep(turns, "trie-turns")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = tokencount.Cache(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    counted = tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokencount.load(public_tokenizers.path(TOKENIZER)), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_counts": op13_token_counts,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_QUALITY = rf"""
with base as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as text, {_WORDS} as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
), places as (
  select row_id, unnest(words) as a, generate_subscripts(words, 1) as i from base
), windows as (
  select row_id, i, a, lead(a, 1) over w as b, lead(a, 2) over w as c from places window w as (partition by row_id order by i)
), marked as (
  select row_id, i, c is not null and count(*) over (partition by row_id, a, b, c) > 1 as twice from windows
), covered as (
  select row_id, twice or coalesce(lag(twice, 1) over w, false) or coalesce(lag(twice, 2) over w, false) as inside
  from marked window w as (partition by row_id order by i)
), repeated as (
  select row_id, count(*) filter (where inside) as n_repeat_words from covered group by row_id
), counted as (
  select doc_id, text, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from base left join repeated using (row_id)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {" or ".join(f"({r.rejects})" for r in quality.RULES).replace("{g}", ", 'g'")}) as kept
from judged
"""

_MIXING = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    coalesce(md5(cast(doc_id as varchar)), '') as key
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
    [3.0::double, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source
), filling as (
  select *, 2 * source_size as whole, 2 * source_size / weight as fills from sources
), levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(whole) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by fills, source nulls last rows between current row and unbounded following) as level
  from filling
), goals as (
  select source, source_size, least(cast(whole as double), weight * (select arg_min(level, fills) from levels where level <= fills)) as target from levels
), ranked as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 as schedule from goals
), placed as (
  select s.*, source_size, target, schedule, coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join ranked g on s.source is not distinct from g.source
), taking as (
  select *, greatest(least(round(target) - start, size), 0) as one, greatest(least(round(target) - start - source_size, size), 0) as two from placed
), whole as (
  select *, case when one > 0 then start when two > 0 then start + source_size end / greatest(target, 1.0) as part from taking
)
select doc_id, cast(size as bigint) as size, source_size, round(target, 6) as target, cast(one + two as bigint) as taken,
  cast((one > 0)::int + (two > 0)::int as int) as copies,
  -- where the integrals 4t - t^2 (of 3), t/2 then 1/4 + x/2 + 2x^2 with x = t - 1/2 (of 1), and 2t (of 2) reach that part
  case when part is not null then round(least(case schedule when 0 then 2 * (3 * part) / (4 + sqrt(greatest(16 - 4 * (3 * part), 0.0)))
    when 1 then case when part <= 0.25 then 2 * part / (0.5 + 0.5) else 0.5 + 2 * (part - 0.25) / (0.5 + sqrt(greatest(0.25 + 8 * (part - 0.25), 0.0))) end
    else 2 * (2 * part) / (2 + 2) end, 1.0), 9) end as position
from whole
"""

_LOWER_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_DECONTAMINATION = f"""
with d as (select doc_id, {_LOWER_WORDS} as w from documents), b as (select item_id, {_LOWER_WORDS} as w from benchmark),
ds as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s
    from d where len(w) > 0)
), bs as (
  select distinct item_id, s from (
    select item_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s
    from b where len(w) > 0)
), sizes as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, any_value(n_item) as n_item, count(*) as n_shared, round(count(*) / any_value(n_item), 6) as containment
from ds join bs using (s) join sizes using (item_id) group by doc_id, item_id having 100 * count(*) >= 80 * any_value(n_item)
"""

_JACCARD = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s
    from words where len(w) > 0)
), sized as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as o from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (
  select x, y, o = a.n and o = b.n as same from shared join sized a on x = a.doc_id join sized b on y = b.doc_id where 100 * o >= 80 * (a.n + b.n - o)
), both_ways as (select x, y, same from link union all select y, x, same from link),
class as (select d.doc_id, least(d.doc_id, coalesce(min(y) filter (where same), d.doc_id)) as class_id from documents d left join both_ways on x = d.doc_id group by d.doc_id),
reach(doc_id, other) as (select doc_id, doc_id from documents union select reach.doc_id, y from reach join both_ways on other = x),
component as (select doc_id, min(other) as component_id from reach group by doc_id),
linked as (select x, count(distinct class_id) as n_links from both_ways join class on y = doc_id where not same group by x)
select c.doc_id, coalesce(n, 0) as n_shingles, component_id, class_id, coalesce(n_links, 0) as n_links
from class c join component using (doc_id) left join sized using (doc_id) left join linked on x = c.doc_id
"""

_SHARDING = "select doc_id, source, lang, n_chars, sha256(text) as text_sha256, true as in_shard, true as compacted, true as settled from documents"

_HARD_NEGATIVES = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as int) as rank,
  id as negative_id, positive_score, score as negative_score
from positive p join scored n on p.anchor_id = n.anchor_id and not n.same and 80 * positive_score <= 100 * n.score and 100 * n.score <= 100 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 5
"""

#: crc32 bit by bit: list_reduce over the bits of the decimal id, lowest first.
_CONVERSATIONS = r"""
with turns as (
  select conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) as key,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as words
  from conversations where conv_id is not null
), own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, key) as i, key, words from turns
), convs as (
  select distinct conv_id, conv_id - conv_id % 20 as base, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(8 * len(conv_id::varchar)), lambda k: cast((ascii(substr(conv_id::varchar, cast(k // 8 + 1 as int), 1)) >> cast(k % 8 as int)) & 1 as bigint))),
    lambda c, b: case when (xor(c, b) & 1) = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) % 4 as h
  from conversations where conv_id is not null
), rebuilt as (
  select c.conv_id, 0 as part, i, key, words from convs c join own on own.conv_id = c.base and i <= h
  union all select own.conv_id, 1, i, key, words from own join convs using (conv_id) where i > h
), paths as (
  select c.conv_id, coalesce(list(key order by part, i) filter (where key is not null), []) as keys, coalesce(list(words order by part, i) filter (where key is not null), []) as sizes
  from convs c left join rebuilt using (conv_id) group by c.conv_id
), prefixes as (
  select conv_id, d as depth, list_slice(keys, 1, d) as node, case when d > 0 then sizes[d] else 0 end as words, d = len(keys) as ended
  from (select *, unnest(range(0, len(keys) + 1)) as d from paths)
), nodes as (
  select depth, node, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ended), '')) as ends_sha256
  from prefixes group by depth, node
), family as (
  select n.*, p.conv_id as parent_conv_id, p.node as parent from nodes n left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.node = list_slice(n.node, 1, n.depth - 1)
), children as (
  select parent, count(*) as n_children from family where depth > 0 group by parent
), weighed as (
  select node, (n_convs - 1) * words as saved, cast(c.parent is null as bigint) as leaf, unnest(range(0, depth + 1)) as d from nodes left join children c on node = c.parent
), sums as (
  select list_slice(node, 1, d) as node, sum(saved) as saved, sum(leaf) as leaves from weighed group by all
)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children,
  cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends_sha256
from family join sums using (node) left join children on node = children.parent
"""

SQL: dict[str, str] = {
    "op2_ngram_jaccard": _JACCARD,
    "op3_decontamination": _DECONTAMINATION,
    "op4_quality": _QUALITY,
    "op6_mixing": _MIXING,
    "op9_sharding": _SHARDING,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_conversation_trie": _CONVERSATIONS,
}
