"""Catalogue: sources and sinks as round trips, streams, and functions on records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import api
from lacuna.config import LETTERS
from lacuna.functions import records, text
from lacuna.operators import additions, agent, batch, corpus, events, service, vectors
from lacuna.plans.inputs import MATCH, Catalogue, Inline, spread, table
from lacuna.plans.operations import LOG_SQL, PRICES, log
from lacuna.sources import corpus_files, jsonl, sniff, tables, vector_store, xlsx
from lacuna.storage import shared_folder
from lacuna.streaming import events as stream
from lacuna.streaming import numbered, source

C = Catalogue()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/catalogue/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(at, True)
    out.write(bytearray(body))
    out.close()


# Files of rows.
@C.add("jsonl_round_trip", "select conv_id, turn, role, text, length(text) > 50 as long from conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, path = table(spark, sf_dir, "conversations"), _place(spark, "jsonl")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.to_json(F.struct("conv_id", "turn", "role")).alias("raw"), F.struct("text", (F.length("text") > 50).alias("long")).alias("result"))
    jsonl.write(rows, path)
    back, kinds = jsonl.read(spark, path), {"conv_id": "bigint", "turn": "bigint", "role": "string"}
    own = [F.try_variant_get("values", f"$.{k}", v).alias(k) for k, v in kinds.items()]
    return back.where("parse_error is null").select(*own, F.try_variant_get("values", "$.han.text", "string").alias("text"), F.try_variant_get("values", "$.han.long", "boolean").alias("long"))


@C.add("jsonl_faults", "select case when turn % 7 = 0 then 'not valid JSON' when turn % 7 = 1 then 'not a JSON object' end as parse_error, count(*) as n from conversations group by 1")
def jsonl_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "faults")
    line = F.when(F.col("turn") % 7 == 0, "oops {").when(F.col("turn") % 7 == 1, "[1]").otherwise(F.to_json(F.struct("conv_id", "text")))
    table(spark, sf_dir, "conversations").select(line.alias("value")).write.text(path)
    return jsonl.read(spark, path).groupBy("parse_error").agg(F.count("*").alias("n"))


@C.add("jsonl_count", "select count(*) as n from events")
def jsonl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "count")
    table(spark, sf_dir, "events").write.json(path)
    return spark.createDataFrame([(jsonl.count(spark, path),)], "n bigint")


BOOK = "(o_orderkey // 10000)"


@C.add("xlsx_round_trip", f"select cast({BOOK} as varchar) as path, row_number() over (partition by {BOOK} order by o_orderkey) - 1 as row_index, o_orderkey as key, o_orderpriority as name, case when o_custkey % 3 <> 0 then o_custkey end as customer, o_custkey % 2 = 0 as even from orders")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as workbooks that executors write, and back from pieces of their sheets."""
    rows, path = table(spark, sf_dir, "orders"), _place(spark, "books")
    named = rows.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("customer"), (F.col("o_custkey") % 2 == 0).alias("even"))
    xlsx.books(named, F.floor(F.col("key") / 10_000), F.col("key"), ["key", "name", "customer", "even"]).write.parquet(path)
    back = xlsx.parsed(spark.read.parquet(path)).withColumn("v", F.try_parse_json("raw"))
    kinds = {"key": "bigint", "name": "string", "customer": "bigint", "even": "boolean"}
    return back.select("path", "row_index", *[F.try_variant_get("v", f"$.{k}", v).alias(k) for k, v in kinds.items()])


# What a stored text starts like, by conv_id and turn, and the kind that its file has.
_SNIFFED = """select conv_id, turn, case coalesce((conv_id + turn) % 6, 4) when 0 then 'jsonl' when 1 then null when 2 then 'xlsx' else null end as kind,
    case coalesce((conv_id + turn) % 6, 4) when 1 then 'json_array' when 3 then 'csv_like' when 4 then 'empty' when 5 then 'not_utf8' end as reason from conversations"""


@C.add("file_kinds", _SNIFFED)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the bytes of files of each kind, judged where they lie."""
    row = F.to_json(F.struct("conv_id", "turn", "role"))
    kind = F.coalesce((F.col("conv_id") + F.col("turn")) % 6, F.lit(4))
    body = (
        F.when(kind == 0, F.concat(row, F.lit("\n"), row, F.lit("\n"))).when(kind == 1, F.concat(F.lit("["), row, F.lit("]"))).when(kind == 2, F.concat(F.lit("PK\x03\x04"), row))
        .when(kind == 3, F.concat(F.lit("conv,turn\n"), F.concat_ws(",", "conv_id", "turn"), F.lit("\n"))).when(kind == 4, F.lit(""))
    )
    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 5, F.encode(row, "UTF-16")).otherwise(F.encode(body, "UTF-8")).alias("content"))
    return files.select("conv_id", "turn", sniff.kinds(F.col("content")).alias("k")).select("conv_id", "turn", "k.kind", "k.reason")


# Corpus files: nation and region, tables of fixed size, as the files of a corpus.
def _corpus_folder(spark: SparkSession, sf_dir: str) -> str:
    import json

    folder, nations = _place(spark, "corpus"), table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    for region in {r["n_regionkey"] for r in nations}:
        poems = [{"title": r["n_name"], "rhythmic": f"tune {r['n_name']}", "author": f"author {region}" if r["n_nationkey"] % 4 else 7, "paragraphs": [f"line {i}" for i in range(r["n_nationkey"] % 5)] if r["n_nationkey"] % 6 else None, "id": str(r["n_nationkey"])} for r in nations if r["n_regionkey"] == region]
        _put(spark, f"{folder}/poet.x.{region}.json", json.dumps(poems).encode())
        _put(spark, f"{folder}/tones/{region}.json", json.dumps([{"id": p["id"], "strains": ["平仄"] * int(p["id"])} for p in poems if int(p["id"]) % 3] + [{"id": "0"}]).encode())
    for r in table(spark, sf_dir, "region").collect():
        people = [{"name": r["r_name"], "desc": "bio" if r["r_regionkey"] else None}, {"desc": "nameless"}]
        _put(spark, f"{folder}/authors.{r['r_regionkey']}.json", json.dumps(people).encode())
    return folder


# Values of a wrong type come as text where JSON has a number.
_POEMS = "{0} as title, case when n_nationkey % 4 <> 0 then 'author ' || n_regionkey else '7' end as author, cast(n_nationkey % 5 as int) as n_paragraphs, {1} as upstream_id, 'poet.x.' || n_regionkey || '.json' as file from nation where n_nationkey % 6 <> 0"


@C.add("corpus_poems", "select " + _POEMS.format("n_name", "cast(n_nationkey as varchar)"))
def corpus_poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus_files.read_poems(spark, _corpus_folder(spark, sf_dir), "poet.x.")
    return found.select("title", "author", F.size("paragraphs").alias("n_paragraphs"), "upstream_id", "file")


@C.add("corpus_lyrics", "select " + _POEMS.format("'tune ' || n_name", "cast(null as varchar)"))
def corpus_lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus_files.read_poems(spark, _corpus_folder(spark, sf_dir), "poet.x.", title="rhythmic")
    return found.select("title", "author", F.size("paragraphs").alias("n_paragraphs"), "upstream_id", "file")


@C.add("corpus_authors", "select r_name as name, case when r_regionkey <> 0 then 'bio' end as bio, 'd' || r_regionkey as dynasty, 'authors.' || r_regionkey || '.json' as file from region where r_regionkey < 3")
def corpus_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files that are there and one that isn't."""
    files = {f"authors.{i}.json": ("desc", f"d{i}") for i in (0, 1, 2, 9)}
    return corpus_files.read_authors(spark, _corpus_folder(spark, sf_dir), files)


@C.add("corpus_tones", "select cast(n_nationkey as varchar) as upstream_id, n_nationkey as n_strains from nation where n_nationkey % 3 <> 0")
def corpus_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_files.read_tones(spark, _corpus_folder(spark, sf_dir) + "/tones").select("upstream_id", F.size("strains").alias("n_strains"))


@C.add("authors_first_wins", f"select left(sha256(m), 32) as author_id, arg_min(p_name, p_partkey) as name_display, m as name_match, arg_min(p_brand, p_partkey) as dynasty, arg_min(p_type, p_partkey) as bio from (select *, {MATCH.format('p_name')} as m from part) where trim(p_name) <> '' group by m")
def authors_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as names of authors, files in order of the key."""
    raw = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("dynasty"), F.col("p_type").alias("bio"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file"))
    return corpus.authors_of(raw, LETTERS).select("author_id", "name_display", "name_match", "dynasty", "bio")


# Tables and versions.
@C.add("insert_or_ignore", "select o_custkey, coalesce(max(o_orderkey) filter (where o_orderkey % 2 = 0), max(o_orderkey)) as o_orderkey from orders group by o_custkey")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even keys first, then all: what is held stays, of a batch the last counts."""
    orders, path = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), _place(spark, "held")
    tables.insert_or_ignore(orders.where("o_orderkey % 2 = 0"), path, "o_custkey", "o_orderkey")
    tables.insert_or_ignore(orders, path, "o_custkey", "o_orderkey")
    return spark.read.parquet(path)


@C.add("batch_rows_last_wins", "select user_id as job_id, event_id % 10 as row_index, arg_max(event_type, event_id) as status, max(event_id) as finished_at from events group by all")
def batch_rows_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 10).alias("row_index"), F.col("event_type").alias("status"), F.col("event_id").alias("finished_at"))
    return batch.latest(rows)


@C.add("vector_round_trip", "select vec_id as point_id, label, 64 as dim, 2 as version, 'm2' as model_id from embeddings")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions: the second is live, its meta row is no point."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")
    store = vector_store.VectorStore(spark, _place(spark, "vectors"))
    store.write(points.withColumn("label", F.lit(-1)), {"model_id": "m1", "dim": 64})
    version = store.write(points, {"model_id": "m2", "dim": 64})
    vectors.assert_model(store.meta(), {"model_id": "m2", "dim": 64})
    return store.read().select("point_id", "label", F.size("vector").alias("dim"), F.lit(version).alias("version"), F.lit(store.meta()["model_id"]).alias("model_id"))


@C.add("report_round_trip", "select o_orderpriority as name, count(*) as n, cast(null as varchar) as note from orders group by 1")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "report")
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).withColumn("note", F.lit(None).cast("string"))
    tables.report(counted, path)
    return spark.read.schema("name string, n bigint, note string").json(path)


@C.add("orphan_files", "select 'f' || o_orderkey as path, o_custkey as job_id, length(o_orderpriority) as bytes from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_custkey").alias("job_id"), F.length("o_orderpriority").alias("bytes"))
    return batch.orphans(files, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("job_id")))


# Runs and their log.
@C.add("ranked_results", "select l_orderkey as run_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as int) as rank, l_partkey as evidence from lineitem")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return tables.ranked_results(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(listed.alias("evidence")))


@C.add("runs_finalised", f"with {LOG_SQL}, run as (select distinct run_id from log union all select 'none') select run_id, round(sum(cost_usd), 4) as cost_usd, count(distinct flag) as n_flags from run left join log using (run_id) group by run_id")
def runs_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = log(spark, sf_dir)
    runs = whole.select("run_id").distinct().union(spark.createDataFrame([("none",)], "run_id string"))
    return tables.finalised(runs, whole).select("run_id", F.round("cost_usd", 4).alias("cost_usd"), F.coalesce(F.size("final_flags"), F.lit(0)).cast("bigint").alias("n_flags")).withColumn("n_flags", F.greatest("n_flags", F.lit(0)))


@C.add("log_of_run", f"with {LOG_SQL} select run_id, seq, step, phase from log where run_id = '7' and seq > 3")
def log_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.run_events(log(spark, sf_dir), "7", 3).select("run_id", F.col("seq").cast("bigint").alias("seq"), "step", "phase")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_json(F.struct(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("step"), F.lit("completed").alias("phase"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("cost_usd")))
    value = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("oops "), "event_id")).when(F.col("event_id") % 10 == 1, F.lit('{"step": "exact"}')).otherwise(made)
    return table(spark, sf_dir, "events").select(value.alias("value"))


@C.add("relayed_payloads", "select case when event_id % 10 > 1 then cast(user_id as varchar) end as run_id, case when event_id % 10 > 1 then event_id end as seq, case when event_id % 10 > 1 then event_type when event_id % 10 = 1 then 'exact' end as step, case when event_id % 10 > 1 and event_id % 3 > 0 then value end as cost_usd, case event_id % 10 when 0 then 'oops ' || event_id when 1 then '{\"step\": \"exact\"}' end as corrupt from events")
def relayed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.relayed(_payloads(spark, sf_dir)).select("run_id", "seq", "step", "cost_usd", "corrupt")


STREAMED = "select cast(user_id as varchar) as run_id, event_id as seq, event_type as step from events"


@C.add("relay_stream", STREAMED + " where event_id % 10 > 1")
def relay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that arrive twice, through a stream, into the log."""
    place = _place(spark, "relay")
    for part in ("a", "b"):
        _payloads(spark, sf_dir).coalesce(1).write.text(f"{place}/in/{part}")
    payloads = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).text(f"{place}/in")
    stream.relay(payloads, f"{place}/log", f"{place}/checkpoint").awaitTermination()
    return stream.read_log(spark, f"{place}/log").select("run_id", "seq", "step")


def _arrived(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "purchase", "final_answer").otherwise(F.col("event_type")).alias("step"), F.lit("completed").alias("phase"), F.col("value").alias("cost_usd"), (F.col("event_id") % 5).cast("int").alias("agent_iteration"))
    for part in ("a", "b"):
        rows.coalesce(1).write.json(f"{place}/in/{part}")
    return spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{place}/in")


@C.add("stream_to_log", STREAMED.replace("event_type as step", "case when event_type = 'purchase' then 'final_answer' else event_type end as step"))
def stream_to_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice, in two micro-batches; the log has it once."""
    place = _place(spark, "log")
    stream.to_log(_arrived(spark, sf_dir, place), f"{place}/log", f"{place}/checkpoint").awaitTermination()
    return stream.read_log(spark, f"{place}/log").select("run_id", "seq", "step")


@C.add("stream_folded", "select cast(user_id as varchar) as run_id, max(event_id) as last_seq, count(*) as applied, round(sum(value), 4) as total_cost_usd, cast(max(event_id % 5) + 1 as int) as agent_iterations, bool_or(event_type = 'purchase') as finished from events group by 1")
def stream_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stateful fold; of each run the row of its last state."""
    place = _place(spark, "fold")

    def keep(rows: DataFrame, _: int) -> None:
        rows.write.mode("append").parquet(f"{place}/states")

    folded = stream.folded(_arrived(spark, sf_dir, place))
    folded.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{place}/states").groupBy("run_id").agg(F.max_by(F.struct("last_seq", "applied", "total_cost_usd", "agent_iterations", "finished"), "applied").alias("x")).select("run_id", "x.*")
    return last.withColumn("total_cost_usd", F.round("total_cost_usd", 4))


@C.add("stream_numbered", "select cast(user_id as varchar) as run_id, count(*) as events, cast(0 as bigint) as first_seq, count(*) - 1 as last_seq, count(distinct event_id) as ids, count(*) as numbers from events group by 1")
def stream_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice, by two readers with offsets over files of row groups; a run's events get numbers without gap or repeat."""
    place = _place(spark, "numbered")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("event_id"), "ts", F.col("event_type").alias("step"), F.lit("completed").alias("phase"))
    rows.repartitionByRange(4, "event_id").write.parquet(f"{place}/in")
    arrived = [source.read(spark, f"{place}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), groupsPerTrigger="2") for _ in range(2)]
    numbered.until_idle(numbered.to_table(numbered.numbered(arrived[0].unionByName(arrived[1])), f"{place}/out", f"{place}/checkpoint"))
    found = spark.read.parquet(f"{place}/out")
    return found.groupBy("run_id").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("event_id").alias("ids"), F.count_distinct("seq").alias("numbers"))


# Agents: results, evidence, state.
@C.add("result_violations", f"with {LOG_SQL}, result as (select run_id, seq, case k % 3 when 0 then 'no_result' when 1 then 'has_result' else 'low_confidence' end as status, k % 2 as size, k % 4 as result_count from (select l.*, result_count as k from log l)) select run_id, seq, case when status = 'no_result' and size > 0 then 'rows_without_result' when status = 'has_result' and size < 1 then 'result_without_rows' when result_count <> size then 'count' end as rule from result where (status = 'no_result' and size > 0) or (status = 'has_result' and size < 1) or result_count <> size")
def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("result_count")
    status = F.when(k % 3 == 0, "no_result").when(k % 3 == 1, "has_result").otherwise("low_confidence")
    results = log(spark, sf_dir).select("run_id", F.col("seq").cast("bigint").alias("seq"), status.alias("status"), F.when(k % 2 == 1, F.array(F.lit("row"))).otherwise(F.array().cast("array<string>")).alias("rows"), (k % 4).alias("result_count"))
    return agent.violations(results).select("run_id", "seq", "rule")


@C.add("found_evidence_first", "with local as (select distinct l_orderkey as run_id, l_partkey as id from lineitem), found as (select distinct l_orderkey as run_id, l_suppkey as id from lineitem) select run_id, id, 0 as list_ord from found where not exists (select 1 from local where local.run_id = found.run_id and local.id = found.id) union all select run_id, id, 1 from local")
def found_evidence_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    local, found = (lines.select(F.col("l_orderkey").alias("run_id"), F.col(c).alias("id")).distinct() for c in ("l_partkey", "l_suppkey"))
    return agent.with_found(local, found)


@C.add("compact_state", f"with {LOG_SQL}, shown as (select run_id, left('note ' || step || ' ' || result_count || ' of a longer text that is cut', 40) as c, row_number() over (partition by run_id order by seq) as n from log), last as (select run_id, source, arg_max(coalesce(status, 'has_result'), seq) as status from log group by all), statuses as (select run_id, string_agg(source || '=' || status, ';' order by source) as statuses from last group by run_id) select run_id, any_value(statuses) as statuses, string_agg(c, '|' order by n) filter (where n <= 5) as candidates from shown join statuses using (run_id) group by run_id")
def compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("run_id", "seq", "source", F.coalesce("status", F.lit("has_result")).alias("status"), F.lit(0).alias("rank"), F.concat(F.lit("note "), "step", F.lit(" "), "result_count", F.lit(" of a longer text that is cut")).alias("content"))
    made = agent.compact(rows)
    return made.select("run_id", F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("statuses"), F.array_join("candidates", "|").alias("candidates"))


ANSWER = "select o_orderkey, case when flags = 'no_local_result' then 'No confident answer: nothing in the corpus matches' when c is null then 'No confident answer' when flags = 'local_result_found' then coalesce(t, '(untitled)') || ' / ' || coalesce(a, '(unknown)') else coalesce(t, left(c, 30)) || ' / from ' || s end || case when o_custkey % 7 = 0 then ' (partial: the budget ran out)' else '' end as message"


@C.add("answer_messages", f"{ANSWER} from (select *, case when o_custkey % 3 > 0 then o_orderpriority end as t, case when o_custkey % 4 > 0 then 'c' || o_custkey end as a, case when o_orderkey % 5 > 0 then repeat(o_orderpriority, 5) end as c, o_orderstatus as s, case o_orderstatus when 'F' then 'local_result_found' when 'O' then 'no_local_result' else '' end as flags from orders)")
def answer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flag = F.col, F.when(F.col("o_orderstatus") == "F", "local_result_found").when(F.col("o_orderstatus") == "O", "no_local_result").otherwise("")
    message = agent.answer_message(
        F.when(f("o_custkey") % 3 > 0, f("o_orderpriority")), F.when(f("o_custkey") % 4 > 0, F.concat(F.lit("c"), "o_custkey")), F.when(f("o_orderkey") % 5 > 0, F.repeat("o_orderpriority", 5)),
        f("o_orderstatus"), F.array(flag), f("o_custkey") % 7 == 0,
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"))


@C.add("model_responses", f"""with c as (select conv_id as response_id, any_value(case conv_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end) as requested, string_agg(case when conv_id % 4 > 0 then text else '' end, '' order by turn) as text, sum(case when conv_id % 5 = 0 then 1 else 0 end) as tool_calls, max(case when conv_id % 10 = 0 then 1 else 0 end) as bad,
    case when conv_id % 6 > 0 then 100 + max(turn) end as tokens_in, case when conv_id % 6 > 0 then 50 end as tokens_out, case when any_value(conv_id) % 7 = 0 then 'b' else any_value(case conv_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end) end as model from conversations group by conv_id)
    select response_id, model, case when text = '' and tool_calls = 0 then 'error' when tool_calls > 0 then 'tool_use' else 'done' end as status, case when text = '' and tool_calls = 0 then 'empty_reply' end as error_code, length(text) as n_chars, round(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out, 12) as cost_usd,
      concat_ws(';', case when bad > 0 then 'bad_tool_args' end, case when requested <> model then 'model_substituted' end, case when tokens_in is null then 'usage_unavailable' end) as flags from c left join {PRICES.sql} using (model)""")  # fmt: skip
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    asked = F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").otherwise("c")
    chunks = table(spark, sf_dir, "conversations").select(
        i.alias("response_id"), F.col("turn").alias("seq"), asked.alias("requested"), F.when(i % 7 == 0, "b").otherwise(asked).alias("model"), F.when(i % 4 > 0, F.col("text")).alias("text"), (i % 5 == 0).cast("int").alias("tool_calls"),
        ((i % 10 == 0) & (F.col("turn") == 0)).cast("int").alias("bad_arguments"), F.when(i % 6 > 0, 100 + F.col("turn")).alias("tokens_in"), F.when(i % 6 > 0, F.lit(50)).alias("tokens_out"), F.lit(None).cast("bigint").alias("cached"),
    )
    made = agent.responses(chunks, PRICES.frame(spark))
    return made.select("response_id", "model", "status", "error_code", F.length("text").cast("bigint").alias("n_chars"), F.round("cost_usd", 12).alias("cost_usd"), F.array_join("flags", ";").alias("flags"))


@C.add("candidates_merged", "select l_suppkey as query_id, l_partkey as work_id, arg_min(l_linestatus, {'a': l_linenumber, 'b': l_orderkey, 'c': l_quantity, 'd': l_extendedprice, 'e': l_shipdate}) as title, arg_max(l_returnflag, {'a': l_linenumber, 'b': l_orderkey, 'c': l_quantity, 'd': l_extendedprice, 'e': l_shipdate}) as flag, count(distinct l_linenumber) + 1 as n_keys from lineitem group by all")
def candidates_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lacuna.operators import fusion

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("work_id"), F.col("l_linenumber").alias("list_ord"), F.struct("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("position"), F.col("l_linestatus").alias("title"), F.create_map(F.lit("flag"), "l_returnflag", F.concat(F.lit("line"), "l_linenumber"), F.lit("x")).alias("metadata"))
    made = fusion.first_of(rows, ["title"])
    return made.select("query_id", "work_id", "title", F.element_at("metadata", "flag").alias("flag"), F.size("metadata").cast("bigint").alias("n_keys"))


# Additions and jobs.
_STATUS = "case o_orderstatus when 'F' then 'accepted' when 'O' then 'pending' else 'rejected' end"
_ADDED = f"added as (select o_orderkey as addition_id, {_STATUS} as status, case when o_custkey % 2 = 0 then 'user' else 'agent' end as origin, o_orderdate as created_at from orders)"


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("addition_id"), status.alias("status"), F.when(F.col("o_custkey") % 2 == 0, "user").otherwise("agent").alias("origin"), F.col("o_orderdate").alias("created_at"))


@C.add("additions_listed", f"with {_ADDED} select * from added where status = 'pending' and origin = 'agent' order by created_at desc, addition_id limit 50 offset 5")
def additions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additions.listed(_added(spark, sf_dir), "pending", "agent", 50, 5)


@C.add("additions_reviewed", f"with {_ADDED}, decided as (select o_orderkey as addition_id, case o_custkey % 3 when 0 then 'accepted' when 1 then 'rejected' else 'odd' end as decision from orders where o_orderkey % 2 = 0) select addition_id, case when status = 'pending' and decision in ('accepted', 'rejected') then decision else status end as status, case when decision is null then null when status <> 'pending' then 'not_pending' when decision = 'odd' then 'bad_decision' else 'applied' end as review from added left join decided using (addition_id)")
def additions_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("o_custkey") % 3 == 0, "accepted").when(F.col("o_custkey") % 3 == 1, "rejected").otherwise("odd")
    decided = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("addition_id"), decision.alias("decision"))
    return additions.reviewed(_added(spark, sf_dir), decided).select("addition_id", "status", "review")


ISSUES = "select doc_id, concat_ws(';', case when doc_id % 2 = 0 then 'unknown:extra' end, case when doc_id % 5 = 0 then 'unknown:odd' end, case when length(left(text, n_chars % 3000)) > 2000 then 'long:note' end, case when doc_id % 3 = 1 then 'url:source_url' end) as issues from documents"


@C.add("addition_strict_issues", ISSUES)
def addition_strict_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("http://a.b/"), i)).when(i % 3 == 1, "nope")
    payload = F.to_json(F.struct(F.col("lang").alias("title"), F.col("source").alias("author"), "text", F.expr("left(text, int(n_chars % 3000))").alias("note"), url.alias("source_url"), F.when(i % 2 == 0, "x").alias("extra"), F.when(i % 5 == 0, "y").alias("odd")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(additions.strict_issues(payload), ";").alias("issues"))


MOVES = Inline({"status": "varchar", "wanted": "varchar"}, *[(a, b) for a, after in batch.TRANSITIONS.items() for b in after])


@C.add("job_moves", f"with job as (select o_orderkey as job_id, ['scanned', 'running', 'done', 'cancelled', 'failed', 'interrupted'][1 + o_orderkey % 6] as status, ['scanned', 'running', 'done', 'cancelled', 'failed', 'interrupted'][1 + o_custkey % 6] as wanted from orders) select job_id, coalesce(case when m.status is not null then wanted end, job.status) as status, m.status is null as refused from job left join {MOVES.sql} m using (status, wanted)")
def job_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, batch.TRANSITIONS))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.get(names, F.col("o_orderkey") % 6).alias("status"), F.get(names, F.col("o_custkey") % 6).alias("wanted"))
    return batch.moved(jobs).select("job_id", "status", "refused")


# Functions on records.
@C.add("camel_names", 'select n_nationkey as "nNationkey", n_name as "nName", n_regionkey as "nRegionkey" from nation')
def camel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.convert_names(table(spark, sf_dir, "nation"), records.to_camel)


@C.add("cell_texts", "select conv_id, turn, case turn % 5 when 0 then trim(role || ' ' || conv_id || '  ') when 1 then cast(conv_id as varchar) when 2 then 'true' else '' end as cell from conversations")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") % 5
    body = F.when(t == 0, F.concat(F.lit('"  '), "role", F.lit(" "), "conv_id", F.lit('  "'))).when(t == 1, F.col("conv_id").cast("string")).when(t == 2, "true").when(t == 3, '{"a": 1}').otherwise("null")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cell_text(F.try_parse_json(body)).alias("cell"))


@C.add("embed_texts", "select doc_id, concat_ws(chr(10), case when doc_id % 4 > 0 then lang end, case when doc_id % 3 > 0 then nullif(source, '') end, nullif(text, '')) as t from documents")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = text.embed_text(F.when(F.col("doc_id") % 4 > 0, F.col("lang")).otherwise(F.lit("")), F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))


@C.add("matched_texts", "select doc_id, case when doc_id % 5 = 0 or substr(text, cast(doc_id % 40 + 1 as bigint), cast(doc_id % 9 as bigint)) = '' then text else substr(text, cast(doc_id % 40 + 1 as bigint), cast(doc_id % 9 as bigint)) end as matched from documents")
def matched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("int")
    start = F.when(i % 5 > 0, i % 40)
    return table(spark, sf_dir, "documents").select("doc_id", text.matched_text(F.col("text"), start, start + i % 9).alias("matched"))


@C.add("traces_rendered", "select event_id, case when event_id % 4 = 0 then 'none' when event_id % 4 = 1 then 'Found ' || user_id || ' of {m}' when event_id % 4 = 2 then 'All: Found ' || user_id || ' of {m}; Found 1 of 2' else 'none' end as message from events")
def traces_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.concat(F.lit('{"code": "found", "params": {"n": '), "user_id", F.lit("}}"))
    i = F.col("event_id") % 4
    message = F.when(i == 1, found).when(i == 2, F.concat(F.lit('{"code": "all", "parts": ['), found, F.lit(', {"code": "found", "params": {"n": 1, "m": 2}}, {"code": "odd"}]}'))).when(i == 3, F.lit('{"code": "odd"}'))
    return table(spark, sf_dir, "events").select("event_id", records.rendered(message, {"found": "Found {n} of {m}", "all": "All: {parts}"}, "none").alias("message"))


@C.add("verdicts_in_prose", "select event_id, case when event_id % 5 > 1 then 'sufficient' end as verdict, case when event_id % 5 > 1 then (event_id % 100) / 100.0::double end as confidence, case when event_id % 5 > 1 then event_type end as notes, case when event_id % 5 > 1 then cast(event_id % 3 as int) end as n_gaps from events")
def verdicts_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    body = F.to_json(F.struct(F.when(i % 5 == 1, "maybe").otherwise("sufficient").alias("verdict"), ((i % 100) / 100).alias("confidence"), F.col("event_type").alias("notes"), F.array_repeat(F.lit("gap"), (i % 3).cast("int")).alias("gaps")))
    prose = F.when(i % 5 == 0, "I can't tell {that is all").otherwise(F.concat(F.lit("Well {so far}: "), body, F.lit(" - that's it {}")))
    found = table(spark, sf_dir, "events").select("event_id", records.verdicts(prose).alias("v"))
    return found.select("event_id", "v.verdict", "v.confidence", "v.notes", F.when(F.col("v.verdict").isNotNull(), F.size("v.gaps")).alias("n_gaps"))


@C.add("arguments_redacted", "select event_id, '[redacted]' as api_key, event_type as query, case when event_id % 2 = 0 then '[redacted]' end as token from events")
def arguments_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("api_key").alias("k"), F.col("user_id").cast("string").alias("v")), F.struct(F.lit("query").alias("k"), F.col("event_type").alias("v")), F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("token").alias("k"), F.lit("secret").alias("v"))))))
    hidden = table(spark, sf_dir, "events").select("event_id", records.redacted(given, ["api_key", "token"]).alias("m"))
    return hidden.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("api_key", "query", "token")])


@C.add("matches_highlighted", "select doc_id, case when strpos(text, 'the') > 0 then substr(text, 1, strpos(text, 'the') - 1) || '[the]' || substr(text, strpos(text, 'the') + 3) else text end as shown from documents")
def matches_highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.highlighted(F.col("text"), F.array(F.lit("the"), F.lit(""))).alias("shown"))


# Models as plug-ins, and the stored indexes.
@C.add("embedded_documents", "select doc_id, case when regexp_matches(text, '[^ \\t\\n\\r\\x0b\\x0c]') then 64 end as dim, case when regexp_matches(text, '[^ \\t\\n\\r\\x0b\\x0c]') then 1.0::double end as norm from documents")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = service.embedded(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), "text", service.HashEmbedder, "hash-64")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return made.select("doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"), F.round(norm, 4).alias("norm"))


@C.add("vector_index_recall", "select count(*) as queries, true as enough, true as at_most_a_fifth from embeddings where vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes hold every point; they find 0.9 or more of the true ten nearest and read a fifth of the vectors' bytes at most."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    queries = points.where("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), "vector")
    coded = vectors.Coded.of(points, vectors.Quantiser.trained(points))
    near, read = coded.search(queries, 10)
    true = vectors.search(queries, points, 10).select("query_id", "point_id")
    met = true.join(near.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    recall = met.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))
    return recall.join(read.agg((F.max(F.col("bytes_read") / F.col("bytes_all")) <= 0.2).alias("at_most_a_fifth")))
