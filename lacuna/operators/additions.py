"""Additions to the corpus: validation, duplicates, proposals, review and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.config import HAN, Profile
from lacuna.functions import keys, text
from lacuna.operators import corpus

# Bounds of an addition.
LEAST_HAN, MOST_HAN, MOST_TITLE = 4, 4000, 200
LENGTHS = {"title": 200, "author": 200, "dynasty": 100, "form": 100, "note": 2000}
FIELDS = ("title", "author", "text", "dynasty", "form", "note", "source_url")
STATUSES, ORIGINS = ("pending", "accepted", "rejected"), ("user", "agent")


def refusals(title: Column, author: Column, body: Column) -> Column:
    """Codes of all that is wrong with a row, in order; empty where it is fine."""
    t, a, b = (F.trim(F.coalesce(x, F.lit(""))) for x in (title, author, body))
    han = text.han_count(b)
    some = b != ""
    return F.array_compact(F.array(
        F.when(t == "", "title"), F.when(a == "", "author"), F.when(b == "", "text"),
        F.when(some & (han < LEAST_HAN), "text_han").when(some & (han > MOST_HAN), "text_long"), F.when(F.length(t) > MOST_TITLE, "title_long"),
    ))


def strict_issues(payload: Column) -> Column:
    """Names of fields of a JSON object (as text) that are unknown, too long or no URL."""
    fields = F.from_json(payload, "map<string,string>")
    unknown = F.transform(F.array_except(F.map_keys(fields), F.array(*map(F.lit, FIELDS))), lambda k: F.concat(F.lit("unknown:"), k))
    long = F.array_compact(F.array(*[F.when(F.length(F.element_at(fields, k)) > n, f"long:{k}") for k, n in LENGTHS.items()]))
    url = F.element_at(fields, "source_url")
    bad = F.array_compact(F.array(F.when(url.isNotNull() & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/]+"), "url:source_url")))
    return F.concat(F.array_sort(unknown), long, bad)


def prepared(rows: DataFrame, profile: Profile = HAN) -> DataFrame:
    """rows (title, author, text, ...) with refusals, text_match and content_hash."""
    frame = rows.withColumn("missing", refusals(F.col("title"), F.col("author"), F.col("text"))).withColumn("text_match", text.match_form(F.coalesce("text", F.lit("")), profile))
    return frame.withColumn("content_hash", keys.addition_hash(F.trim("title"), F.trim("author"), F.col("text_match")))


def added(rows: DataFrame, held: DataFrame, profile: Profile = HAN) -> DataFrame:
    """rows with `result`: added, duplicate (of the corpus or of an earlier row) or error."""
    from pyspark.sql import Window

    frame = prepared(rows, profile)
    known = frame.join(held.select("content_hash", F.lit(True).alias("held")).distinct(), "content_hash", "left")
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("row_index"))
    result = F.when(F.size("missing") > 0, "error").when(F.coalesce("held", F.lit(False)) | (nth > 1), "duplicate").otherwise("added")
    return known.withColumn("result", result).drop("held")


def grown(library: corpus.Corpus, accepted: DataFrame) -> corpus.Corpus:
    """A corpus with accepted additions (title, author, text, content_hash, origin) in all of its tables.

    An addition is a work of its own, its lines are those seen in its text, and its author is added where unknown. Additions
    that the corpus holds by now, and those without a line that has a match form, stay out."""
    profile = library.profile
    title, author = (F.trim(c) for c in ("title", "author"))
    seen = accepted.withColumn("lines", text.visual_lines(F.col("text"))).withColumn("line_forms", text.match_forms(F.col("lines"), profile))
    kept = F.filter(F.arrays_zip("lines", "line_forms"), lambda x: F.length(x["line_forms"]) > 0)
    rows = seen.withColumn("kept", kept).withColumns({c: F.transform("kept", lambda x: x[c]) for c in ("lines", "line_forms")}).where(F.size("lines") > 0)
    if "content_hash" in library.poems.columns:
        rows = rows.join(library.poems.select("content_hash"), "content_hash", "left_anti")
    formed = rows.select(
        F.col("content_hash").alias("poem_id"), F.concat(F.lit("added:"), F.substring("content_hash", 1, 32)).alias("work_id"), title.alias("title"), author.alias("author"),
        text.match_form(author, profile).alias("author_match"), F.when(F.col("origin") == "agent", "agent-proposed").otherwise("user-added").alias("dataset"), F.col("text").alias("text_display"),
        text.match_form(F.col("text"), profile).alias("text_match"), "content_hash", "lines", "line_forms", F.size("lines").alias("line_count"),
    ).withColumn("char_count", F.length("text_match"))
    named = formed.select(F.sha2("author_match", 256).substr(1, 32).alias("author_id"), F.col("author").alias("name_display"), F.col("author_match").alias("name_match"), F.col("dataset").alias("source_file"))
    new = corpus.last_by(named.join(library.authors.select("name_match"), "name_match", "left_anti"), "name_match", F.col("name_display"))
    authors = library.authors.unionByName(new, allowMissingColumns=True)
    formed = formed.join(authors.select("author_id", F.col("name_match").alias("author_match")), "author_match", "left")
    poems = formed.drop("lines", "line_forms")
    return corpus.Corpus(
        library.works.unionByName(formed.select("work_id", "title", "author_id"), allowMissingColumns=True), authors,
        library.poems.unionByName(poems.select(*[c for c in poems.columns if c in library.poems.columns]), allowMissingColumns=True),
        library.lines.unionByName(corpus.lines_of(formed), allowMissingColumns=True), profile,
    )


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("result").agg(F.count("*").alias("n"))


def proposal_gate(verdict: Column, local_found_nothing: Column, url: Column, retrieved: Column, missing: Column, duplicate: Column) -> Column:
    """The first gate that stops an agent's proposal; null where it passes all five."""
    return (
        F.when(~(F.coalesce(verdict, F.lit("")) == "sufficient"), "verdict")
        .when(~local_found_nothing, "local_answered")
        .when(url.isNull() | ~F.coalesce(F.array_contains(retrieved, url), F.lit(False)), "url_not_retrieved")
        .when(F.size(missing) > 0, "rules")
        .when(duplicate, "duplicate")
    )


def reviewed(additions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Additions after decisions (addition_id, decision): only pending ones change; `review` says what became of each decision."""
    met = additions.join(decisions, "addition_id", "left")
    allowed = (F.col("status") == "pending") & F.col("decision").isin("accepted", "rejected")
    review = F.when(F.col("decision").isNull(), None).when(allowed, "applied").when(F.col("status") != "pending", "not_pending").otherwise("bad_decision")
    return met.withColumns({"review": review, "status": F.when(allowed, F.col("decision")).otherwise(F.col("status"))}).drop("decision")


def listed(additions: DataFrame, status: str | None = None, origin: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Additions, newest first, under optional filters; "all" is no filter and other unknown values are refused."""
    for value, known in ((status, STATUSES), (origin, ORIGINS)):
        if value not in (None, "all", *known):
            raise ValueError(f"no such value: {value}")
    frame = additions
    if status not in (None, "all"):
        frame = frame.where(F.col("status") == status)
    if origin not in (None, "all"):
        frame = frame.where(F.col("origin") == origin)
    return frame.orderBy(F.desc("created_at"), "addition_id").offset(offset).limit(limit)


def counts(additions: DataFrame) -> DataFrame:
    return additions.groupBy("status", "origin").agg(F.count("*").alias("n"))


def corpus_counts(poems: DataFrame) -> DataFrame:
    """One row: all poems, those that users added, and those that agents proposed."""
    return poems.agg(F.count("*").alias("total"), F.count_if(F.col("dataset") == "user-added").alias("user_added"), F.count_if(F.col("dataset") == "agent-proposed").alias("agent_added"))
