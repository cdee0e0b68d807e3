"""BM25 over character bigrams, through bigram postings.

A term's document frequency counts the documents it was looked up in, hits_per_term at most and in order of poem id, so
the result is the same from run to run; `true_df` counts them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import Profile
from lacuna.functions import numbers, text
from lacuna.operators import corpus

BROADCAST_TERMS = 500_000


def terms(queries: DataFrame, profile: Profile, every: bool = False) -> DataFrame:
    """queries (query_id, text) to (query_id, term): the first distinct bigrams of the match form, or every one."""
    return queries.select("query_id", F.explode(text.query_terms(text.match_form(F.col("text"), profile), None if every else profile.query_terms)).alias("term"))


def term_hits(wanted: DataFrame, poems: DataFrame, profile: Profile, true_df: bool = False, index: corpus.Index | None = None) -> DataFrame:
    """(term, poem_id, work_id, char_count, n): documents of each wanted term and how many of them there are.

    What scores need of a document travels with its postings, so the corpus is read once and never joined again; the cap
    is applied before the shuffle as well as after it. Only stored postings leave out the work, which is named after the cap."""
    distinct = wanted.select("term").distinct()
    if distinct.count() <= BROADCAST_TERMS:
        distinct = F.broadcast(distinct)
    stored = corpus.touched(index.terms, distinct, "term", index.buckets) if index else corpus.term_postings(poems)
    met = stored.join(distinct, "term")
    of_term = Window.partitionBy("term")
    if true_df:
        counts = met.groupBy("term").agg(F.count("*").alias("n"))
        return named(met.join(F.broadcast(counts) if distinct.count() <= BROADCAST_TERMS else counts, "term"), index)
    capped = met.withColumn("k", F.row_number().over(of_term.orderBy("poem_id"))).where(F.col("k") <= profile.hits_per_term).drop("k")
    return named(capped.withColumn("n", F.count("*").over(of_term)), index)


def named(met: DataFrame, index: corpus.Index | None) -> DataFrame:
    """Documents of stored postings with their works."""
    return met.join(index.works.select("poem_id", "char_count", "work_id"), ["poem_id", "char_count"]) if index else met


def search(queries: DataFrame, poems: DataFrame, profile: Profile, limit: int = 50, true_df: bool = False, index: corpus.Index | None = None) -> DataFrame:
    """(query_id, poem_id, work_id, matched_terms, score, position): the best `limit` of the 4 * limit with most terms."""
    wanted = terms(queries, profile)
    stats = F.broadcast(index.stats if index else corpus.stats(poems))
    found = wanted.join(term_hits(wanted, poems, profile, true_df, index), "term").join(stats)
    part = numbers.bm25_term(F.lit(1.0), F.col("char_count"), F.col("avg_doc_len"), numbers.idf(F.col("n"), F.col("total_docs")))
    scored = found.groupBy("query_id", "poem_id", "work_id").agg(F.count("*").alias("matched_terms"), F.round(F.sum(part), 9).alias("score"))
    most = Window.partitionBy("query_id").orderBy(F.desc("matched_terms"), "poem_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "poem_id")
    narrowed = scored.withColumn("k", F.row_number().over(most)).where(F.col("k") <= 4 * limit).drop("k")
    return narrowed.withColumn("position", F.row_number().over(best) - 1).where(F.col("position") < limit)
