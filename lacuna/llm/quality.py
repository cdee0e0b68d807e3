"""Quality rules as a short-circuit cascade of expressions.

All rules are expressions over a few counts of a text. On a sample, the rows of the lowest hash, the cost of each rule is
measured (the seconds of a job that evaluates it many times over the sample, less those of a job that evaluates nothing)
and so is what it rejects. The cascade then takes, again and again, the rule with the most rejections per second among the
texts that are left, and a text that one rejects is spared the others. The order changes the cost and never the verdict;
failed_rule, the first that rejected, follows the order, so a run that has to repeat it passes its rules in.

Counts that a rule doesn't share are inside its own expression, so that a rule that isn't reached costs nothing.
The order of the base rules (too few words, too many repeated words) is fixed: their counts are asked for anyway.

Cases: a null or empty text has no words, fails the base rules and isn't kept. Lines are split at \\n; a line without
a word never counts as a repeated line. Words are runs of anything but space and 0x09-0x0D. Columns pass through, those
named like a result are replaced. Of rules worth the same the first listed comes first. An empty table gives an empty result, and the rules keep their listed order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept", "failed_rule")


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition under which a text is rejected; {g} stands where some engines ask for a flag."""

    name: str
    rejects: str


RULES = (
    Rule("mean_word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("repeated_words", "100 * n_repeat_words > 35 * n_words"),
    Rule("capitals", "10 * length(regexp_replace(text, '[^A-Z]', ''{g})) > 4 * word_chars"),
    Rule("digits", "10 * length(regexp_replace(text, '[^0-9]', ''{g})) > 2 * word_chars"),
    Rule("ellipses", "10 * (length(text) - length(replace(text, '...', ''))) > 9 * n_lines"),
    Rule("no_sentence", "text not like '%.%' and text not like '%!%' and text not like '%?%'"),
)


def let(value: Column, body) -> Column:
    """Evaluate a value once for all its uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that stand in the text twice or more.

    Windows are sorted by content and place; those that equal a neighbour are repeated. By place, each covers its
    three words less those that the next one covers: n log n in the length of the text, however much it repeats.
    """

    def covered(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def places(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        def total(p: Column) -> Column:
            each = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(3)), F.lit(3)))
            return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)

        return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(hashes), lambda s: let(places(s), total)))

    return let(words, covered)


def measured(documents: DataFrame) -> DataFrame:
    """Append the base counts."""
    documents = documents.drop(*RESULT)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SOLID))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    with_counts = documents.withColumn("__counts", let(words_of(text), counts))
    c = F.col("__counts")
    return with_counts.withColumns({"n_words": c["n_words"], "word_chars": c["word_chars"], "n_symbols": c["n_symbols"], "n_dup_lines": c["lines"]["dup"], "n_repeat_words": c["n_repeat_words"], "n_lines": c["lines"]["n"]}).drop("__counts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def condition(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects.replace("{g}", "")), F.lit(False))


def cascade(patterns: list[tuple[tuple[bool, ...], int]], costs: list[float]) -> list[int]:
    """The order of rules: patterns say which rules reject how many texts; each step takes the most rejections per cost that are left."""
    rest, order = list(range(len(costs))), []
    while rest:
        best = max(rest, key=lambda i: (sum(n for p, n in patterns if p[i]) / costs[i], -i))
        order.append(best)
        rest.remove(best)
        patterns = [(p, n) for p, n in patterns if not p[best]]
    return order


def ordered(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, repeat: int = 8) -> list[Rule]:
    """The rules in the order of the cascade, measured on sample_rows rows, each evaluated `repeat` times."""
    hashed = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map" not in f.dataType.simpleString()]
    rows = documents.select("text", F.xxhash64(*hashed).alias("__h"))
    lowest = rows.select("__h").orderBy("__h").limit(sample_rows).agg(F.max("__h")).first()[0]  # hashes alone meet in one task
    if lowest is None:
        return list(rules)
    sample = rows.where(F.col("__h") <= lowest).limit(sample_rows).drop("__h")
    taken = measured(sample).where(~base_failed()).select("text", *RESULT[:6]).persist()
    try:
        rejected = [condition(r).alias(f"r{i}") for i, r in enumerate(rules)]
        got = taken.select(*rejected).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()
        patterns = [(tuple(r[: len(rules)]), r["count"]) for r in got]
        if not patterns:
            return list(rules)
        many = taken.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

        def seconds(what: Column) -> float:
            spent = []
            for _ in range(2):
                began = time.perf_counter()
                many.agg(F.count_if(what)).collect()
                spent.append(time.perf_counter() - began)
            return min(spent)

        nothing = seconds(F.col("__i") < 0)
        costs = [max(seconds(condition(r)) - nothing, 0.02 * nothing) for r in rules]
    finally:
        taken.unpersist()
    return [rules[i] for i in cascade(patterns, costs)]


def judge(documents: DataFrame, rules: list[Rule] | tuple[Rule, ...] | None = None) -> DataFrame:
    """documents with the base counts, base_failed, kept and failed_rule (the first that rejected) appended."""
    rules = ordered(documents) if rules is None else rules
    frame = measured(documents).withColumn("base_failed", base_failed())
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        failed = failed.when(condition(rule), F.lit(rule.name))
    return frame.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())
