"""URL filters: rules on hosts and paths, and gradient-boosted trees on lexical features for the URLs no rule names.

Everything is DataFrame expressions. A rule is (action, host, path): it fits its host and all subdomains where the
URL's path starts with its own; the longest rule that fits wins, and the first listed among equals. URLs that a rule
decides are the labelled ones: at most `max_rows` of them, those of the lowest hash, teach the trees; one in `folds` is
held out. Features are lengths, depth, digit ratio, entropy of the characters, numbers of parameters and labels, and how
often URLs of the same suffix were blocked. That rate is cross-fitted: a URL that teaches gets the rate of the other
folds, so its own label is no part of its features. What the rules look at besides the suffix, hosts and first path
segments, is left out: such features only retell the rules and say nothing about URLs that no rule decides.

Each feature is cut into bins at sample quantiles; a level of a tree is one aggregation of gradients by node, feature
and bin, so the driver sees histograms and never rows. The finished trees are one CASE expression over bins. The
threshold is the one of the best balanced accuracy on the URLs held out, where the area under the curve is measured too.

Cases: a null URL, or one without ://, has an empty host and path, no rule, and gets the trees' verdict from its
other features. Without labelled URLs of both kinds the trees say what the labelled ones say, or allow; where those held
out are of one kind, the threshold is that of the settings. Of equally good splits the first feature by name and the
lowest bin wins, of equally good thresholds the lowest. Repeated rows are judged alike. Columns pass through, those named
like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.storage import keep

Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES: tuple[Rule, ...] = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
RESULT = ("host", "path", "rule", "verdict", "block_score")


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000
    trees: int = 12
    depth: int = 3
    bins: int = 16
    rate: float = 0.4
    l2: float = 1.0
    least: float = 1.0
    prior_rows: float = 20.0
    folds: int = 5
    threshold: float = 0.5


def parsed(pages: DataFrame) -> DataFrame:
    """Append host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.drop(*RESULT).withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def fitting(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The rule that wins and its action, or nulls."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(order):
        act, host, path = rules[i]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, action = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def lexical(frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """Append the features that need nothing but the URL, and the suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.split(url, "")
    length = F.length(url)
    labels = F.split("host", r"\.")
    entropy = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: (length - F.length(F.replace(url, c, F.lit("")))).cast("double")),
        F.lit(0.0),
        lambda total, n: total - F.when(n > 0, n / length * F.log2(n / length)).otherwise(F.lit(0.0)),
    )
    made = {
        "f_length": length,
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_labels": F.size(labels),
        "f_depth": F.regexp_count("path", F.lit("/[^/]")),
        "f_digits": F.coalesce(F.regexp_count(url, F.lit("[0-9]")) / F.nullif(length, F.lit(0)), F.lit(0.0)),
        "f_entropy": F.when(length > 0, entropy).otherwise(F.lit(0.0)),
        "f_parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(F.lit(0)),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("int"),
        "f_hyphens": F.regexp_count("host", F.lit("[-_]")),
        "f_last_number": F.coalesce(F.length(F.regexp_extract("path", r"([0-9]+)[^0-9/]*/?$", 1)), F.lit(0)),
    }
    frame = frame.withColumns({k: v.cast("double") for k, v in made.items()} | {"suffix": F.xxhash64(F.element_at(labels, -1))})
    return frame, [*made, "f_suffix"]


def rates(sample: DataFrame, s: Settings) -> DataFrame:
    """(fold, suffix, rate): how often URLs of a suffix are blocked in the sample, drawn towards the mean of all.

    For a fold, its own rows are left out; fold -1 has all. At most max_rows * folds rows of three numbers."""
    by = sample.groupBy("suffix", "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    folds = F.explode(F.sequence(F.lit(-1), F.lit(s.folds - 1)))
    others = by.select("suffix", "y", "n", "fold", folds.alias("for")).where("for != fold")
    whole = others.groupBy("for").agg((F.sum("y") / F.sum("n")).alias("mean")).withColumnRenamed("for", "of")
    drawn = others.groupBy("for", "suffix").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).join(F.broadcast(whole), F.col("for") == F.col("of"))
    return drawn.select(F.col("for").alias("fold"), "suffix", ((F.col("y") + s.prior_rows * F.col("mean")) / (F.col("n") + s.prior_rows)).alias("rate"))


def with_rate(frame: DataFrame, known: DataFrame, mean: float) -> DataFrame:
    """Append f_suffix by (fold, suffix); an unknown suffix has the mean."""
    known = F.broadcast(known.select(F.col("fold").alias("__fold"), F.col("suffix").alias("__suffix"), "rate"))
    joined = frame.join(known, (F.col("fold") == F.col("__fold")) & (F.col("suffix") == F.col("__suffix")), "left")
    return joined.withColumn("f_suffix", F.coalesce("rate", F.lit(mean))).drop("__fold", "__suffix", "rate")


@dataclass(frozen=True)
class Tree:
    """Splits by heap position: (feature, bin); leaves by heap position: value."""

    splits: dict[int, tuple[str, int]]
    leaves: dict[int, float]

    def column(self, node: int = 1) -> Column:
        if node in self.leaves:
            return F.lit(self.leaves[node])
        name, cut = self.splits[node]
        return F.when(F.col(name) <= cut, self.column(2 * node)).otherwise(self.column(2 * node + 1))

    def place(self, node: int = 1) -> Column:
        if node not in self.splits:
            return F.lit(node)
        name, cut = self.splits[node]
        return F.when(F.col(name) <= cut, self.place(2 * node)).otherwise(self.place(2 * node + 1))


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...]
    cuts: dict[str, list[float]]
    rates: DataFrame | None = None
    mean: float = 0.5
    threshold: float = 0.5
    auc: float | None = None

    def featured(self, frame: DataFrame) -> DataFrame:
        """Append the bins that the trees ask for to a frame with url, host and path."""
        frame, _ = lexical(frame)
        if not self.trees:
            return frame
        return _binned(with_rate(frame.withColumn("fold", F.lit(-1)), self.rates, self.mean).drop("fold"), self.cuts)

    def margin(self) -> Column:
        return reduce(lambda total, t: total + t.column(), self.trees, F.lit(self.base))


def _binned(frame: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Append the bin of each feature: how many of its cuts lie below the value."""
    bins = {}
    for name, at in cuts.items():
        column = F.lit(len(at))
        for i in reversed(range(len(at))):
            column = F.when(F.col(name) <= at[i], F.lit(i)).otherwise(column)
        bins[name.replace("f_", "b_", 1)] = column
    return frame.withColumns(bins)


def quality(margins: list[tuple[float, float, int]], default: float) -> tuple[float, float | None]:
    """(margin, blocked, all) of URLs held out to the threshold of the best balanced accuracy and the area under the curve."""
    margins = sorted(margins)
    ones = sum(y for _, y, _ in margins)
    zeros = sum(n for *_, n in margins) - ones
    if not ones or not zeros:
        return default, None
    below_ones = below_zeros = area = 0.0
    best = (0.5, default)
    for at, (m, y, n) in enumerate(margins):
        gain = ((ones - below_ones) / ones + below_zeros / zeros) / 2  # block from this margin on
        if gain > best[0] + 1e-9:
            cut = m if not at else (m + margins[at - 1][0]) / 2
            best = (gain, 1 / (1 + math.exp(-max(-30.0, min(30.0, cut)))))
        area += y * (below_zeros + (n - y) / 2)
        below_ones, below_zeros = below_ones + y, below_zeros + n - y
    return best[1], area / (ones * zeros)


def grow(histogram: list, splits: dict, sums: dict, s: Settings) -> None:
    """One level: the best split of each node from its (node, feature, bin, g, h)."""
    nodes: dict[int, dict[str, list]] = {}
    for r in histogram:
        nodes.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
    for node, by in sorted(nodes.items()):
        first = by[min(by)]
        gt, ht = sum(x[1] for x in sorted(first)), sum(x[2] for x in sorted(first))
        sums[node] = (gt, ht)
        best = (1e-6, None, None, None)
        for feature in sorted(by):
            gl = hl = 0.0
            for b, g, h in sorted(by[feature])[:-1]:
                gl, hl = gl + g, hl + h
                if min(hl, ht - hl) < s.least:
                    continue
                gain = gl * gl / (hl + s.l2) + (gt - gl) ** 2 / (ht - hl + s.l2) - gt * gt / (ht + s.l2)
                if gain > best[0] + 1e-9:
                    best = (gain, feature, b, (gl, hl))
        if best[1]:
            splits[node] = (best[1], best[2])
            sums[2 * node], sums[2 * node + 1] = best[3], (gt - best[3][0], ht - best[3][1])


def prepared(judged: DataFrame, s: Settings) -> tuple[DataFrame, list[str], DataFrame, float | None]:
    """The labelled sample with all features and its fold, their names, the rates of suffixes and the mean of those that teach."""
    sample = judged.where("action is not null").orderBy(F.xxhash64("url"), "url").limit(s.max_rows)
    sample, names = lexical(sample.select("url", "host", "path", (F.col("action") == "block").cast("double").alias("y")))
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(s.folds)), F.lit(s.folds)).cast("int"))
    sample = keep(sample.drop("url", "host", "path"), "urlfilter-sample")
    teaching = sample.where("fold > 0")
    mean = teaching.agg(F.avg("y")).first()[0]
    known = keep(rates(teaching, s), "urlfilter-rates")
    # those held out are no part of any rate; fold -1 has all that teach
    sample = with_rate(sample.withColumn("of", F.col("fold")).withColumn("fold", F.when(F.col("fold") == 0, F.lit(-1)).otherwise(F.col("fold"))), known, mean or 0.0)
    return sample.drop("fold").withColumnRenamed("of", "fold"), names, known, mean


def fit(judged: DataFrame, s: Settings = Settings()) -> Model:
    """judged: url, host, path and action (block, allow or null)."""
    sample, names, known, mean = prepared(judged, s)
    if mean is None or mean in (0.0, 1.0):
        return Model(-20.0 if not mean else 20.0, (), {}, threshold=s.threshold)
    quantiles = [(i + 1) / s.bins for i in range(s.bins - 1)]
    found = sample.where("fold > 0").agg(*[F.percentile(n, F.array(*map(F.lit, quantiles))).alias(n) for n in names]).first()
    cuts = {n: sorted(set(found[n])) for n in names}
    bins = [n.replace("f_", "b_", 1) for n in cuts]
    rows = keep(_binned(sample, cuts).select("y", "fold", *bins).coalesce(2), "urlfilter-bins").persist()
    try:
        base = math.log(mean / (1 - mean))
        trees: list[Tree] = []
        for _ in range(s.trees):
            p = 1 / (1 + F.exp(-Model(base, tuple(trees), {}).margin()))
            graded = rows.where("fold > 0").select(*bins, (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
            splits: dict[int, tuple[str, int]] = {}
            leaves: dict[int, float] = {}
            sums: dict[int, tuple[float, float]] = {}
            for level in range(s.depth):
                at = Tree(splits, leaves).place()
                each = F.explode(F.array(*[F.struct(F.lit(b).alias("feature"), F.col(b).alias("bin")) for b in bins]))
                placed = graded.select(at.alias("node"), "g", "h", each.alias("f")).where(F.col("node") >= 2**level)
                grow(placed.groupBy("node", "f.feature", "f.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect(), splits, sums, s)
            for node, (g, h) in sums.items():
                if node not in splits:
                    leaves[node] = round(s.rate * g / (h + s.l2), 6)
            trees.append(Tree(splits, leaves))
            if not splits:
                break
        margin = F.round(Model(base, tuple(trees), {}).margin(), 3).alias("m")
        held = rows.where("fold = 0").groupBy(margin).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    finally:
        rows.unpersist()
    threshold, auc = quality([(r["m"], r["y"], r["n"]) for r in held], s.threshold)
    return Model(base, tuple(trees), cuts, known.where("fold = -1"), mean, threshold, auc)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, s: Settings = Settings()) -> DataFrame:
    """pages with host, path, rule, verdict and block_score appended."""
    name, action = fitting(rules)
    kept = [c for c in pages.columns if c.lower() not in (*RESULT, "url")]
    others = [F.struct(*kept).alias("others")] if kept else []  # their names can't clash with those of features
    judged = parsed(pages.select("url", *others)).withColumns({"rule": name, "action": action})
    model = fit(judged.select("url", "host", "path", "action"), s)
    columns = [*[f"others.{c}" for c in kept], "url", "host", "path", "rule"]
    scored = model.featured(judged).withColumn("block_score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce("action", F.when(F.col("block_score") >= model.threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*columns, verdict.alias("verdict"), "block_score")
