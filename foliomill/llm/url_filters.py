"""URL filters: a rule list, and gradient-boosted trees on lexical features.

Features are SQL expressions over the url. Trees are grown level by level: one
aggregate of gradient sums by (node, feature, bin) over a bounded labelled
sample yields every split of a level, so training is a fixed number of small
distributed aggregates. The finished trees are one CASE expression, and judging
urls is a projection with one broadcast join to the suffix statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize

#: (action, rule); a rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Distinct labelled urls that the trees are fitted to, about, chosen by hash. Suffix statistics are counted over all labelled ones.
SAMPLE = 20_000
#: For fitting, a url's suffix share is that of the labelled urls outside its own fold.
FOLDS = 4
TREES = 12
DEPTH = 3
BINS = 16
RATE = 0.3
#: Least sum of second derivatives in a leaf, and the penalty on leaf values.
LEAST = 5.0
PENALTY = 1.0
#: Weight of the overall share in a suffix's share of blocked urls.
PRIOR = 20.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "params", "hyphens", "suffix_share", "suffix_count")


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its action, null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def suffix_of() -> Column:
    return F.element_at(F.split("host", r"\."), -1)


def features(urls: DataFrame) -> DataFrame:
    """Add lexical features and ``suffix`` to rows with url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    held = urls.withColumn("_chars", F.split(url, ""))
    each = F.transform(F.array_distinct("_chars"), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    spread = F.aggregate(each, F.lit(0.0), lambda total, k: total + F.when(k > 0, k * F.log2(k)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = {
        "length": F.length(url), "host_length": F.length("host"), "labels": _count(F.col("host"), "."), "depth": _count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]+", "")) / n, "entropy": F.log2(n) - spread / n,
        "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "hyphens": _count(F.col("host"), "-"),
    }
    return held.select(*urls.columns, *(v.cast("double").alias(k) for k, v in made.items()), suffix_of().alias("suffix"))


@dataclass
class Model:
    """Additive trees over features; a tree is a leaf value or (feature, threshold, left, right)."""

    base: float
    suffixes: DataFrame | None = None
    default_share: float = 0.0
    trees: list = field(default_factory=list)

    def features(self, urls: DataFrame) -> DataFrame:
        found = features(urls)
        if self.suffixes is None:
            return found.withColumns({"suffix_share": F.lit(self.default_share), "suffix_count": F.lit(0.0)})
        found = found.join(self.suffixes, "suffix", "left")
        return found.withColumns({"suffix_share": F.coalesce("suffix_share", F.lit(self.default_share)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})

    def score(self) -> Column:
        return sum((_tree(t) for t in self.trees), F.lit(self.base))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.score()))


def _tree(tree, below=lambda name, threshold: F.col(name) <= threshold) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, threshold, left, right = tree
    return F.when(below(name, threshold), _tree(left, below)).otherwise(_tree(right, below))


def _bin(value: Column, limits: list[float]) -> Column:
    return sum((F.when(value > x, 1).otherwise(0) for x in limits), F.lit(0))


def _gain(g: float, h: float) -> float:
    return g * g / (h + PENALTY)


def _grow(sample: DataFrame, model: Model, limits: dict[str, list[float]]) -> None:
    """Add one tree, level by level, over binned features."""
    tree: dict[int, tuple | float] = {}  # by heap position: a split (feature, threshold), or a leaf
    below = lambda name, threshold: F.col(name) <= limits[name].index(threshold)
    score = sum((_tree(t, below) for t in model.trees), F.lit(model.base))
    sums = sample.withColumn("_p", 1 / (1 + F.exp(-score))).select(*FEATURES, (F.col("_n") * (F.col("_bad") - F.col("_p"))).alias("_g"), (F.col("_n") * F.col("_p") * (1 - F.col("_p"))).alias("_h"))

    def node_of(at: int = 1) -> Column:
        found = tree.get(at)
        if isinstance(found, tuple):
            return F.when(below(*found), node_of(2 * at)).otherwise(node_of(2 * at + 1))
        return F.lit(at)

    for level in range(DEPTH):
        nodes = range(1 << level, 2 << level)
        bins = F.array(*(F.struct(F.lit(k).alias("f"), F.col(f).alias("b")) for k, f in enumerate(FEATURES)))
        rows = sums.withColumn("_node", node_of()).filter(F.col("_node").isin(*nodes))
        found = rows.select("_node", "_g", "_h", F.inline(bins)).groupBy("_node", "f", "b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        for node in {r["_node"] for r in found}:
            own = sorted((r.f, r.b, round(r.g, 6), round(r.h, 6)) for r in found if r["_node"] == node)
            total_g, total_h = sum(r[2] for r in own if r[0] == 0), sum(r[3] for r in own if r[0] == 0)
            best, sides = (1e-6, None), ()
            for k, name in enumerate(FEATURES):
                g = h = 0.0
                for _, b, dg, dh in (r for r in own if r[0] == k):
                    g, h = g + dg, h + dh
                    if b < len(limits[name]) and h >= LEAST and total_h - h >= LEAST:
                        gain = _gain(g, h) + _gain(total_g - g, total_h - h) - _gain(total_g, total_h)
                        if gain > best[0] + 1e-9:
                            best, sides = (gain, (name, limits[name][b])), ((g, h), (total_g - g, total_h - h))
            tree[node] = best[1] or RATE * total_g / (total_h + PENALTY)
            if sides and level == DEPTH - 1:  # the same sums give the leaves
                tree[2 * node], tree[2 * node + 1] = (RATE * g / (h + PENALTY) for g, h in sides)
        if not any(isinstance(tree.get(n), tuple) for n in nodes):
            break

    def built(at: int):
        found = tree.get(at, 0.0)
        return (*found, built(2 * at), built(2 * at + 1)) if isinstance(found, tuple) else found

    model.trees.append(built(1))


def fit(labelled: DataFrame, *, sample: int = SAMPLE, trees: int = TREES) -> Model:
    """Trees from (url, bad) with bad 0 or 1; null labels are left out. Without both labels the model is constant."""
    host, path = parts(F.col("url"))
    known = labelled.filter("bad is not null").groupBy("url").agg(F.count("*").alias("_n"), F.sum(F.col("bad").cast("int")).alias("_b"))
    known = materialize(known.select("url", host.alias("host"), path.alias("path"), "_n", "_b", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).alias("_fold")), "urls")
    distinct, n, bad = known.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    if not 0 < bad < n:
        return Model(base=20.0 if bad else -20.0)
    mean, share = bad / n, min(1.0, sample / distinct)
    rate = lambda b, n: (b + PRIOR * mean) / (n + PRIOR)
    folds = materialize(known.groupBy(suffix_of().alias("suffix"), "_fold").agg(F.sum("_n").alias("_fn"), F.sum("_b").alias("_fb")), "folds")
    totals = folds.groupBy("suffix").agg(F.sum("_fn").alias("_tn"), F.sum("_fb").alias("_tb"))
    suffixes = totals.select("suffix", rate(F.col("_tb"), F.col("_tn")).alias("suffix_share"), F.col("_tn").cast("double").alias("suffix_count"))
    model = Model(math.log(mean / (1 - mean)), bounded(materialize(suffixes, "suffixes"), "suffix"), mean)
    chosen = features(known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))).drop("url", "host", "path")
    others = folds.join(totals, "suffix").select("suffix", "_fold", rate(F.col("_tb") - F.col("_fb"), F.col("_tn") - F.col("_fn")).alias("suffix_share"), F.col("_tn").cast("double").alias("suffix_count"))
    joined = materialize(others.join(F.broadcast(chosen), ["suffix", "_fold"]), "sample")
    quantiles = joined.agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 1000).alias(f) for f in FEATURES)).first()
    limits = {f: sorted(set(quantiles[f])) for f in FEATURES}
    # rows with equal bins become one weighted row; as they are few and bounded, one task sums them without a shuffle
    binned = joined.select("_n", "_b", *(_bin(F.col(f), limits[f]).alias(f) for f in FEATURES)).groupBy(*FEATURES).agg(F.sum("_n").cast("double").alias("_n"), (F.sum("_b") / F.sum("_n")).alias("_bad"))
    binned = materialize(binned.coalesce(1), "binned").coalesce(1)
    for _ in range(trees):
        _grow(binned, model, limits)
    return model


def url_filter(pages: DataFrame, labelled: DataFrame, *, rules=RULES, threshold: float = 0.5, **fitting) -> DataFrame:
    """Verdict for every url: page_id, host, path, rule, verdict, probability.

    Reads ``page_id`` and ``url`` of pages, ``url`` and ``bad`` of labelled. The
    longest fitting rule decides; else ``block`` if the trees' probability is
    above the threshold. A null url has empty host and path and is judged by its
    (empty) features. Repeated rows keep their rows; an empty table gives an
    empty result; without labels every url that no rule fits is allowed.
    """
    model = fit(labelled, **fitting)
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = model.features(urls).withColumn("probability", model.probability())
    verdict = F.coalesce(action, F.when(F.col("probability") > threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "probability")
