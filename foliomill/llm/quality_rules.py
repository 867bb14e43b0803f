"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and gives the measurements
and one failure bit per rule; it is stored. Policies are named bit masks applied
to the stored ledger, so a new policy version needs no second look at any text.
``ablations`` compares policies with each of their rules left out; it first
counts documents per distinct bit pattern (at most 2^rules rows) and then works
on those patterns with bitwise operations only.

Everything is built from SQL functions and row-local: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, materialize, text_or_empty

#: Words of a repeat window.
WINDOW = 5

#: Rules in the order of their bits; each is an expression over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
    ("open_lines", "n_lines >= 5 and 10 * n_ended_lines < n_lines"),
    ("line_spread", "n_lines >= 5 and longest_line * n_lines > 20 * line_chars"),
)

BASE = ("few_words", "repeated_words")

#: Versioned policies: a document is rejected if it fails any rule of its policy.
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": (*BASE, "symbols", "duplicate_lines", "word_length"), "v3": tuple(name for name, _ in RULES)}

#: A line that ends a sentence or opens a list, with closing quotes, brackets and blanks.
ENDED = r"[.!?:;][\"')\]]*[\x20\x09-\x0D]*\z"
#: Measurements of lines and letters.
LINES = ("n_lines", "n_dup_lines", "n_ended_lines", "longest_line", "line_chars", "n_letters")


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in rules)


def _window_hash(i: Column) -> Column:
    return F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW)))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements of every whole text; ``keep`` names columns carried along."""
    spread = docs.select(*keep, text_or_empty().alias("_text"))
    spread = spread.select(*keep, "_text", F.split(F.trim(F.regexp_replace("_text", BLANKS, " ")), " ").alias("_words"))
    n = F.when(F.get("_words", F.lit(0)) == "", 0).otherwise(F.size("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    spread = spread.select(
        *keep, "_words", n.cast("long").alias("n_words"), lines.alias("_lines"), F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.aggregate("_words", F.lit(0), lambda total, word: total + F.length(word)).cast("long").alias("word_chars"),
        F.octet_length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), _window_hash)).otherwise(F.array().cast("array<long>"))
    spread = spread.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda line: line.rlike(ENDED))).cast("long").alias("n_ended_lines"),
        F.coalesce(F.array_max(F.transform("_lines", F.length)), F.lit(0)).cast("long").alias("longest_line"),
        F.aggregate("_lines", F.lit(0).cast("long"), lambda total, line: total + F.length(line)).alias("line_chars"), "n_letters", windows.alias("_hashes"),
    )
    # only texts in which some window repeats are sorted: equal windows then stand side by side
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    by_hash = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spread = spread.withColumn("_sorted", F.when(repeats, by_hash)).drop("_hashes")
    twice = F.filter("_sorted", lambda x, j: F.coalesce(x.h == F.get("_sorted", j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_sorted", j + 1).h, F.lit(False)))
    spread = spread.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.i))).drop("_sorted")
    # a window adds its words up to the start of the next repeated window
    covered = F.aggregate(F.transform("_at", lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda total, x: total + x)
    spread = spread.select(*keep, "n_words", "word_chars", "n_symbols", *LINES, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    # a generator keeps later filters from being pushed down, which would evaluate all of this again inside them
    made = [c for c in spread.columns if c not in keep]
    return spread.select(*keep, F.inline(F.array(F.struct(*made))))


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements and ``failure_bits`` (long) of every document."""
    bits = sum((F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measure(docs, *keep).withColumn("failure_bits", bits.cast("long"))


def passes(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def quality_rules(docs: DataFrame, *, policy: str = "v2") -> DataFrame:
    """One row per input row: measurements, failure bits and the policies' verdicts.

    Reads ``doc_id`` and ``text``. ``kept`` is the verdict of the policy, and
    ``kept_v1`` and so on those of all versions, each from the stored ledger. A
    null or empty text has no words and fails; null or repeated ids keep their
    rows; an empty table gives an empty result.
    """
    found = materialize(ledger(docs.select("doc_id", "text"), "doc_id"), "ledger")
    base = F.col("failure_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    verdicts = [(~base & passes(name)).alias(f"kept_{name}") for name in POLICIES]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "n_lines", "n_ended_lines", "longest_line", "line_chars", "n_letters", "failure_bits", *verdicts)


def keep_good(docs: DataFrame, *, policy: str = "v2") -> DataFrame:
    """The input rows that pass the policy, with their own columns only."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return ledger(own, "_row").filter(passes(policy)).select("_row.*")


def ablations(found: DataFrame, *policies: str) -> DataFrame:
    """Per policy and rule: documents that the rule fails, those that it fails alone, and those rejected without it.

    ``found`` is a ledger; without names all policies are compared.
    """
    patterns = found.groupBy("failure_bits").agg(F.count("*").alias("n"))
    count = lambda which: F.when(which, F.col("n")).otherwise(0)
    hit = lambda bits: F.col("failure_bits").bitwiseAND(F.lit(bits))
    rows = []
    for policy in policies or POLICIES:
        full = mask(POLICIES[policy])
        for name in POLICIES[policy]:
            bit = mask((name,))
            rows.append(F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), count(hit(bit) != 0).alias("fails"), count(hit(full) == bit).alias("fails_alone"), count(hit(full & ~bit) != 0).alias("rejected_without")))
    each = patterns.select(F.inline(F.array(*rows)))
    return each.groupBy("policy", "rule").agg(*(F.sum(c).alias(c) for c in ("fails", "fails_alone", "rejected_without")))


def policy_ablations(docs: DataFrame) -> DataFrame:
    """``ablations`` of all policies over whole documents, from one stored ledger; an empty table gives no row."""
    return ablations(materialize(ledger(docs.select("doc_id", "text"), "doc_id"), "ledger"))
