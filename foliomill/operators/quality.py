"""Likeness of a page's Markdown to a wanted text, by words: BLEU and ROUGE-L."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word runs that BLEU counts.
GRAMS = 4


def _runs(n: int, mine: int) -> Column:
    """The runs of n of the words in ``_w``; x counts one side, y the other."""
    places = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_w", i, F.lit(n)), " ").alias("gram"), F.lit(mine).alias("x"), F.lit(1 - mine).alias("y")))


def bleu(pairs: DataFrame, key: str) -> DataFrame:
    """(key, bleu) of rows with ``got`` and ``want``: word runs of one to four, with the brevity penalty, unsmoothed.

    Null texts count as empty; a text without a common run of every length scores 0.
    """
    sides = []
    for side, mine in (("got", 1), ("want", 0)):
        plain = F.trim(F.regexp_replace(F.coalesce(side, F.lit("")), r"[\x20\x09-\x0D]+", " "))
        rows = pairs.select(key, F.split(plain, " ").alias("_w"))
        sides.append(rows.select(key, F.inline(F.concat(*(_runs(n, mine) for n in range(1, GRAMS + 1))))))
    counts = sides[0].unionByName(sides[1]).groupBy(key, "n", "gram").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    lengths = counts.groupBy(key, "n").agg(F.sum(F.least("x", "y")).alias("hit"), F.sum("x").alias("total"), F.sum("y").alias("wanted"))
    found = F.col("hit") > 0
    one = F.col("n") == 1
    short = F.least(F.lit(0.0), 1 - F.max(F.when(one, F.col("wanted"))) / F.max(F.when(one, F.col("total"))))
    score = F.when(F.count_if(found) == GRAMS, F.exp(short) * F.exp(F.avg(F.when(found, F.ln(F.col("hit") / F.col("total")))))).otherwise(0.0)
    return lengths.groupBy(key).agg(score.alias("bleu"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of it at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        met = row & places.get(word, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    """(key, rouge_l) of rows with ``got`` and ``want``: F1 of their longest common subsequence of words; 0 without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for got, want in zip(batch.column("got").to_pylist(), batch.column("want").to_pylist()):
                a, b = (got or "").split(), (want or "").split()
                scores.append(2 * common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "rouge_l"])

    return pairs.select(key, "got", "want").mapInArrow(run, f"{key} {dict(pairs.dtypes)[key]}, rouge_l double")
