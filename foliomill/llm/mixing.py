"""Mixing sources to target weights with hash-random order and prefix sums.

Sizes are counted once and kept in a narrow table. Targets are found by
repeated aggregates over the table of sources. Within each source documents
stand in the order of a hash key; distributed prefix sums of their sizes give
each document's place, and the source's budget cuts that line exactly, after
as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, hash_key, materialize, n_words, prefix_sums, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def _ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``, from 0 in code point order, null last, by range partitions."""
    parts = materialize(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("_at", inside).join(bounded(starts, "_part"), "_part").select(F.col("source"), "source_size", "_rows", (F.col("_start") + F.col("_at") - 1).alias("rank"))


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``rank`` and ``target`` to (source, source_size, _rows).

    All targets together are ``share`` times all sizes. A target above ``most``
    times its source's size stops there; what it leaves is shared by weight
    among the others, until none is above.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sources).withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size")), "targets")
    level = 0.0
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        total, capped, left = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("_cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_weight")))).first()
        if not total or not left or (share * total - capped) / left <= level:
            break
        level = (share * total - capped) / left
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight"))
    return ranked.select("source", "source_size", "_rows", "rank", target.alias("target"))


def mix(docs: DataFrame, *carry: str, seed: str = "mix", **shares) -> DataFrame:
    """Words that the mix takes of each row: doc_id, size, source_size, target, taken.

    A null text has size 0. Null sources form one source, the last. Rows with
    equal ids share a key; ties go by size and are the same on every run. If no
    text has a word, all targets are 0. ``carry`` names columns to carry along.
    """
    sized = docs.select(*carry, F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text_or_empty()).alias("size"))
    sized = materialize(sized.withColumn("_key", hash_key("doc_id", seed=seed)), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), **shares)
    known = bounded(sources, "source").withColumnRenamed("source", "_source")
    rows = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("source", "_source", "_rows")
    rows = prefix_sums(rows, "rank", sources.select("rank", "_rows"), "size", "doc_id", "size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return rows.select(*carry, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: a row for each copy that the mix takes, with the input's columns.

    A document at the end of a source's budget is cut after the words that are
    still within it; words keep the blanks before them. Rows that are equal in
    every column are interchangeable and are matched to the mix together. Columns
    may have any names; ``n_chars``, where there is one, follows a cut.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if "map" in kind else c for c, (_, kind) in zip(columns, docs.dtypes)]
    same = ["one", "two"]  # 128 bits of all columns
    rows = docs.select(F.xxhash64(F.lit(1), *plain).alias("one"), F.xxhash64(F.lit(2), *plain).alias("two"), "doc_id", "source", "text", F.struct(*columns).alias("row"))
    taken = mix(rows.select(*same, "doc_id", "source", "text"), *same, **options)
    has = F.col("size") > 0
    copies = F.when(has, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    part = F.when(has & (F.col("taken") % F.col("size") > 0), F.col("taken") % F.col("size"))
    cuts = taken.filter("taken > 0").groupBy(*same).agg(F.sum(copies).alias("copies"), F.collect_list(part).alias("parts"))
    # equal rows are merged where they are read; the shuffle of that serves the join too
    once = rows.groupBy(*same).agg(F.first("row").alias("row")).join(cuts.hint("merge"), same)
    each = once.select("row", F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("copies").cast("int")), "parts")).alias("cut"))
    ends = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("cut") > 0, F.array_join(F.slice(ends, 1, F.col("cut").cast("int")), "")).otherwise(F.col("row.text"))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("cut") > 0, F.length("text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    out["text"] = F.col("text")
    return each.withColumn("text", text).select(*(v.alias(c) for c, v in out.items()))
