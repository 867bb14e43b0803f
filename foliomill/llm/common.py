"""Pieces that several training-data operators share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pages import spread

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Where tables go in local sessions (tests) that name no shared folder.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one set by setCheckpointDir.

    A local session without either gets one of its own; a cluster without either is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_tables() -> None:
    """Remove the tables that this process has written; called at its end, and by long sessions between queries.

    Results that have not been written or collected yet must not be read afterwards.
    """
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    This cuts lineage and lets several consumers read one result; the files
    survive lost executors. They stay until ``drop_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without keeping them: blanks are squeezed and counted."""
    squeezed = F.regexp_replace(text, BLANKS, " ")
    blanks = F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit("")))
    edges = F.when(squeezed.startswith(" "), 1).otherwise(0) + F.when(squeezed.endswith(" "), 1).otherwise(0)
    return F.when(squeezed.isin("", " "), 0).otherwise(blanks + 1 - edges).cast("long")


def hash_key(*cols: str, seed: str = "") -> Column:
    """A hash-random key: md5 of the columns, nulls as empty text."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


#: Rows of a key range, at least; larger groups take about the root of their rows.
RANGE_ROWS = 256


def prefix_sums(df: DataFrame, group: str, stats: DataFrame, value: str, *ties: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group with smaller ``_key``.

    ``_key`` is a hash-random hex key, so equal key ranges hold about equally
    many rows. ``stats`` has (group, _rows). Each range is sorted by itself, the
    sums of the ranges give its offset: no group is ever sorted in one task.
    """
    ranges = F.ceil(F.col("_rows") / F.greatest(F.lit(RANGE_ROWS), F.ceil(F.sqrt("_rows"))))
    split = df.join(bounded(stats.select(group, ranges.cast("long").alias("_ranges")), group), group)
    place = F.conv(F.substring("_key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    split = split.withColumn("_range", F.least(F.floor(place * F.col("_ranges")), F.col("_ranges") - 1)).drop("_ranges")
    sums = split.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_range").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(offsets, [group, "_range"]).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", "_range")


#: A table with more rows than this is not broadcast.
BROADCAST_ROWS = 100_000


def bounded(small: DataFrame, *keys: str) -> DataFrame:
    """Broadcast a table if it is counted to be small; else leave the join to Spark's skew handling."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(small) if few else small
