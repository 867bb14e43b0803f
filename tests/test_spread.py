"""Stored tables over all cores, however their files and row groups lie."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliomill.operators.pages import SMALL, spread


def most(df):
    """Share of the rows that the largest task has."""
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(held) / sum(held)


def test_a_large_row_group_is_dealt_out(spark, tmp_path):
    """One task read all of it: tables of more than 8 MB a core were taken to have splits enough."""
    cores = spark.sparkContext.defaultParallelism
    n = SMALL * cores // 50_000
    pq.write_table(pa.table({"id": range(n), "data": [os.urandom(60_000) for _ in range(n)]}), tmp_path / "one.parquet", compression="none")
    rows = spark.read.parquet(str(tmp_path / "one.parquet"))
    dealt = spread(rows)
    assert os.path.getsize(tmp_path / "one.parquet") > SMALL * cores and most(rows) == 1
    assert most(dealt.select("id")) * cores < 2 and dealt.columns == rows.columns
    key = lambda df: sorted(map(tuple, df.select("id", F.md5("data")).collect()))
    assert key(dealt) == key(rows)


def test_one_file_among_many_holds_the_rows(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for k in range(2 * cores):
        pq.write_table(pa.table({"id": range(20_000 if k == 1 else 1)}), tmp_path / f"{k}.parquet")
    rows = spark.read.parquet(str(tmp_path))
    assert most(rows) > 0.9 and most(spread(rows)) * cores < 2


def test_even_splits_stay(spark, tmp_path):
    rows = spark.range(8000).repartition(2 * spark.sparkContext.defaultParallelism)
    rows.write.parquet(str(tmp_path / "even"))
    stored = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "even"))
    assert "Exchange" not in spread(stored)._jdf.queryExecution().executedPlan().toString() or most(stored) * spark.sparkContext.defaultParallelism > 2
    empty = spark.read.schema("id long").parquet(str(tmp_path / "even")).filter("id < 0")
    assert spread(empty).count() == 0


def test_counting_pages_is_dealt_out(spark):
    from foliomill.plans.synthetic import page_counts

    assert "REPARTITION_BY_NUM" in page_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
