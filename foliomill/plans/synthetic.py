"""Raw page Markdown made from the documents table, with planted defects.

The corpus holds none of the defects that the cleanup rules repair, so twelve
classes of pages get one each, chosen by document and page number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import count_pages, lines_to_pages, spread

#: (before, text with replacements, after) by class; class 11 fails.
FORMS: dict[int, tuple[str, tuple[tuple[str, str], ...], str]] = {
    0: ("", (), ""),
    1: ("```markdown\n", (), "\n```"),
    2: ("```\r\n", (("\n", "\r\n"),), "\r\n```\rtail"),
    3: ("", (("\n", "  \t \n"),), " \t"),
    4: ("", (("\n", "\n\n\n\n\n\n"),), ""),
    5: ("", (), "\n# Title\n\n\n#tag\n#ééé x\nafter"),
    6: ("", (), "\n| A | B |\n| 1 | 2 |\n| 3 | 4 |\nend"),
    7: ("|---|---|\n| H | I |\n|---|---|\n| 1 | 2 |\n|---|---|\n| 3 | 4 |\n", (), ""),
    8: ("", (), "\n![alt](chart.png)\n![ ](x)\n![e](https://example.com/a.png)"),
    9: ("", (), "\n![Fig](https://arxiv.org/f 1.png)"),
    10: ("﻿", ((" ", "​ "), ("a", "a­")), ""),
}
CLASSES = 12
FAILS_WHOLE = 50


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_count) of the documents that ``raw_pages`` has pages of; no page is made for it."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("text is not null")
    return docs.select("doc_id", count_pages(F.col("text")).alias("page_count")).groupBy("doc_id").agg(F.max("page_count").alias("page_count"))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page results of all documents: RAW_PAGE columns and page_count."""
    pages = lines_to_pages(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    kind = (F.col("doc_id") * 7 + F.col("page_num")) % CLASSES
    raw = F.lit("")
    for k, (before, swaps, after) in FORMS.items():
        text = F.col("text")
        for old, new in swaps:
            text = F.replace(text, F.lit(old), F.lit(new))
        raw = F.when(kind == k, F.concat(F.lit(before), text, F.lit(after))).otherwise(raw)
    failed = (kind == CLASSES - 1) | (F.col("doc_id") % FAILS_WHOLE == 0)
    error = F.when(failed, F.struct(F.lit("LlmFailed").alias("kind"), F.col("page_num").cast("int").alias("page"), F.lit(3).alias("retries"), F.lit(None).cast("bigint").alias("secs"), F.lit("mock failure").alias("detail")))
    out = pages.select("doc_id", "page_count", F.col("page_num").cast("int").alias("page_num"), F.when(failed, "").otherwise(raw).alias("markdown"), error.alias("error"))
    tokens = F.ceil(F.octet_length("markdown") / 4).cast("long")
    times = [(F.col("page_num") * 3).cast("long").alias("render_ms"), (F.col("page_num") * 100).cast("long").alias("started_ms"), (F.col("page_num") * 110 + 7).cast("long").alias("ended_ms")]
    return out.select("*", F.when(failed, 0).otherwise(F.lit(1000)).cast("long").alias("input_tokens"), tokens.alias("output_tokens"), (F.col("page_num") * 10).cast("long").alias("duration_ms"), F.when(failed, 3).otherwise(0).alias("retries"), *times)
