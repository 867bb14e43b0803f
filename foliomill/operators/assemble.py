"""Assembly of pages into documents, with statistics and error checks, in one group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PageSeparator
from ..errors import message, page_error_message
from ..functions.scalars import PRICES, front_matter, separator


def joined_pages(pages: Column, kind: PageSeparator) -> Column:
    """Sorted structs (page_num, markdown) to one text; the separator names the page that follows."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.when(i == 0, "").otherwise(separator(p.page_num, kind)), p.markdown)), "")


def assemble(pages: DataFrame, kind: PageSeparator, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) from successful pages in order, after a front-matter if metadata is given."""
    done = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("page_num", "markdown"))))
    docs = pages.groupBy("doc_id").agg(joined_pages(done, kind).alias("markdown"))
    if metadata is None:
        return docs
    meta = metadata.select("doc_id", front_matter({c: F.col(c) for c in metadata.columns}).alias("_yaml"))
    return docs.join(meta, "doc_id").select("doc_id", F.concat("_yaml", "markdown").alias("markdown"))


def statistics() -> list[Column]:
    """Aggregates of a document's page results."""
    ok = F.col("error").isNull()
    return [
        F.count_if(ok).alias("processed_pages"), F.count_if(~ok).alias("failed_pages"), F.count("*").alias("returned_pages"),
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("render_ms").alias("render_duration_ms"), (F.max("ended_ms") - F.min("started_ms")).alias("llm_duration_ms"),
        F.min_by(page_error_message(F.col("error")), F.when(~ok, F.col("page_num"))).alias("first_error"),
    ]


def convert_documents(pages: DataFrame, documents: DataFrame, kind: PageSeparator, *, max_retries: int = 3, strict: bool = False, keep_pages: bool = False) -> DataFrame:
    """One row per document: markdown, counters and doc_error; with ``keep_pages`` also ``pages``, the page results in order.

    ``documents`` has doc_id, page_count, selected_count, and may have inspect_ms.
    A document with no selected page is out of range; one with no successful page
    failed as a whole; with ``strict`` any failed page is an error. Rendering time
    is summed over pages; llm_duration_ms is the time from the start of the first
    page to the end of the last, and total_duration_ms that with the opening.
    """
    if keep_pages:
        made = pages.groupBy("doc_id").agg(page_results(), *statistics())
        made = made.withColumn("markdown", joined_pages(F.filter("pages", lambda p: p.error.isNull()), kind))
    else:
        done = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("page_num", "markdown"))))
        made = pages.groupBy("doc_id").agg(joined_pages(done, kind).alias("markdown"), *statistics())
    rows = documents.join(made, "doc_id", "left")
    zero = ["processed_pages", "failed_pages", "returned_pages", "total_input_tokens", "total_output_tokens", "render_duration_ms", "llm_duration_ms"]
    opened = F.coalesce("inspect_ms", F.lit(0)) if "inspect_ms" in documents.columns else F.lit(0)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
    rows = rows.withColumn("skipped_pages", F.greatest(F.col("selected_count") - F.col("returned_pages"), F.lit(0)).cast("long"))
    error = F.when(F.col("selected_count") == 0, message("PageOutOfRange", page=F.lit(0), total=F.col("page_count"))).when(
        F.col("processed_pages") == 0,
        message("AllPagesFailed", total=F.col("returned_pages"), retries=F.lit(max_retries), first_error=F.coalesce("first_error", F.lit("Unknown error"))),
    )
    if strict:
        error = error.when(F.col("failed_pages") > 0, message("PartialFailure", failed=F.col("failed_pages"), total=F.col("page_count")))
    rows = rows.withColumns({"doc_error": error, "total_duration_ms": (opened + F.col("llm_duration_ms")).cast("long")})
    rows = rows.withColumn("markdown", F.when(F.col("doc_error").isNull(), F.col("markdown")))
    return rows.select("doc_id", "markdown", F.col("page_count").cast("long").alias("total_pages"), "processed_pages", "failed_pages", "skipped_pages", "total_input_tokens", "total_output_tokens", "total_duration_ms", "render_duration_ms", "llm_duration_ms", "first_error", "doc_error", *["pages"] * keep_pages)


def page_results() -> Column:
    """Aggregate of a document's page results in order, ``pages``."""
    result = F.struct("page_num", "markdown", "input_tokens", "output_tokens", "duration_ms", "retries", "error")
    return F.array_sort(F.collect_list(result)).alias("pages")


def conversion_output(pages: DataFrame | None, documents: DataFrame) -> DataFrame:
    """(doc_id, json): the whole output of each document, nulls kept, pages in order.

    Documents that were converted with ``keep_pages`` have their pages and need no table of them.
    """
    stats = F.struct(*(c for c in documents.columns if c not in ("doc_id", "markdown", "metadata", "doc_error", "first_error", "pages")))
    meta = [F.col("metadata")] if "metadata" in documents.columns else []
    joined = documents if pages is None else documents.join(pages.groupBy("doc_id").agg(page_results()), "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct("markdown", "pages", *meta, stats.alias("stats")), {"ignoreNullFields": "false"}).alias("json"))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, model string, input_price double, output_price double")


def cost_micros(usage: DataFrame) -> DataFrame:
    """Add ``cost_micros`` to rows with provider, model and token counts; unknown models cost nothing."""
    priced = usage.join(F.broadcast(price_table(usage.sparkSession)), ["provider", "model"], "left")
    cost = F.col("total_input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("total_output_tokens") * F.coalesce("output_price", F.lit(0.0))
    return priced.withColumn("cost_micros", F.round(cost).cast("long")).drop("input_price", "output_price")
