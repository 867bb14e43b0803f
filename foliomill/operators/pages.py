"""Pages of documents: expansion, selection, prior-page context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import arrow_schema, in_batches, rows_of
from ..config import PageSelection
from ..functions.text import let


#: A table of fewer stored bytes for each core is dealt one part a core, a larger one in parts of about so many bytes.
SMALL, DEALT = 8 << 20, 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A stored table dealt to all cores before costly row-local work, if its splits don't do that; else as it is.

    A Parquet row group is read by one task however large it is, and splits
    without the start of one are empty. So the rows of each split are counted,
    from the files' footers: where the largest would take a core more than twice
    its share, rows are dealt by their place in the scan, whatever the table's size.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if not held["all"] or held["most"] * cores <= 2 * held["all"]:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SMALL * cores:
        return rows.repartition(cores)
    # by a key: without one, Spark first sorts all rows of a split, on disk if they are many
    return rows.withColumn("_place", F.monotonically_increasing_id()).repartition(max(cores, -(-size // DEALT)), "_place").drop("_place")


def expand(docs: DataFrame, page_count: str = "page_count") -> DataFrame:
    """A row per page with ``page_num`` from 1; documents without pages give none."""
    numbers = F.when(F.col(page_count) > 0, F.sequence(F.lit(1), F.col(page_count))).otherwise(F.array().cast("array<int>"))
    return docs.withColumn("page_num", F.explode(numbers))


def page_texts(text: Column, per_page: int = 10) -> Column:
    """Array of a text's pages of so many lines; the text is split once, not anew for each page."""

    def cut(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / per_page).cast("int")), lambda p: F.array_join(F.slice(lines, p * per_page + 1, per_page), "\n"))

    return let(F.split(text, "\n", -1), cut)


def count_pages(text: Column, per_page: int = 10) -> Column:
    """How many pages ``page_texts`` cuts a text into, by its line feeds; null for null."""
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.floor(feeds / per_page) + 1).cast("int")


def lines_to_pages(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """(doc_id, page_count, page_num, text): texts cut into pages of so many lines; null texts have no pages."""
    pages = docs.filter("text is not null").select("doc_id", page_texts(F.col("text"), per_page).alias("pages"))
    return pages.select("doc_id", F.size("pages").alias("page_count"), F.posexplode("pages").alias("at", "text")).select("doc_id", "page_count", (F.col("at") + 1).alias("page_num"), "text")


def is_selected(selection: PageSelection, page_num: Column, page_count: Column) -> Column:
    """Predicate on 1-based page numbers; applied before any costly stage."""
    inside = (page_num >= 1) & (page_num <= page_count)
    if selection.kind == "all":
        return inside
    if selection.kind == "range":
        first, last = selection.pages
        return inside & page_num.between(max(first, 1), last)
    return inside & page_num.isin(*selection.pages)


def selected_count(selection: PageSelection, page_count: Column) -> Column:
    """How many pages of a document are selected."""
    n = page_count.cast("int")
    if selection.kind == "all":
        return n
    if selection.kind == "range":
        first, last = selection.pages
        return F.greatest(F.least(F.lit(last), n) - max(first, 1) + 1, F.lit(0))
    return sum((F.when(n >= p, 1).otherwise(0) for p in sorted(set(selection.pages)) if p >= 1), F.lit(0))


def spec_pages(spec: Column, page_count: Column) -> Column:
    """Page options in a column: struct of ``error`` (null if the option is well formed) and ``pages``, the selected numbers.

    The same grammar as the driver's parser: ``all``, ``5``, ``3-7`` or ``1,3,5``,
    a hyphen looked for before a comma; a null option selects all pages.
    """
    text = F.lower(F.regexp_replace(F.coalesce(spec, F.lit("all")), r"\A\s+|\s+\z", ""))
    whole = F.when(page_count > 0, F.sequence(F.lit(1), page_count.cast("int"))).otherwise(F.array().cast("array<int>"))
    number = lambda part: F.when(F.trim(part).rlike(r"\A\+?[0-9]+\z"), F.trim(part).try_cast("int"))
    first, last = (number(F.regexp_extract(text, r"(?s)\A([^-]*)-(.*)\z", k)) for k in (1, 2))
    listed = F.transform(F.split(text, ",", -1), number)
    bad = lambda part: part.isNull() | (part < 1)
    spans = text.contains("-")
    wrong = F.when(text == "all", False).when(spans, bad(first) | last.isNull() | (first > last)).otherwise(F.exists(listed, bad))
    chosen = F.when(text == "all", whole).when(spans, F.filter(whole, lambda n: n.between(first, last))).otherwise(F.filter(whole, lambda n: F.array_contains(listed, n)))
    error = F.when(wrong, F.when(spans, F.concat(F.lit("invalid page range '"), text, F.lit("'"))).otherwise(F.concat(F.lit("invalid page number '"), text, F.lit("'"))))
    return F.struct(error.alias("error"), F.when(wrong, F.array().cast("array<int>")).otherwise(chosen).alias("pages"))


def skipped(selected: DataFrame, results: DataFrame) -> DataFrame:
    """Selected pages that gave no result."""
    return selected.join(results.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_anti")


def prior_context(pages: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Add ``prior``: Markdown of the last earlier page without an error; null for the first."""
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("prior", F.last(F.when(F.col("error").isNull(), F.col(markdown)), ignorenulls=True).over(before))


def first_success(pages: DataFrame) -> DataFrame:
    """Successful pages with ``is_first``: whether none stands before."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    return pages.filter(F.col("error").isNull()).withColumn("is_first", F.row_number().over(order) == 1)


def in_sequence(pages: DataFrame, step: Callable[[dict, str | None], dict], schema: str, *, clean: Callable[[str], str] | None = None) -> DataFrame:
    """The recurrence itself: each page is made from the one before, in order, per document.

    ``step(page, prior)`` returns a result row; a row with an error does not
    become the next page's context. Pages of a document stand together in one
    task, sorted, and pass one by one; a document is never held whole.
    """
    out = arrow_schema(schema)

    def results(pages: Iterator[dict]) -> Iterator[dict]:
        doc = prior = None
        for page in pages:
            if page["doc_id"] != doc:
                doc, prior = page["doc_id"], None
            row = step(page, prior)
            if row.get("error") is None:
                prior = clean(row["markdown"]) if clean else row["markdown"]
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(results(rows_of(batches)), out)

    return pages.repartition("doc_id").sortWithinPartitions("doc_id", "page_num").mapInArrow(run, schema)
