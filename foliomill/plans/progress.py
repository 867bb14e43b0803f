"""Progress: callbacks told after the fact, and counters observed while a job runs.

Pages finish on many executors at once, so no order across pages can be kept
while a job runs; callbacks are therefore replayed from the results, one
document after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import page_error_message


class Progress:
    """Override what is of interest; all methods do nothing by default."""

    def on_start(self, doc_id: int, total: int) -> None: ...

    def on_page_start(self, doc_id: int, page_num: int, total: int) -> None: ...

    def on_page_complete(self, doc_id: int, page_num: int, total: int, markdown_bytes: int) -> None: ...

    def on_page_error(self, doc_id: int, page_num: int, total: int, error: str) -> None: ...

    def on_complete(self, doc_id: int, total: int, processed: int) -> None: ...


def replay(raw: DataFrame, documents: DataFrame, progress: Progress) -> None:
    """Tell a callback of stored raw results and their documents; lengths are those of the raw text.

    Each page is started and then completed or failed; a document is completed
    only if one of its pages was.
    """
    total = F.col("processed_pages") + F.col("failed_pages") + F.col("skipped_pages")
    pages = raw.select("doc_id", "page_num", F.octet_length("markdown").alias("n"), page_error_message(F.col("error")).alias("failed"))
    rows = documents.select("doc_id", total.alias("total"), "processed_pages").join(pages, "doc_id", "left").orderBy("doc_id", "page_num")
    now = None

    def close() -> None:
        if now is not None and now.processed_pages:
            progress.on_complete(now.doc_id, now.total, now.processed_pages)

    for row in rows.toLocalIterator():
        if now is None or now.doc_id != row.doc_id:
            close()
            progress.on_start(row.doc_id, row.total)
        now = row
        if row.page_num is not None:
            progress.on_page_start(row.doc_id, row.page_num, row.total)
            if row.failed is None:
                progress.on_page_complete(row.doc_id, row.page_num, row.total, row.n)
            else:
                progress.on_page_error(row.doc_id, row.page_num, row.total, row.failed)
    close()


def observed(pages: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, with counters that are known once an action has used them all."""
    seen = Observation("pages")
    ok = F.col("error").isNull()
    return pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if(~ok).alias("failed"), F.sum("output_tokens").alias("output_tokens")), seen


def metadata_lines(metadata: DataFrame) -> DataFrame:
    """(doc_id, lines): labelled text lines of each document's metadata; absent fields are left out."""
    names = ("title", "author", "subject", "creator", "producer", "creation_date", "modification_date", "page_count", "pdf_version", "is_encrypted")
    lines = [F.concat(F.lit(f"{n.replace('_', ' ').capitalize()}: "), F.col(n).cast("string")) for n in names]
    return metadata.select("doc_id", F.concat_ws("\n", *lines).alias("lines"))
