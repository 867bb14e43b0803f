"""Streaming conversion: documents or raw pages in, cleaned pages out, with or without prior-page context."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ConversionConfig
from ..functions.text import clean_pages
from ..schema import RAW_PAGE
from ..sources.pages import PageSource, rendered
from ..sources.provider import Provider, infer_page


def clean_stream(raw: DataFrame) -> DataFrame:
    """Cleaned page results, in the order of arrival; rows with an error keep their Markdown."""
    return clean_pages(raw)


_COLUMNS = [field.split()[0] for field in RAW_PAGE.split(", ")]


def convert_stream(docs: DataFrame, source: PageSource, provider: Provider, config: ConversionConfig = ConversionConfig()) -> DataFrame:
    """Cleaned page results of (doc_id, content), each as soon as it is made; for streams as for tables.

    A document's selected pages are rendered and inferred within its row, with
    ``concurrency`` calls at a time, or one after the other if each needs the one
    before. Nothing is kept between documents, so no state is needed. Pages that
    can't be rendered are left out; a document that can't be opened gives one row
    without a page number and an error.
    """

    def failed(doc_id: int, kind: str, detail: str) -> dict:
        error = {"kind": kind, "page": None, "retries": None, "secs": None, "detail": detail}
        return dict.fromkeys(_COLUMNS) | {"doc_id": doc_id, "markdown": "", "error": error}

    def pages_of(doc_id: int, content: bytes, pool: ThreadPoolExecutor) -> Iterator[dict]:
        try:
            total = source.metadata(content, config.password)["page_count"]
        except Exception as e:
            yield failed(doc_id, "CorruptPdf", str(e))
            return
        numbers = [i + 1 for i in config.pages.to_indices(total)]
        if not numbers:
            yield failed(doc_id, "PageOutOfRange", f"document has {total} pages")
        images = (image | {"image_b64": base64.b64encode(image["content"]).decode()} for image in rendered(doc_id, content, numbers, source, config))
        if config.maintain_format:
            prior = None
            for image in images:
                row = infer_page(provider, image, prior, config)
                prior = prior if row["error"] else row["markdown"]
                yield row
        else:
            while some := list(islice(images, config.concurrency)):
                yield from pool.map(lambda image: infer_page(provider, image, None, config), some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(config.concurrency) as pool:
            for batch in batches:
                for doc_id, content in zip(batch.doc_id, batch.content):
                    for row in pages_of(doc_id, bytes(content), pool):
                        yield pd.DataFrame([row], columns=_COLUMNS).astype({c: "Int64" for c in ("page_num", "retries", "render_ms", "started_ms", "ended_ms", "input_tokens", "output_tokens", "duration_ms")})

    return clean_stream(docs.select("doc_id", "content").mapInPandas(run, RAW_PAGE))


_OUT = "doc_id long, page_num int, markdown string, failed boolean, prior string"
_STATE = "order array<int>, at int, prior string, numbers array<int>, texts array<string>, failed array<boolean>"


def with_context(cleaned: DataFrame, *, patience_ms: int = 3_600_000) -> DataFrame:
    """Add ``prior``, the Markdown of the last earlier page without an error, per document.

    Pages are emitted in order, each when all pages before it have been. Which
    pages come is told by an optional column ``pages``, the selected numbers in
    order; else they are 1, 2, 3 and so on. Selected pages of which no row comes
    are passed over at the document's end: at a row without a page number, the
    end mark, or when no row has come for ``patience_ms``. State is the prior text
    and the pages that came before their turn; it is dropped at the end.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order, at, prior, numbers, texts, failed = state.get if state.exists else ([], 0, None, [], [], [])
        waiting = {n: (t, bad) for n, t, bad in zip(numbers, texts, failed)}
        order, ended, out = list(order or []), state.hasTimedOut, []
        turn = lambda: at + 1 if not order else order[at] if at < len(order) else None
        gone = lambda n: n <= at if not order else n not in order[at:]
        if not ended:
            for batch in batches:
                for n, t, bad, pages in zip(batch.page_num, batch.markdown, batch.failed, batch.pages):
                    order = order or [int(p) for p in (pages if pages is not None else [])]
                    if pd.isna(n):
                        ended = True
                    elif not gone(int(n)):  # a page that comes again is known already
                        waiting[int(n)] = (t, bool(bad))
        while waiting and (turn() in waiting or ended):
            n = turn() if turn() in waiting else min(waiting)
            text, bad = waiting.pop(n)
            out.append((key[0], n, text, bad, prior))
            prior = prior if bad else text
            at = order.index(n) + 1 if order else n
        if ended or order and at == len(order):
            if state.exists:
                state.remove()
        else:
            left = sorted(waiting)
            state.update((order, at, prior, left, [waiting[n][0] for n in left], [waiting[n][1] for n in left]))
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=["doc_id", "page_num", "markdown", "failed", "prior"]).astype({"doc_id": "int64", "page_num": "int32", "failed": "bool"})

    pages = F.col("pages").cast("array<int>") if "pages" in cleaned.columns else F.lit(None).cast("array<int>")
    rows = cleaned.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "markdown", F.col("error").isNotNull().alias("failed"), pages.alias("pages"))
    return rows.groupBy("doc_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
