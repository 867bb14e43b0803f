"""Page sources: what turns a document's bytes into metadata and page images.

No PDF renderer is part of this package. A renderer is plugged in as an object
with two methods; ``TextPages`` is a stand-in that treats each form feed of the
content as a page break, which is enough to test everything around it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import arrow_schema, in_batches, rows_of
from ..config import ConversionConfig
from ..functions.scalars import encode_page
from ..schema import METADATA


class PageSource(Protocol):
    def metadata(self, content: bytes, password: str | None) -> dict:
        """Fields of METADATA without doc_id; raises on a file that can't be opened."""

    def render(self, content: bytes, page_index: int, config: ConversionConfig) -> bytes | None:
        """PNG of one page, or None if the page can't be rendered."""


class TextPages:
    """Pages are the parts between form feeds, after a first line ``%PDF-<version>``.

    The document that was opened last stays cut, so that its pages cost no cut each.
    """

    _last: tuple[bytes, list[bytes]] = (b"", [])

    def _parts(self, content: bytes) -> list[bytes]:
        if not content.startswith(b"%PDF"):
            raise ValueError("FormatError")
        known, parts = self._last
        if known is not content:
            parts = content.partition(b"\n")[2].split(b"\f")
            self._last = (content, parts)
        return parts

    def metadata(self, content: bytes, password: str | None) -> dict:
        parts = self._parts(content)
        version = content.partition(b"\n")[0][5:].decode("ascii", "replace").replace(".", "_")
        return {"page_count": len(parts), "pdf_version": f"Pdf{version}" if version else "", "is_encrypted": False}

    def render(self, content: bytes, page_index: int, config: ConversionConfig) -> bytes | None:
        parts = self._parts(content)
        return parts[page_index] if page_index < len(parts) else None


_NAMES = [field.split()[0] for field in METADATA.split(", ")]


def inspect(docs: DataFrame, source: PageSource, config: ConversionConfig = ConversionConfig()) -> DataFrame:
    """Metadata of each (doc_id, content), without rendering; blank strings become null, failures an error text.

    ``inspect_ms`` is the time that opening took.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, content in zip(batch.doc_id, batch.content):
                row, began = dict.fromkeys(_NAMES) | {"doc_id": doc_id, "error": None}, time.monotonic()
                try:
                    row |= {k: v if v != "" or k == "pdf_version" else None for k, v in source.metadata(bytes(content), config.password).items()}
                except Exception as e:  # any failure to open counts as a corrupt file
                    row["error"] = str(e)
                out.append(row | {"inspect_ms": int(1000 * (time.monotonic() - began))})
            yield pd.DataFrame(out, columns=[*_NAMES, "error", "inspect_ms"]).astype({"page_count": "Int32"})

    return docs.select("doc_id", "content").mapInPandas(run, f"{METADATA}, error string, inspect_ms bigint")


#: Images as they come from a source.
IMAGE = "doc_id bigint, page_index int, content binary, render_encode_ms bigint, started_ms bigint"
_IMAGE = [f.split()[0] for f in IMAGE.split(", ")]


def rendered(doc_id: int, content: bytes, numbers: list[int], source: PageSource, config: ConversionConfig) -> Iterator[dict]:
    """Images of pages, one at a time: an image is the largest value held. What can't be rendered is left out."""
    for number in numbers:
        began, at = time.monotonic(), int(1000 * time.time())
        try:
            image = source.render(content, int(number) - 1, config)
        except Exception:
            image = None
        if image is not None:
            yield dict(zip(_IMAGE, (doc_id, int(number) - 1, image, int(1000 * (time.monotonic() - began)), at)))


def render_pages(selected: DataFrame, source: PageSource, config: ConversionConfig) -> DataFrame:
    """ENCODED_PAGE rows for (doc_id, content, page_nums); a page that can't be rendered is left out.

    Without ``page_nums``, the configuration's pages of each document that can be
    opened: its bytes need then meet no other table, and are not shuffled.
    """
    named, out = "page_nums" in selected.columns, arrow_schema(IMAGE)

    def usual(content: bytes) -> list[int]:
        try:
            return [i + 1 for i in config.pages.to_indices(source.metadata(content, config.password)["page_count"] or 0)]
        except Exception:  # as in inspect, which has the error
            return []

    def images_of(docs: Iterator[dict]) -> Iterator[dict]:
        for doc in docs:
            content = doc["content"]
            yield from rendered(doc["doc_id"], content, (doc["page_nums"] or []) if named else usual(content), source, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(images_of(rows_of(batches)), out)

    images = selected.select("doc_id", "content", *["page_nums"] * named).mapInArrow(run, IMAGE)
    return images.withColumn("_e", encode_page(F.col("content"))).select("doc_id", "page_index", "_e.*", "render_encode_ms", "started_ms")
