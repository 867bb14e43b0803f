"""Sources and sinks: documents by path or url, and one output file per document."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MESSAGES, message
from ..functions.scalars import is_accepted

RESOLVED = "doc_id bigint, uri string, kind string, content binary, error_kind string, error string"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Documents below a path of any store that Spark reads: (uri, length, content, error).

    A file of four bytes or more must start with the magic bytes.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    magic = F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.conv(F.hex(F.substring(F.col("content"), i, F.lit(1))), 16, 10))), F.lit("]"))
    error = F.when(~is_accepted(F.col("content")), message("NotAPdf", path=F.col("path"), magic=magic))
    return files.select(F.col("path").alias("uri"), "length", "content", error.alias("error"))


def resolve(inputs: DataFrame, *, timeout_secs: int = 120) -> DataFrame:
    """Fetch (doc_id, uri), local paths and urls alike, in the tasks; errors become columns, never a failed job.

    Tasks open local paths themselves, so those must be on storage that every
    executor sees; ``read_files`` reads whole folders through Spark instead.
    """

    def fetch(uri: str) -> tuple[str, bytes | None, str | None, str | None]:
        def failed(kind: str, **values):
            return None, kind, MESSAGES[kind].format(**values)

        if uri.startswith(("http://", "https://")):
            try:
                with urllib.request.urlopen(uri, timeout=timeout_secs) as response:
                    content = response.read()
            except TimeoutError:
                return ("downloaded", *failed("DownloadTimeout", secs=timeout_secs, url=uri))
            except urllib.error.HTTPError as e:
                return ("downloaded", *failed("DownloadFailed", url=uri, reason=f"HTTP {e.code}"))
            except (OSError, ValueError) as e:
                if isinstance(getattr(e, "reason", None), TimeoutError):
                    return ("downloaded", *failed("DownloadTimeout", secs=timeout_secs, url=uri))
                return ("downloaded", *failed("DownloadFailed", url=uri, reason=str(e)))
            kind = "downloaded"
        else:
            kind = "local"
            if os.path.isdir(uri):  # passes here, fails when opened as a document
                return kind, b"", None, None
            try:
                with open(uri, "rb") as f:
                    content = f.read()
            except PermissionError:
                return (kind, *failed("PermissionDenied", path=uri))
            except OSError:
                return (kind, *failed("FileNotFound", path=uri))
        if len(content) >= 4 and content[:4] != b"%PDF":
            return (kind, *failed("NotAPdf", path=uri, magic=list(content[:4])))
        return kind, content, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, uri in zip(batch.doc_id, batch.uri):
                yield pd.DataFrame([(doc_id, uri, *fetch(uri))], columns=["doc_id", "uri", "kind", "content", "error_kind", "error"])

    return inputs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "uri").mapInPandas(run, RESOLVED)


def from_bytes(spark: SparkSession, documents: list[tuple[int, bytes]]) -> DataFrame:
    """Documents already in memory; bytes live in the row, no temporary file is needed."""
    return spark.createDataFrame(documents, "doc_id bigint, content binary")


def write_markdown(docs: DataFrame, folder: str, name: str = "doc_id") -> DataFrame:
    """Write each document's Markdown to ``<folder>/<name>.md``; (doc_id, path, error).

    Each task writes a temporary file next to its target and renames it, so
    readers never see half a file and a repeated task overwrites its own. The
    folder must be shared by all executors. Nothing is written before the result
    is used by an action.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, stem, markdown in zip(batch.doc_id, batch.stem, batch.markdown):
                path, error = os.path.join(folder, f"{stem}.md"), None
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(f"{path}.{os.getpid()}.tmp", "w", encoding="utf-8", newline="") as f:
                        f.write(markdown)
                    os.replace(f"{path}.{os.getpid()}.tmp", path)
                except OSError as e:
                    error = MESSAGES["OutputWriteFailed"].format(path=path, detail=e)
                out.append((doc_id, path, error))
            yield pd.DataFrame(out, columns=["doc_id", "path", "error"])

    rows = docs.filter("markdown is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).cast("string").alias("stem"), "markdown")
    return rows.mapInPandas(run, "doc_id bigint, path string, error string")
