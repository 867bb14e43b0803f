"""The conversion job: bytes to pages, images, Markdown, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConversionConfig
from ..errors import ConversionError, message, open_error_kind
from ..functions.text import clean_pages
from ..operators.assemble import convert_documents
from ..operators.pages import in_sequence, is_selected, spec_pages
from ..schema import RAW_PAGE
from ..sources.files import write_markdown
from ..sources.pages import PageSource, inspect, render_pages
from ..sources.provider import Provider, infer, infer_page


#: Bytes of a batch that goes to Python, about: pages carry images, and thousands of those would fill a task's memory.
BATCH_BYTES = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write and read back: paid or slow results are never computed twice. Rows go to Python in batches of bounded size."""
    path, conf = f"{folder}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, the one set by API, or one of its own in local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or known.isDefined():
        return named or known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ConversionError("InvalidConfig", detail="spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def selected_pages(docs: DataFrame, metadata: DataFrame, config: ConversionConfig) -> DataFrame:
    """(doc_id, page_count, page_nums, page_error) of documents that could be opened.

    Documents with a column ``pages`` have options of their own; a null one, like
    documents without that column, takes the configuration's.
    """
    counted = metadata.filter("error is null").select("doc_id", "page_count", "inspect_ms")
    numbers = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    usual = F.filter(numbers, lambda n: is_selected(config.pages, n, F.col("page_count")))
    if "pages" not in docs.columns:
        return counted.withColumns({"page_nums": usual, "page_error": F.lit(None).cast("string")})
    own = counted.join(docs.select("doc_id", F.col("pages").alias("_spec")), "doc_id").withColumn("_own", spec_pages(F.col("_spec"), F.col("page_count")))
    return own.select("doc_id", "page_count", "inspect_ms", F.when(F.col("_spec").isNull(), usual).otherwise(F.col("_own.pages")).alias("page_nums"), F.when(F.col("_spec").isNotNull(), F.col("_own.error")).alias("page_error"))


def raw_results(docs: DataFrame, source: PageSource, provider: Provider, config: ConversionConfig, chosen: DataFrame) -> DataFrame:
    """RAW_PAGE rows of the selected pages; selection comes before rendering."""
    selected = docs.select("doc_id", "content")
    if "pages" in docs.columns:
        selected = selected.join(chosen.select("doc_id", "page_nums"), "doc_id")
    images = render_pages(selected, source, config)
    if config.maintain_format:
        step = lambda page, prior: infer_page(provider, page, prior, config)
        return in_sequence(images.withColumn("page_num", F.col("page_index") + 1), step, RAW_PAGE)
    return infer(images, provider, config)


def open_error(metadata: DataFrame, config: ConversionConfig, path: Column) -> Column:
    """The message of a document that could not be opened, by kind."""
    kind = open_error_kind(F.col("error"), F.lit(config.password is not None))
    texts = {k: message(k, path=path, detail=F.col("error")) for k in ("WrongPassword", "PasswordRequired", "CorruptPdf")}
    return F.when(kind == "WrongPassword", texts["WrongPassword"]).when(kind == "PasswordRequired", texts["PasswordRequired"]).otherwise(texts["CorruptPdf"])


def convert(docs: DataFrame, source: PageSource, provider: Provider, config: ConversionConfig = ConversionConfig(), *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) for rows (doc_id, content); one bad document becomes a doc_error, not a failed job.

    ``docs`` may have ``uri``, which error texts name, and ``pages``, page options
    of each document.
    """
    folder = work_folder(docs.sparkSession)
    metadata = stored(inspect(docs, source, config), folder, "metadata")
    chosen = selected_pages(docs, metadata, config)
    raw = stored(raw_results(docs, source, provider, config, chosen), folder, "raw")
    pages = clean_pages(raw)
    counted = chosen.select("doc_id", "page_count", F.size("page_nums").alias("selected_count"), "inspect_ms", "page_error")
    documents = convert_documents(pages, counted, config.page_separator, max_retries=config.max_retries, strict=strict)
    if "pages" in docs.columns:
        wrong = chosen.filter("page_error is not null").select("doc_id", message("InvalidConfig", detail=F.col("page_error")).alias("_wrong"))
        documents = documents.join(wrong, "doc_id", "left").withColumn("doc_error", F.coalesce("_wrong", "doc_error")).drop("_wrong")
    if config.include_metadata:
        from ..functions.scalars import front_matter

        yaml = metadata.filter("error is null").select("doc_id", front_matter({c: F.col(c) for c in metadata.columns}).alias("_yaml"))
        documents = documents.join(yaml, "doc_id").withColumn("markdown", F.concat("_yaml", "markdown")).drop("_yaml")
    bad = metadata.filter("error is not null")
    if "uri" in docs.columns:
        bad = bad.join(docs.select("doc_id", F.col("uri").alias("_path")), "doc_id")
    path = F.col("_path") if "uri" in docs.columns else F.col("doc_id").cast("string")
    corrupt = bad.select("doc_id", open_error(bad, config, path).alias("doc_error"))
    return documents.unionByName(corrupt, allowMissingColumns=True), pages


def convert_to_files(docs: DataFrame, folder: str, source: PageSource, provider: Provider, config: ConversionConfig = ConversionConfig()) -> DataFrame:
    """Convert and write ``<doc_id>.md`` files; statistics and the path of each document."""
    documents = stored(convert(docs, source, provider, config)[0], work_folder(docs.sparkSession), "documents")
    written = write_markdown(documents, folder)
    return documents.drop("markdown").join(written, "doc_id", "left")
