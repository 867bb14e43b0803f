"""Command line: convert or inspect a url, a file or a folder of documents.

    spark-submit --master ... -m foliomill.cli INPUT [options]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ConversionConfig, parse_pages, parse_separator
from .errors import ConversionError
from .operators.assemble import conversion_output
from .plans.convert import convert, convert_to_files, stored, work_folder
from .sources.files import read_files, resolve
from .sources.pages import TextPages, inspect
from .sources.provider import resolve_provider


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliomill", description=__doc__)
    p.add_argument("input", help="url, or file or folder in any store that Spark reads")
    p.add_argument("-o", "--output", help="folder for <doc_id>.md files")
    p.add_argument("--json", action="store_true", help="print JSON (ignored with --output)")
    p.add_argument("--inspect-only", action="store_true")
    p.add_argument("--pages", default="all")
    p.add_argument("--separator", default="none")
    p.add_argument("--model")
    p.add_argument("--provider")
    p.add_argument("--dpi", type=int, default=150)
    p.add_argument("--concurrency", type=int, default=10)
    p.add_argument("--max-retries", type=int, default=3)
    p.add_argument("--max-tokens", type=int, default=4096)
    p.add_argument("--temperature", type=float, default=0.1)
    p.add_argument("--maintain-format", action="store_true")
    p.add_argument("--metadata", action="store_true")
    p.add_argument("--fidelity", choices=("tier1", "tier2", "tier3"), default="tier2")
    p.add_argument("--system-prompt", help="file with the system prompt")
    p.add_argument("--password")
    p.add_argument("--download-timeout", type=int, default=120)
    p.add_argument("--api-timeout", type=int, default=60)
    return p


def config_of(args: argparse.Namespace) -> ConversionConfig:
    prompt = None
    if args.system_prompt:
        with open(args.system_prompt, encoding="utf-8") as f:
            prompt = f.read()
    return ConversionConfig(
        dpi=args.dpi, concurrency=args.concurrency, model=args.model, provider_name=args.provider, temperature=args.temperature, max_tokens=args.max_tokens, max_retries=args.max_retries,
        maintain_format=args.maintain_format, fidelity=args.fidelity, system_prompt=prompt, pages=parse_pages(args.pages), page_separator=parse_separator(args.separator),
        include_metadata=args.metadata, password=args.password, download_timeout_secs=args.download_timeout, api_timeout_secs=args.api_timeout,
    )


def inputs(spark: SparkSession, where: str, config: ConversionConfig) -> DataFrame:
    """(doc_id, uri, content, error) of a url, a file or a folder."""
    if where.startswith(("http://", "https://")):
        found = resolve(spark.createDataFrame([(0, where)], "doc_id bigint, uri string"), timeout_secs=config.download_timeout_secs)
    else:
        found = read_files(spark, where)
    return found.select(F.xxhash64("uri").alias("doc_id"), "uri", "content", "error")


def main(argv: list[str] | None = None, out=None) -> int:
    """0 if every input was converted, else 1; what could not be read or converted is told on stderr."""
    out = out or sys.stdout
    args = parser().parse_args(argv)
    try:
        config = config_of(args)
        spark = SparkSession.builder.getOrCreate()
        found = stored(inputs(spark, args.input, config), work_folder(spark), "inputs")  # a url is fetched once
        bad = 0
        for row in found.filter("error is not null").select("error").toLocalIterator():
            bad += 1
            print(row.error, file=sys.stderr)
        docs = found.filter("error is null").drop("error")
        if args.inspect_only:
            for row in inspect(docs, TextPages(), config).toJSON().toLocalIterator():
                print(row, file=out)
            return int(bad > 0)
        provider = resolve_provider(config)
        if args.output:
            documents = convert_to_files(docs, args.output, TextPages(), provider, config)
            lines = documents.select("doc_error", F.concat(F.col("doc_id"), F.lit(": "), F.coalesce("processed_pages", F.lit(0)), F.lit(" pages\n")).alias("line"))
        else:
            documents, pages = convert(docs, TextPages(), provider, config)
            if args.json:
                lines = conversion_output(pages, documents).join(documents.select("doc_id", "doc_error"), "doc_id").select("doc_error", F.concat("json", F.lit("\n")).alias("line"))
            else:
                text = F.coalesce("markdown", F.lit(""))
                lines = documents.select("doc_error", F.concat(text, F.when((text == "") | text.endswith("\n"), "").otherwise("\n")).alias("line"))
        for row in lines.toLocalIterator():
            if row.doc_error is not None:
                bad += 1
                print(row.doc_error, file=sys.stderr)
            out.write(row.line)
        return int(bad > 0)
    except ConversionError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
