"""Token counts: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the characters up to the next space. No
piece of the vocabulary holds a space mark after another character, so the
library's merges never cross from one pre-token to the next and the count of a
text is the sum over its pre-tokens.

Plan: (1) every task gathers its distinct pre-tokens, one shuffle merges them,
and the library counts each once; (2) each document is reduced to pre-token
frequencies; the most frequent pre-tokens, at most ``head`` short strings, are joined from a broadcast table, all others by a shuffle join; (3)
one sum per document. Frequent pre-tokens thus never meet in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Bounds of the broadcast table: entries, and characters of an entry.
HEAD = 300_000
HEAD_CHARS = 40
#: A task passes its distinct pre-tokens on when it holds this many characters.
FLUSH_CHARS = 24_000_000

_RUNS = re.compile(r" +[^ ]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without the first of its spaces."""
    if not text:
        return []
    text = text.replace("▁", " ")  # the library's own mark for a space
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    size = 0

    def flush():
        return pa.RecordBatch.from_pydict({"pretoken": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            before = len(held)
            held.update(set(pretokens(text)))
            size += 60 * (len(held) - before) + len(text) // 8
            if size > FLUSH_CHARS:
                yield flush()
                held, size = Counter(), 0
    if held:
        yield flush()


def _count_pieces(model_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for part in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
                words = part.column(0).to_pylist()
                # a lone trailing space is the one mark that an empty string stands for
                pieces = [len(ids) if word else 1 for word, ids in zip(words, model.encode(words, num_threads=1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pieces, pa.int64())], ["pretoken", "n", "pieces"])

    return count


def _frequencies(head):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get
        for batch in batches:
            ids = batch.column("row_id").to_pylist()
            docs = batch.column("doc_id").to_pylist()
            row_id, doc_id, n_bytes, words, n = [], [], [], [], []
            for row, doc, text in zip(ids, docs, batch.column("text").to_pylist()):
                total = 0
                for word, times in Counter(pretokens(text)).items():
                    pieces = known(word)
                    if pieces is None:
                        row_id.append(row)
                        doc_id.append(None)
                        n_bytes.append(None)
                        words.append(word)
                        n.append(times)
                    else:
                        total += pieces * times
                row_id.append(row)
                doc_id.append(doc)
                n_bytes.append(len(text.encode()))
                words.append(None)
                n.append(total)
            yield pa.RecordBatch.from_pydict({
                "row_id": pa.array(row_id, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()),
                "pretoken": pa.array(words, pa.string()), "n": pa.array(n, pa.int64()),
            })

    return count


def token_counts(docs: DataFrame, *, model_path: str | None = None, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """Token count of every text, as the sentencepiece library gives it.

    Reads ``doc_id`` and ``text``; other columns are ignored. Returns doc_id,
    n_bytes, n_tokens, over_limit, one row per input row. A null text counts as
    empty (0 bytes, 0 tokens); a null or repeated doc_id keeps its own row; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = docs.select("text").mapInArrow(_distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    vocabulary = materialize(found.mapInArrow(_count_pieces(model_path or default_model()), "pretoken string, n long, pieces long"), "pretokens")
    short = vocabulary.filter(F.length("pretoken") <= HEAD_CHARS)
    # frequency classes, an eighth of a power of two each; the whole top classes that fit make the head
    classes = short.groupBy(F.floor(8 * F.log2("n")).alias("c")).agg(F.count("*").alias("rows")).orderBy(F.desc("c")).collect()
    within = [c.c for c, rows in zip(classes, accumulate(c.rows for c in classes)) if rows <= head]
    top = short.filter(F.floor(8 * F.log2("n")) >= (within[-1] if within else float("inf"))).select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))
    rows = docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_frequencies(known), "row_id long, doc_id long, n_bytes long, pretoken string, n long")
    # rows without a pretoken get keys of their own: no null key gathers them in one task
    rows = rows.withColumn("key", F.coalesce("pretoken", F.concat(F.lit("\x00"), F.col("row_id").cast("string"))))
    counted = rows.join(vocabulary.select(F.col("pretoken").alias("key"), "pieces"), "key", "left")
    tokens = F.when(F.col("pretoken").isNull(), F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    per_row = counted.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return per_row.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
