"""Substring dedup: sampled word runs, then exact windows, then exact passages.

A repeated passage of more than n words holds a window of n + 1 whole words.
Runs of fewer words are hashed, and of all runs in a window the one of least
hash is sampled, so two equal windows sample equal runs and a window without a
sampled run that several documents have is not repeated. Every other window is
hashed whole and grouped by digest (pre-aggregated, so a frequent window costs
one row per task); the smallest document that has a window is its first. Each
window that lies beyond the passages found before it is extended on the text of
its document and of its first, byte by byte, to the longest passage they share.
Groups hold one first document and a block of others, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: A repeated passage has more words than this.
WORDS = 50
BLOCK = 64
#: Windows are grouped in so many parts one after the other, by digest, so that fewer are on disk at once.
PARTS = 2

#: Digests are polynomials of the bytes modulo 2^64, from prefix sums.
_BYTES = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers modulo 2^64; they are kept for the next text."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    _POWERS[base] = out
    return out


def words_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    blank = np.concatenate([[True], _BLANK[a], [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def prefixes(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * _powers(_BASE, len(a))[: len(a)], dtype=np.uint64)])


def digests(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of the bytes from each start to its end."""
    h = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 2**64), len(sums))[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slide(h: np.ndarray, width: int, of: Callable) -> np.ndarray:
    """The least or the greatest of each ``width`` neighbours, by doubling."""
    n, x = 1, h
    while 2 * n <= width:
        x, n = of(x[:-n], x[n:]), 2 * n
    count = len(h) - width + 1
    return of(x[:count], x[width - n : width - n + count])


def sampled(h: np.ndarray, width: int) -> np.ndarray:
    """Places of all runs that are the least of some ``width`` neighbours, ties included."""
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, _slide(h, width, np.minimum), edge]), width, np.maximum) >= h)


def _batch(columns: dict[str, tuple[list[np.ndarray], type]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(x).astype(kind) if x else np.empty(0, kind)) for c, (x, kind) in columns.items()})


def _runs(window: int, run: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows, docs, at, found = [], [], [], []
                for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("row_id", "doc_id", "text"))):
                    a = np.frombuffer(text.encode(), np.uint8)
                    starts, ends = words_of(a)
                    if len(starts) >= window:
                        h = digests(prefixes(a), starts[: len(starts) - run + 1], ends[run - 1 :])
                        places = sampled(h, window - run + 1)
                        rows.append(np.full(len(places), row))
                        docs.append(np.full(len(places), doc))
                        at.append(places)
                        found.append(h[places].view(np.int64))
                yield _batch({"row_id": (rows, np.int64), "doc_id": (docs, np.int64), "at": (at, np.int32), "digest": (found, np.int64)})

    return cut


def _windows(window: int, run: int, kept: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows, docs, at, found = [], [], [], []
                for row, doc, text, places in zip(*(part.column(c).to_pylist() for c in ("row_id", "doc_id", "text", "places"))):
                    a, places = np.frombuffer(text.encode(), np.uint8), np.array(places)
                    starts, ends = words_of(a)
                    n = len(starts) - window + 1
                    # windows that hold a shared run whole
                    steps = np.bincount(np.maximum(places + run - window, 0), minlength=n + 1) - np.bincount(np.minimum(places + 1, n), minlength=n + 1)
                    k = np.flatnonzero(np.cumsum(steps)[:n] > 0)
                    h = digests(prefixes(a), starts[k], ends[k + window - 1])
                    mine = h % np.uint64(PARTS) == kept
                    k, h = k[mine], h[mine]
                    rows.append(np.full(len(k), row))
                    docs.append(np.full(len(k), doc))
                    at.append(starts[k])
                    found.append(h.view(np.int64))
                yield _batch({"row_id": (rows, np.int64), "doc_id": (docs, np.int64), "start": (at, np.int32), "digest": (found, np.int64)})

    return cut


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes are equal, looked at in growing pieces."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _passages(least_words: int):
    def extend(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next((r for r in rows if r["doc_id"] == r["first_doc"]), None)
        out = []
        if head:
            b = np.frombuffer(head["text"].encode(), np.uint8)
            for r in rows:
                if r["doc_id"] == r["first_doc"]:
                    continue
                data = r["text"].encode()
                a, done = np.frombuffer(data, np.uint8), -1
                seeds = np.sort(np.array(r["seeds"], np.int64))
                starts, ends = words_of(a)
                least_ends = ends[np.searchsorted(starts, seeds >> 32) + least_words]
                for seed, least_end in zip(seeds.tolist(), least_ends.tolist()):
                    if least_end <= done:
                        continue
                    at, other = seed >> 32, seed & 0xFFFFFFFF
                    end = at + _reach(a[at:], b[other:])
                    start = at - _reach(a[:at][::-1], b[:other][::-1])
                    passage = data[start:end]
                    n = len(passage.split())
                    # words cut by the passage's ends don't count
                    n -= bool(start and passage[:1].strip() and data[start - 1 : start].strip()) + bool(end < len(data) and passage[-1:].strip() and data[end : end + 1].strip())
                    if n > least_words:
                        done = end
                        at_char = len(data[:start].decode(errors="ignore"))
                        out.append((r["doc_id"], head["doc_id"], at_char, at_char + len(passage.decode(errors="ignore")), n))
        kinds = [pa.int64()] * 5
        columns = list(zip(*out)) if out else [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "first_doc_id", "start", "end", "n_words"])

    return extend


#: Shuffle files go as soon as a table is written; nothing reads them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(_CLEAN, before)


#: A row is known by its id and a hash of its text, wherever it stands; a pair has a row and a first row.
ROW = ("row_id", "doc_id")
PAIR = (*ROW, "first_row", "first_doc")


def _linked(likely: DataFrame, window: int, run: int, kept: int) -> DataFrame:
    """Rows and the first rows of their windows, for one part of the windows."""
    found = likely.mapInArrow(_windows(window, run, kept), "row_id long, doc_id long, start int, digest long")
    shared = found.groupBy("digest").agg(F.min(F.struct("doc_id", "row_id", "start")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    hits = found.join(_written(shared.select("digest", "first"), "shared").hint("merge"), "digest").filter("doc_id <> first.doc_id")
    hits = hits.withColumns({"first_row": F.col("first.row_id"), "first_doc": F.col("first.doc_id")})
    # a seed is the window's start in the document and in its first, as one number
    seed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("first.start")
    return hits.groupBy(*PAIR).agg(F.collect_list(seed).alias("seeds"))


def repeated_passages(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """Passages of more than ``words`` words that a document shares with an earlier one.

    Reads ``doc_id`` and ``text``. Returns a row for each passage: doc_id,
    first_doc_id (the smallest id that has the window by which it was found),
    start and end (code points, end exclusive) and n_words. Every window of
    ``words`` + 1 words that a smaller id has too lies in some passage. Documents
    without repeated passages give no row. Null texts count as empty, rows with a
    null id are left out; rows that share an id are not compared with each other;
    equal rows give equal results. The input may be any table, in any order.
    """
    window, run = words + 1, (words + 3) // 3
    rows = docs.filter("doc_id is not null").select(F.xxhash64(text_or_empty()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    runs = rows.mapInArrow(_runs(window, run), "row_id long, doc_id long, at int, digest long")
    several = runs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest")
    # stored, digests of several documents join as a plain table, and Spark can split a frequent one
    places = runs.select(*ROW, "at", "digest").join(_written(several, "several").hint("merge"), "digest").groupBy(*ROW).agg(F.collect_list("at").alias("places"))
    likely = _written(rows.join(places, [*ROW]), "likely")
    parts = [_written(_linked(likely, window, run, k), "passages") for k in range(PARTS)]
    pairs = reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(F.flatten(F.collect_list("seeds")).alias("seeds"))
    pairs = _written(pairs, "passages")
    sizes = pairs.groupBy("first_row", "first_doc").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = pairs.join(sizes, ["first_row", "first_doc"]).select(*PAIR, "seeds", F.pmod(F.xxhash64(*ROW), F.col("blocks")).alias("block"))
    heads = blocks.select(F.col("first_row").alias("row_id"), F.col("first_doc").alias("doc_id"), "first_row", "first_doc", "block").distinct().withColumn("seeds", F.lit(None).cast(blocks.schema["seeds"].dataType))
    with_text = blocks.unionByName(heads).join(likely.select(*ROW, "text"), [*ROW])
    return with_text.groupBy("first_row", "first_doc", "block").applyInArrow(_passages(words), "doc_id long, first_doc_id long, start long, end long, n_words long")
