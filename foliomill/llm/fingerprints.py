"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors modulo powers of two. Sums do not depend on
order, and paragraphs are inserted or deleted by adding or subtracting their
vectors. The vector has two parts: IDENTITY lanes, uniform modulo 2^64, which
tell whether two multisets of paragraphs are equal; and LIKENESS lanes modulo
2^32, which are sums of +-1 over the word triples of the paragraph. The inner
product of two such sums estimates the triples that two documents share, so
fingerprints alone give a likeness from 0 to 1.

Plan: documents are dealt into ranges of ids, so that each meets its successor
in the same task; the first document of every range is also sent to the range
before it. Only range limits go to the driver.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

IDENTITY = 8
LIKENESS = 128
WORDS = 3
#: Documents of a range, about; and how many ranges there are at most (limits are literals of the plan).
RANGE_DOCS = 500
MOST_RANGES = 10_000


class Hasher:
    """Vectors of paragraphs; remembers the hashes of short words."""

    def __init__(self, most: int = 100_000):
        self.words: dict[bytes, int] = {}
        self.most = most

    def _word(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self.words) < self.most and len(word) <= 64:
            self.words[word] = h
        return h

    def _triples(self, paragraph: bytes) -> np.ndarray:
        words = paragraph.split()
        known = self.words
        h = np.array([known[w] if w in known else self._word(w) for w in words], dtype=np.uint64)
        if not len(h):
            return h
        n = max(len(h) - WORDS + 1, 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(min(WORDS, len(h))):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return mixed

    def likeness(self, paragraphs: list[bytes]) -> np.ndarray:
        triples = np.concatenate([self._triples(p) for p in paragraphs])
        lanes = np.zeros(LIKENESS, dtype=np.int64)
        for at in range(0, len(triples), 4096):
            base = triples[at : at + 4096]
            for k in range(LIKENESS // 64):
                bits = (base ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
                bits ^= bits >> np.uint64(33)
                bits *= np.uint64(0xC4CEB9FE1A85EC53)
                bits ^= bits >> np.uint64(29)
                ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                lanes[64 * k : 64 * k + 64] += 2 * ones - len(base)
        return lanes.astype(np.uint64).astype(np.uint32)

    @staticmethod
    def identity(paragraphs: list[bytes]) -> np.ndarray:
        digests = b"".join(hashlib.blake2b(p, digest_size=8 * IDENTITY).digest() for p in paragraphs)
        return np.frombuffer(digests, "<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=np.uint64)

    def fingerprint(self, text: str) -> bytes:
        paragraphs = text.encode().split(b"\n")
        return self.identity(paragraphs).astype("<u8").tobytes() + self.likeness(paragraphs).astype("<u4").tobytes()


def _lanes(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint[: 8 * IDENTITY], "<u8"), np.frombuffer(fingerprint[8 * IDENTITY :], "<u4")


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """The fingerprint after inserting (or, with sign -1, deleting) the paragraphs that b stands for."""
    (x, u), (y, v) = _lanes(a), _lanes(b)
    return (x + y if sign > 0 else x - y).tobytes() + (u + v if sign > 0 else u - v).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of word triples in common, 0 to 1; equal fingerprints give 1."""
    if a == b:
        return 1.0
    u, v = (_lanes(x)[1].view("<i4").astype(np.float64) for x in (a, b))
    norms = float((u * u).sum() + (v * v).sum())
    return min(max(2 * float((u * v).sum()) / norms, 0.0), 1.0) if norms else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    before = None  # (part, doc_id, text, fingerprint) of the row before, if it still waits for its successor
    for batch in batches:
        for piece in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            rows = []
            for part, look, doc, text in zip(*(piece.column(c).to_pylist() for c in ("part", "look", "doc_id", "text"))):
                print_ = hasher.fingerprint(text)
                if before and before[0] == part:
                    _, prior, old, mark = before
                    new = edited(old, text)
                    other = hasher.fingerprint(new)
                    rows.append((prior, len(old), hashlib.sha256(new.encode()).hexdigest(), base64.b64encode(mark).decode(), base64.b64encode(other).decode(), likeness(mark, other), likeness(mark, print_)))
                before = None if look else (part, doc, text, print_)
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _OUT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per input row.

    Reads ``doc_id`` and ``text``; the next document is the next by ascending
    doc_id (null ids first, equal ids by text), after the last the first; a lone
    document is its own successor. Null texts count as empty. An empty table
    gives an empty result. Equal texts have equal fingerprints.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = rows.select("doc_id")
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], _OUT)
    ranges = min(MOST_RANGES, math.ceil(n / RANGE_DOCS))
    limits = sorted({x for x in ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []} - {least})
    # part k holds ids from limit k - 1 up to limit k; every limit is an id, the first of its part
    bounds = F.array(*(F.lit(x) for x in limits)).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_count_below(bounds, F.col("doc_id"), len(limits)))
    dealt = rows.withColumn("part", part.cast("int"))
    first = dealt.filter(F.col("doc_id").isin(*limits) if limits else F.lit(False)).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    opening = rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).withColumn("part", F.lit(len(limits) + 1))
    ahead = first.select("part", "doc_id", "text").unionByName(opening.select("part", "doc_id", "text")).select((F.col("part") - 1).alias("part"), F.lit(True).alias("look"), "doc_id", "text")
    both = dealt.select("part", F.lit(False).alias("look"), "doc_id", "text").unionByName(ahead)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(limits) + 1)
    order = ["part", "look", F.col("doc_id").asc_nulls_first(), "text"]
    return both.repartitionById(tasks, "part").sortWithinPartitions(*order).mapInArrow(_fingerprints, _OUT)  # a range in each task


def _count_below(bounds, value, n: int):
    """How many of the sorted limits are at most the value, by binary search in log2(n) steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length())))) if n else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
