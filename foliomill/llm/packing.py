"""Packing documents into sequences by column generation.

Every document is tokenized once. Full pieces fill sequences of their own;
what remains of each document is a piece shorter than a sequence. Lengths are
rounded up to units, and the histogram of units, at most CAPACITY / UNIT rows,
is a cutting-stock problem: a linear program over patterns whose columns are
priced by a knapsack dynamic program. Rounded-down patterns are used as often
as the program says, the remainder is packed greedily. Pieces are ranked within
their unit by distributed prefix sums; a rank decides the pattern's copy and so
the sequence.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_key, materialize, prefix_sums, text_or_empty

CAPACITY = 1024
#: Lengths are rounded up to this many tokens in the program; offsets use true lengths.
UNIT = 8
#: The program stops within this share of its optimum.
GAP = 0.002
#: Share of the best known prices in those tried.
SMOOTH = 0.8
#: Columns generated at most, so that the program's time is bounded; any stop leaves a full packing.
MOST_COLUMNS = 3000
#: Characters of a text that are encoded at once, about: ids are a list of Python's numbers until they are packed.
PART_CHARS = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- tokens -------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space as the pattern knows it; Python's own class has the separators 1C to 1F besides.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before the last blank of a run that something follows; before a space between two characters that aren't blank.
_LAST_BLANK = re.compile(f"(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")
_SINGLE = re.compile(r"(?<=\S)(?= \S)")
#: What a text with two blanks in a row holds, unless it holds a rarer blank.
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """The ids of texts as the tokenizers library gives them, by a faster encoder of the same vocabulary.

    The vocabulary's pattern looks ahead only to leave the last blank of a run
    to what follows. Texts are cut there beforehand, so that a pattern without
    looking ahead, which is matched several times faster, finds the same pieces.
    The library's own tokenizer is loaded when a text holds one of the added tokens.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:  # installed beside the library on every machine
            spec = json.load(file)
        letters = _byte_letters()
        self.path, self.tokenizer = path, None
        self.added = [token["content"] for token in spec["added_tokens"]]
        ranks = {bytes(map(letters.__getitem__, word)): i for word, i in spec["model"]["vocab"].items() if word not in self.added}  # ids are in merge order
        kinds, ahead, blanks = public_tokenizers.PATTERN.partition(r"|\s+(?!\S)")
        if not ahead or blanks != r"|\s+":
            raise ValueError(f"unknown pattern {public_tokenizers.PATTERN}")
        self.quick = tiktoken.Encoding("ranks", pat_str=kinds + blanks, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        ids = array("I", self.quick(part))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def bytes_of(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.whole(text)
        return b"".join(map(self.part, _parts(text)))


_ENCODERS: dict[str, Encoder] = {}


def _parts(text: str) -> Iterator[str]:
    """A text cut where the pattern starts a new piece: at the last blank of every run, and at single spaces of a long text."""
    runs = any(two in text for two in _DOUBLE) or any(c in text for c in _RARE)
    for part in _LAST_BLANK.split(text) if runs else (text,):
        at = 0
        while len(part) - at > PART_CHARS and (found := _SINGLE.search(part, at + PART_CHARS)):
            yield part[at : found.start()]
            at = found.start()
        yield part[at:] if at else part


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit, without special tokens added."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return list(map(_ENCODERS[path].bytes_of, texts))


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = {c: [] for c in ("row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens")}
                ids = token_bytes(part.column("text").to_pylist(), path)
                for row, doc, data in zip(part.column("row_id").to_pylist(), part.column("doc_id").to_pylist(), ids):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    for start in range(0, n, capacity):
                        piece = data[4 * start : 4 * (start + capacity)]
                        for c, v in zip(rows, (row, doc, start, len(piece) // 4, zlib.crc32(piece), n)):
                            rows[c].append(v)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in rows.items()})

    return cut


# -- cutting stock --------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value and the copies of each item (sorted by size) that fit, by dynamic programming."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            total = best[room - sizes[: fits[room]]] + values[: fits[room]]
            k = int(total.argmax())
            if total[k] > best[room] + 1e-12:
                best[room], last[room] = total[k], k
    copies, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            copies[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), copies


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, by column generation over a simplex basis.

    Prices are smoothed towards the best known feasible ones, at first each
    size's share of the capacity; those also bound the optimum from below, and
    the program stops within ``GAP`` of that bound. Rounding errors only cost
    some waste: ``patterns`` uses whole copies within the demand.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    used = demand / np.diag(basis)
    best = sizes / capacity
    bound, pull = float((best * demand).sum()), SMOOTH
    for step in range(MOST_COLUMNS):
        if used.sum() <= bound * (1 + GAP):
            break
        prices = inverse.sum(axis=0)
        tried = np.maximum(pull * best + (1 - pull) * prices, 0)
        value, column = knapsack(sizes, tried, capacity)
        if float((tried * demand).sum()) / max(value, 1) > bound:
            best, bound = tried / max(value, 1), float((tried * demand).sum()) / max(value, 1)
        if (prices * column).sum() <= 1 + 1e-7:  # no gain at the basis's own prices
            if pull < 1e-3:
                break
            pull /= 2
            continue
        pull = SMOOTH
        direction = (inverse * column).sum(axis=1)  # no BLAS call: its threads can stall inside a driver process
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        theta = max(ratios[out], 0)
        used = np.maximum(used - theta * direction, 0)
        used[out] = theta
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return basis.T.astype(np.int64), used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each size, times) such that all pieces are used exactly once."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes], dtype=np.int64)
    found: list[tuple[dict[int, int], int]] = []
    columns, used = linear_program(sizes, left.astype(float), capacity)
    for column, times in sorted(zip(columns.tolist(), np.floor(used + 1e-6).astype(np.int64).tolist()), key=lambda x: -x[1]):
        column = np.array(column)
        at = column > 0
        times = min(times, int((left[at] // column[at]).min())) if at.any() else 0
        if times > 0:
            left = left - times * column
            found.append(({int(s): int(c) for s, c in zip(sizes, column) if c}, times))
    while left.any():  # at most about one pattern a size is left: best fit by knapsack, then by size
        column, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * sizes[k]
        at = column > 0
        times = int((left[at] // column[at]).min())
        left = left - times * column
        found.append(({int(s): int(c) for s, c in zip(sizes, column) if c}, times))
    return found


def pack(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents with their place, one row per piece.

    Reads ``doc_id`` and ``text``; a document is its ids and then id 0, so a null
    or empty text is a single id. Returns doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. Repeated rows are packed once each, null
    ids are kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    cut = rows.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity), "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(cut.withColumn("size", F.ceil(F.col("length") / unit).cast("long")).withColumn("_key", hash_key("row_id", "doc_id", "start")), "pieces")
    counts = pieces.groupBy("size").agg(F.count("*").alias("_rows"))
    histogram = {r["size"]: r["_rows"] for r in counts.collect()}  # at most capacity / unit rows
    places, first, seen = [], 0, defaultdict(int)
    for order, times in patterns(histogram, capacity // unit):
        slot = 0
        for size, copies in sorted(order.items(), reverse=True):
            places.append((size, seen[size], seen[size] + copies * times, copies, first, slot))
            seen[size] += copies * times
            slot += copies
        first += times
    plan = spark.createDataFrame(places, "size long, low long, high long, copies long, first long, slot long")
    ranked = prefix_sums(pieces.withColumn("one", F.lit(1).cast("long")), "size", counts, "one", "row_id", "start")
    # the plan has a few rows for each of at most capacity / unit sizes
    placed = ranked.join(F.broadcast(plan), "size").filter((F.col("before") >= F.col("low")) & (F.col("before") < F.col("high")))
    at = F.col("before") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(at / F.col("copies"))).withColumn("_slot", F.col("slot") + at % F.col("copies"))
    earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), offset.alias("offset"))
