"""MinHash near-duplicates: b-bit signatures, bands, exact confirmation.

1. Every text becomes its set of hashed word shingles; texts with equal sets
   form a class, merged by a pre-aggregated group-by, so copies cost nothing
   further. A class has a number of its own, keeps its smallest document id and a
   packed signature: the low BITS bits of each of BANDS * ROWS minima.
2. Bands of the signature make candidates. A bucket first links its members to
   two pivots only (the smallest number, the smallest hash): rows grow with the
   members, not with their pairs. Packed signatures, compared by bit counts and
   corrected for chance collisions, discard unlikely candidates; the rest are
   confirmed on full sets, recomputed from the texts of those documents.
3. Confirmed links are contracted. A bucket with one component left is done. In
   every other one, the members outside its largest component meet all its
   members, block by block. A pair of two components is looked at in its first
   common bucket only; if it looks alike, it is confirmed right there on full
   sets, unless the links found so far in the block join its components already.
   Only links leave a block, fewer than it has members. So no link between
   components is skipped because a bucket is large, and no list of pairs is made.
4. Components come from min-label propagation with pointer jumping over the
   links; each step is written to the shared folder.

Rows are found again by their id and a hash of their text, never by their place
in a scan, so the input may be any table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WORDS = 5
SIMILARITY = 0.75
ROWS = 4
BANDS = 32
BITS = 8
#: Candidates whose estimated similarity is so much below the threshold are discarded; over four standard errors.
SLACK = 0.16
#: Members of a confirmed group.
BLOCK = 128
#: Members, and shingles of all of them, about, of a block when buckets are compared whole.
WIDE_BLOCK, WIDE_SHINGLES = 1024, 500_000
#: Words whose hashes a task remembers.
KNOWN_WORDS = 100_000

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)
#: Shingles that all hash functions take at once.
STEP = 512


class Shingler:
    """Sets of hashed word shingles; remembers the hashes of short words."""

    def __init__(self, most: int = KNOWN_WORDS):
        self.known: dict[bytes, int] = {}
        self.most = most

    def _word(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self.known) < self.most and len(word) <= 64:
            self.known[word] = h
        return h

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes; empty without words."""
        known = self.known
        words = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
        h = np.array([known[w] if w in known else self._word(w) for w in words], dtype=np.uint64)
        if not len(h):
            return h
        width = min(WORDS, len(h))
        n = len(h) - width + 1
        mixed = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(shingles: np.ndarray) -> bytes:
    """The low bits of the minima of all hash functions, one byte each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    minima = np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), STEP):
        hashed = _A * x[at : at + STEP]
        hashed += _B
        np.minimum(minima, hashed.min(axis=1), out=minima)
    minima ^= minima >> np.uint32(15)
    minima *= np.uint32(0x85EBCA6B)
    return (minima >> np.uint32(32 - BITS)).astype(np.uint8).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for minima that agree in their low bits by chance."""
    differ = a ^ b
    differ |= differ >> 4
    differ |= differ >> 2
    differ |= differ >> 1
    unequal = np.bitwise_count(np.packbits(differ & 1, axis=-1)).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - unequal / len(_A) - chance) / (1 - chance)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            count, digest, packed = [], [], []
            for text in part.column("text").to_pylist():
                found = shingler.shingles(text)
                count.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                packed.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "mark", "n_shingles", "digest", "packed"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose signatures may belong to texts that are similar enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, len(_A)) for c in ("pa", "pb"))
            keep = pa.array(estimate(a, b) >= SIMILARITY - SLACK)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _confirm(table: pa.Table) -> pa.Table:
    """One pivot's text against a block of others."""
    shingler = Shingler()
    rows = table.select(["a", "b", "text"]).to_pylist()
    pivot = next((shingler.shingles(r["text"]) for r in rows if r["a"] == r["b"]), None)
    a, b = [], []
    for r in rows:
        if r["a"] != r["b"] and pivot is not None:
            own = shingler.shingles(r["text"])
            common = len(np.intersect1d(pivot, own, assume_unique=True))
            if 100 * common >= 100 * SIMILARITY * (len(pivot) + len(own) - common):
                a.append(r["a"])
                b.append(r["b"])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. Each block carries its pivot's text once."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    heads = blocks.select("a", F.col("a").alias("b"), "block").distinct()
    with_text = blocks.unionByName(heads).join(texts.select(F.col("id").alias("b"), "text"), "b")
    return with_text.groupBy("a", "block").applyInArrow(_confirm, "a long, b long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label) with the smallest id of each component, for ids that have links.

    Each step takes the smallest label among a node and its neighbours, then
    jumps to that label's own label, until nothing changes.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("label")), name)
    while True:
        # a hub's neighbours are many: a merge join lets Spark split that key
        near = both.join(labels.select(F.col("id").alias("to"), "label").hint("merge"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        step = step.join(labels.select(F.col("id").alias("to"), F.col("label").alias("jump")), "to", "left")
        step = materialize(step.select("id", "old", F.least("to", F.coalesce("jump", "to")).alias("label")), name)
        labels = step.select("id", "label")
        if step.filter("old <> label").limit(1).count() == 0:
            return labels


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, id, n, least, other) for buckets of two members at least."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("packed"), k * ROWS + 1, F.lit(ROWS))))
    members = classes.select("id", F.posexplode(bands).alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min_by("id", F.xxhash64("id")).alias("other")).filter("n > 1")
    # stored, it joins as a plain table, and Spark can split a bucket with many members
    return members.join(materialize(shared, "shared").hint("merge"), "bucket")


def _block_links(table: pa.Table) -> pa.Table:
    """Links between components within one pair of blocks, as many as join what can be joined.

    Left are the rows of the left block, right all of the right one; a row may be
    both. Pairs in which both sides are outside the main component are looked at
    from the smaller number only.
    """
    ids, label, band, n, side, rest = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("id", "label", "band", "n_shingles", "side", "rest"))
    packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands, texts = packed.view(np.uint32), table.column("text")
    shingler, sets, root = Shingler(), {}, {x: x for x in set(label.tolist())}

    def full(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(shingler.shingles(texts[i].as_py()).tolist())
        return sets[i]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    a, b = [], []
    for i in left.tolist():
        meets = (label[right] != label[i]) & ((rest[right] == 0) | (ids[right] > ids[i]))
        meets &= (4 * np.minimum(n[right], n[i]) >= 3 * np.maximum(n[right], n[i]))
        others = right[meets]
        others = others[(bands[others] == bands[i]).argmax(axis=1) == band[i]] if len(others) else others
        if not len(others):
            continue
        rated = estimate(packed[others], packed[i])
        order = np.argsort(-rated, kind="stable")
        for j in others[order[: int((rated >= SIMILARITY - SLACK).sum())]].tolist():
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y:
                own, other = full(i), full(j)
                common = len(own & other)
                if 100 * common >= 100 * SIMILARITY * (len(own) + len(other) - common):
                    root[max(x, y)] = min(x, y)
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest(buckets: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across the components of a bucket: who is outside the largest one against all, block by block."""
    members = buckets.filter("n > 2").select("bucket", "band", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))  # two members have met already
    members = members.join(classes.select("id", "packed", "n_shingles"), "id")
    parts = members.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("s"))
    largest = F.max(F.struct("k", "s", "label"))
    wide = lambda k, s: F.ceil(F.greatest(k / WIDE_BLOCK, s / WIDE_SHINGLES)).cast("long")
    split = parts.groupBy("bucket").agg(largest.alias("main"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.count("*").alias("labels")).filter("labels > 1")
    split = materialize(split.select("bucket", F.col("main.label").alias("main"), wide(F.col("k") - F.col("main.k"), F.col("s") - F.col("main.s")).alias("lefts"), wide(F.col("k"), F.col("s")).alias("rights")), "split")
    placed = members.join(split.hint("merge"), "bucket").withColumn("rest", (F.col("label") != F.col("main")).cast("int"))
    place = placed.withColumn("l", F.pmod(F.xxhash64("id", F.lit(1)), F.col("lefts"))).withColumn("r", F.pmod(F.xxhash64("id", F.lit(2)), F.col("rights")))
    # side 1: right member of (every l, own r), side 0: left member of (own l, another r), side 2: both in (own l, own r)
    as_right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1), lambda k: F.struct(k.alias("i"), F.col("r").alias("j"), F.when((F.col("rest") == 1) & (k == F.col("l")), 2).otherwise(1).alias("side")))
    as_left = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1), lambda k: (F.col("rest") == 1) & (k != F.col("r"))), lambda k: F.struct(F.col("l").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    placed = place.select("bucket", "band", "id", "label", "rest", "packed", "n_shingles", F.inline(F.concat(as_right, as_left))).join(texts, "id")
    return placed.groupBy("bucket", "i", "j").applyInArrow(_block_links, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``mark``, a hash of the text."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def _find(rows: DataFrame, wanted: DataFrame, by: str, get: str) -> DataFrame:
    """(by, get): of the rows with a wanted (doc_id, mark) one each. Equal rows are merged where they are read."""
    wanted = wanted.select(by, F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.xxhash64("doc_id", "mark").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    return rows.withColumn("_key", F.xxhash64("doc_id", "mark")).join(wanted, "_key").filter(same).groupBy("_key", by).agg(F.first(get).alias(get)).select(by, get)


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, classes): doc_id, n_shingles and digest of every row; and for every class its digest, the
    number of its component (``label``), the smallest id of the class (``doc_id``) and of its component
    (``component``), and the mark of the text that stands for the class."""
    rows = _keyed(docs)
    profile = materialize(rows.select("doc_id", "mark", "text").mapInArrow(_profile, "doc_id long, mark long, n_shingles long, digest binary, packed binary"), "profile")
    # the smallest id stands for a class, and with it one of its texts; rows without an id only where there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    grouped = profile.filter("digest is not null").groupBy("digest").agg(first.alias("first"), F.first("packed").alias("packed"), F.first("n_shingles").alias("n_shingles"))
    numbered = grouped.select(F.monotonically_increasing_id().alias("id"), "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), "packed", "n_shingles")
    classes = materialize(numbered, "classes")  # numbers hold from here on
    buckets = materialize(_buckets(classes), "buckets")
    stars = buckets.select(F.col("id").alias("b"), F.explode(F.array("least", "other")).alias("a")).filter("a <> b").distinct()
    packed = classes.select("id", "packed")
    pairs = stars.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b").select("a", "b", "pa", "pb").mapInArrow(_alike, "a long, b long")
    texts = materialize(_find(rows, classes.join(buckets.select("id").distinct(), "id"), "id", "text"), "texts")
    labels = components(materialize(_confirmed(materialize(pairs, "pairs"), texts), "confirmed"))
    # further links join whole components: only their numbers are left to be merged
    more = materialize(_rest(buckets, classes, labels, texts), "links")
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(lifted).toDF("first", "merged")
    known = classes.select("id", "digest", "doc_id", "mark").join(labels, "id", "left").withColumn("first", F.coalesce("label", "id")).drop("label")
    known = known.join(merged.hint("merge"), "first", "left").withColumn("label", F.coalesce("merged", "first"))
    named = known.groupBy("label").agg(F.min("doc_id").alias("component"))
    return profile.select("doc_id", "n_shingles", "digest"), known.join(named.hint("merge"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of every document: doc_id, n_shingles, component_id, kept.

    Reads ``doc_id`` and ``text``. Texts without words (null, empty, blanks) have
    no shingles and are linked with nothing; shorter ones are one shingle. Rows
    with a null id take part in links but name no component; a component of such
    rows alone has a null id and they are kept. Rows that share an id are linked
    by their texts only. An empty table gives an empty result.
    """
    profile, classes = classified(docs)
    out = profile.join(classes.select("digest", F.lit(True).alias("in"), "component").hint("merge"), "digest", "left")
    component = F.when(F.col("in"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The input rows without near-duplicates: of each component one row with its smallest id; rows without words stay.

    A component of rows without ids keeps one of them. Equal rows are
    interchangeable, and extra columns pass through under any name.
    """
    _, classes = classified(docs)
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"))
    stay = materialize(first.select("label", "first.doc_id", "first.mark"), "kept")
    text = text_or_empty()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.rlike(WORD).alias("words"))
    one = _find(rows.filter("words"), stay, "label", "row")
    return one.select("row").unionByName(rows.filter("not words").select("row")).select("row.*")
