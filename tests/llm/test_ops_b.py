"""Packing and fingerprints against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliomill.llm.fingerprints import Hasher, combine, fingerprints, likeness
from foliomill.llm.packing import pack, patterns
from test_ops_a import SCHEMA, TEXTS, rows


def test_pack(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + ["x  <|endoftext|> y ", "word " * 5000, " \n\n  a\t b", "don't  we'll", "²³ ½ \x1c\x1d\x85 z", "a  b c"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    ids = defaultdict(list)
    for r in rows(texts):
        ids[r[0]].append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    seqs, pieces = defaultdict(list), Counter()
    for r in pack(df).collect():
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == Counter({k: sum(map(len, v)) for k, v in ids.items()})
    for held in seqs.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_padding(spark):
    found = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg({"length": "sum", "sequence_id": "max"}).first()
    tokens, sequences = found["sum(length)"], found["max(sequence_id)"] + 1
    assert tokens <= 1024 * sequences <= 1.01 * tokens


def test_patterns():
    rng = np.random.default_rng(3)
    demand = {int(s): int(n) for s, n in zip(*np.unique(rng.integers(1, 129, 20_000), return_counts=True))}
    found = patterns(demand, 128)
    used = Counter()
    for order, times in found:
        assert sum(s * c for s, c in order.items()) <= 128 and times > 0
        for s, c in order.items():
            used[s] += c * times
    assert used == demand
    assert sum(t for _, t in found) <= 1.01 * sum(s * n for s, n in demand.items()) / 128 + 2
    assert patterns({}, 128) == []


def test_fingerprints(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        want[(r[0], len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest())] += 1
    got = fingerprints(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = fingerprints(df.filter("doc_id = 11")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    many = spark.range(3000).selectExpr("id * 3 as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> cast(hash(id, i) % 5000 as string))) as text")
    texts = [r.text for r in many.orderBy("doc_id").collect()]
    out = fingerprints(many).orderBy("doc_id").collect()
    for k, r in enumerate(out):
        t, f = texts[k], texts[(k + 1) % len(texts)]
        n = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + f[:n]).encode()).hexdigest()
    assert sum(r.near_edited for r in out) / len(out) > 0.6 > 0.2 > sum(r.near_next for r in out) / len(out)


def test_homomorphism():
    h = Hasher()
    a, b, c = "one two three four", "five six seven", "the eighth line of all"
    whole = h.fingerprint(f"{a}\n{b}\n{c}")
    assert whole == h.fingerprint(f"{c}\n{a}\n{b}") != h.fingerprint(f"{a}\n{b}\n{b}")
    assert combine(h.fingerprint(f"{a}\n{b}"), h.fingerprint(c)) == whole
    assert combine(whole, h.fingerprint(c), -1) == h.fingerprint(f"{b}\n{a}")
    assert likeness(whole, h.fingerprint(f"{a}\n{b}")) > likeness(whole, h.fingerprint("nothing of it is here at all"))


def test_ids_equal_the_library():
    import random

    from foliomill.llm.packing import default_vocabulary, token_bytes

    library = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(9)
    signs = "ab Z\n\t  '.,!?09²éß日😀́  \x1c\x85<|>_-"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(5000)] + ["it's they'll I'D", "<|endoftext|>", "w" * 3000, "1" * 500]
    for text, data in zip(texts, token_bytes(texts, default_vocabulary())):
        assert data == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_ids_equal_the_library_at_mixed_blanks():
    import random

    from foliomill.llm.packing import default_vocabulary, token_bytes

    library = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(10)
    texts = ["a" + " \u00a0" * n + tail for n in range(1, 18) for tail in (" x", "x", "", " ")]
    texts += ["".join(rng.choices(" \u00a0\n\t\u2003\u3000\x1c\x85\u200bab1.'", weights=[8, 8] + [1] * 12, k=rng.randint(0, 40))) for _ in range(5000)]
    for text, data in zip(texts, token_bytes(texts, default_vocabulary())):
        assert data == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
