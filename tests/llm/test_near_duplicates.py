"""Near-duplicates against all pairs by brute force."""

import random
import re
from collections import Counter

import numpy as np
from foliomill.llm import near_duplicates as near
from foliomill.llm.near_duplicates import Shingler, estimate, keep_one, near_duplicates, signature
from test_ops_a import SCHEMA, rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(table):
    """Component of every row: the smallest id reachable over texts that are alike, whatever ids they share."""
    sets = [(i, frozenset(shingles(t))) for i, t in table]
    distinct = sorted({s for _, s in sets if s}, key=lambda s: (len(s), sorted(s)))
    above = list(range(len(distinct)))

    def root(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, s in enumerate(distinct):
        for b in range(a):
            if 4 * len(distinct[b]) >= 3 * len(s) and 100 * (common := len(s & distinct[b])) >= 75 * (len(s) + len(distinct[b]) - common):
                above[root(a)] = root(b)
    of, least = {s: root(k) for k, s in enumerate(distinct)}, {}
    for i, s in sets:
        if s and i is not None:
            least[of[s]] = min(i, least.get(of[s], i))
    return [(i, len(s), least.get(of[s]) if s else i) for i, s in sets]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = rng.choices(vocabulary, k=60)
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or not out:
            words = rng.choices(vocabulary, k=rng.randint(1, 120))
        elif kind == 1:  # a chain of edits
            words = rng.choice(out).split() or ["x"]
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 2:  # a passage that many share
            words = common + rng.choices(vocabulary, k=rng.randint(5, 40))
        else:
            words = rng.choice(out).upper().split()
        out.append(" ".join(words))
    return out


def test_components(spark):
    table = list(enumerate(corpus(5)))
    got = near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(table))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = near_duplicates(df).collect()
    want = Counter(brute([(r[0], r[1]) for r in rows()]))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_and_missing_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    table = [(5, one), (5, two), (7, two + " end"), (None, one), (None, "only rows without id have it"), (None, "only rows without id have it"), (9, one)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect())
    assert got == Counter(brute(table))
    assert Counter(map(tuple, keep_one(docs).collect())) == Counter([(5, one), (5, two), (None, "only rows without id have it")])


def near_group(seed, n):
    """Near copies of one text, some alike enough and some just not, and lone texts."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 5, 6))):
            words[at] = f"x{i}y{at}"
        out.append(" ".join(words if i % 10 else [f"z{i}k{k}" for k in range(30)]))
    return out


def test_hot_bucket(spark, monkeypatch):
    """A large group in which many pairs look alike and aren't; blocks are small, so that several meet."""
    table = list(enumerate(near_group(8, 1000)))
    want = Counter(brute(table))
    assert 50 < len({c for _, _, c in want}) < 950
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(13)  # rows come in no lasting order
    monkeypatch.setattr(near, "WIDE_BLOCK", 150)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()) == want


def test_keep_one(spark):
    names = SCHEMA.replace("base string", "row string").replace("_words string", "label string")
    docs = spark.createDataFrame(rows(), names)
    left = keep_one(docs)
    assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert texts.count("  a") == 1 and None in texts and "" in texts and "no id here" in texts
    assert keep_one(docs.limit(0)).count() == 0


def test_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    for share in (0.2, 0.5, 0.75, 0.95):
        b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, len(a) - int(share * len(a))).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(signature(s), np.uint8)[None, :] for s in (a, b))
        assert abs(float(estimate(x, y)[0]) - true) < 0.17
    assert len(Shingler().shingles("A b C")) == 1
