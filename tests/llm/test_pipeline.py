"""Each stage of the pipeline against brute force over what the stage before kept; and the SQL twins."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from foliomill.llm import queries
from test_near_duplicates import brute
from test_ops_a import brute_base, brute_quality, brute_targets, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(top / name))
        out.append(spark.read.parquet(str(top / name)))
    return [(df.columns, df.collect()) for df in out]


def test_stages(stages):
    (columns, docs), (_, good), (_, once), (_, clean), (_, mixed), (_, packed) = stages
    assert all(c == columns for c, _ in stages[:5])
    base = {r.doc_id for r in docs if not brute_quality(r.text)[-1]}
    assert {r.doc_id for r in good} <= base and len(good) >= 0.8 * len(base)
    labels = brute([(r.doc_id, r.text) for r in good])
    assert {r.doc_id for r in once} == {c for _, _, c in labels} and len(once) == len({c for _, _, c in labels})
    assert {r.doc_id for r in clean} == {r.doc_id for r in once} and not any(brute_base(r.text) for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    before = {r.doc_id: r for r in clean}
    sizes = Counter()
    for r in clean:
        sizes[r.source] += len(words(r.text))
    taken = Counter()
    for r in mixed:
        assert before[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - t) <= 1 for s, t in brute_targets(dict(sizes)).items())
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in mixed)
    held = Counter()
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 1024


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1][1])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    want = Counter(found.fetchall())
    got = Counter(tuple(r[x] for x in columns) for r in df.collect())
    assert list((got - want).items())[:2] == [] == list((want - got).items())[:2]
