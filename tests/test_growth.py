"""What made queries grow too fast: repeated work, rows one by one to Python, shuffled documents, patterns over every text."""

import re
import time

from pyspark.sql import functions as F

from foliomill import queries as Q
from foliomill.batches import BYTES, arrow_schema, in_batches, rows_of
from foliomill.config import ConversionConfig, PageSelection
from foliomill.functions import text as T
from foliomill.operators.assemble import conversion_output
from foliomill.operators.pages import count_pages, page_texts
from foliomill.plans.convert import raw_results
from foliomill.sources.files import from_bytes
from foliomill.sources.pages import TextPages, render_pages, rendered
from foliomill.sources.provider import MockProvider, infer, infer_page

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall("Exchange hashpartitioning", plan(df)))


def test_sequential_pages_shuffles_once(spark):
    df = Q.sequential_pages(spark, SF)
    assert shuffles(df) == 1 and "Join" not in plan(df)


def test_documents_are_cut_once():
    class Counted(bytes):
        cuts = 0

        def partition(self, mark):
            Counted.cuts += 1
            return super().partition(mark)

    content = Counted(b"%PDF-1.4\n" + b"\f".join(b"page %d" % i for i in range(50)))
    got = [p["content"] for p in rendered(1, content, list(range(1, 51)), TextPages(), ConversionConfig())]
    assert got == [b"page %d" % i for i in range(50)] and Counted.cuts == 1


def test_batches_are_bounded(spark):
    schema = arrow_schema("n long, text string")
    rows = [{"n": i, "text": "x"} for i in range(5000)]
    small, large = list(in_batches(iter(rows), schema)), list(in_batches(({"n": i, "text": "x" * BYTES} for i in range(3)), schema))
    assert len(small) == 5 and len(large) == 3 and list(rows_of(small)) == rows and not list(in_batches([], schema))


def test_page_texts(spark):
    texts = [None, "", "\n", "a", "\n".join("abcdefghij"), "\n".join("abcdefghij") + "\n", "\n" * 29, "\n" * 30, "é\n" * 25]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", page_texts(F.col("text")).alias("pages"), count_pages(F.col("text")).alias("n")).collect():
        lines = r.text and r.text.split("\n") or [""]
        assert r.n is r.pages is None if r.text is None else r.pages == ["\n".join(lines[i : i + 10]) for i in range(0, len(lines), 10)] and r.n == len(r.pages)


def documents(spark):
    return from_bytes(spark, [(1, b"%PDF-1.4\none\ftwo\fthree"), (2, b"%PDF-1.7\nonly"), (3, b"junk"), (4, b"%PDF-1.5\n")])


def test_contents_meet_no_table(spark):
    """Pages of the configuration are chosen where documents are opened; named ones, from a table, as before."""
    docs, config = documents(spark), ConversionConfig(pages=PageSelection.between(2, 9))
    chosen = spark.createDataFrame([(1, [2, 3]), (2, []), (4, [])], "doc_id long, page_nums array<int>")
    assert "Join" not in plan(raw_results(docs, TextPages(), MockProvider(), config, chosen))
    key = lambda df: sorted((r.doc_id, r.page_index, r.image_b64) for r in df.collect())
    assert key(render_pages(docs, TextPages(), config)) == key(render_pages(docs.join(chosen, "doc_id"), TextPages(), config)) != []


def test_conversion_json_makes_pages_once(spark):
    df = Q.conversion_json(spark, SF)
    assert plan(df).count("Generate posexplode") == 1
    joined = conversion_output(Q.cleaned_pages(spark, SF), Q.convert_documents(spark, SF))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, joined.collect()))


def test_convert_documents_makes_pages_once(spark):
    assert plan(Q.convert_documents(spark, SF)).count("Generate posexplode") == 1


def test_infer_pages_shuffles_nothing(spark):
    df = Q.infer_pages(spark, SF)
    assert shuffles(df) == 0 and "Join" not in plan(df)


def test_infer_keeps_its_callers_busy(spark):
    """Calls are handed out ahead of the results; all come back, in order."""
    pages = [{"doc_id": i, "page_index": i, "image_b64": "aGk=", "render_encode_ms": 0, "started_ms": 1} for i in range(300)]
    df = spark.createDataFrame(pages, "doc_id long, page_index int, image_b64 string, render_encode_ms long, started_ms long").coalesce(1)
    config = ConversionConfig(concurrency=3)
    want = [infer_page(MockProvider(), p, None, config) for p in pages]
    assert [(r.doc_id, r.page_num, r.markdown) for r in infer(df, MockProvider(), config).collect()] == [(w["doc_id"], w["page_num"], w["markdown"]) for w in want]


def test_page_images_shuffle_nothing(spark):
    df = Q.page_images(spark, SF)
    assert shuffles(df) == 0 and "Join" not in plan(df)


def test_long_runs_of_blanks_take_linear_time(spark):
    run = " " * 100_000
    df = spark.createDataFrame([(1, f"a{run}b\nc{run}\nd\n\n{run}", None)], "i int, markdown string, error string")
    began = time.time()
    assert T.clean_pages(df).first().markdown == f"a{run}b\nc\nd\n"
    assert time.time() - began < 8


def test_every_blank_is_trimmed(spark):
    texts = [(i, f"{c}a{c}\n b{c}{c}", None) for i, c in enumerate(T.SPACES)]
    got = T.clean_pages(spark.createDataFrame(texts, "i int, markdown string, error string")).collect()
    assert len(T.SPACES) == 24 and {r.markdown for r in got if r.markdown.count("\n") == 2} == {"a\n b\n"}
