"""Parsers, rules against a line-by-line model, sources, providers, sinks, streaming."""

import http.server
import io
import json
import math
import random
import re
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomill import cli
from foliomill.config import ConversionConfig, PageSelection, PageSeparator, parse_pages, parse_separator
from foliomill.errors import ConversionError
from foliomill.functions import text as T
from foliomill.operators.pages import in_sequence, prior_context, selected_count
from foliomill.operators.quality import bleu, rouge_l
from foliomill.plans.convert import convert, convert_to_files
from foliomill.queries import cleaned_pages, conversion_json
from foliomill.plans.synthetic import raw_pages
from foliomill.sources.files import from_bytes, read_files, resolve
from foliomill.sources.pages import TextPages, inspect
from foliomill.sources.provider import HttpProvider, MockProvider, Timed, infer_page, resolve_provider
from foliomill.streaming.convert import clean_stream, convert_stream, with_context

SF = "/root/testdata/sf0.001"


def test_selection(spark):
    cases = [(PageSelection(), 5, [0, 1, 2, 3, 4]), (PageSelection.single(3), 5, [2]), (PageSelection.single(6), 5, []), (PageSelection.between(2, 4), 5, [1, 2, 3]), (PageSelection.between(3, 10), 4, [2, 3]),
             (PageSelection.of(3, 1, 3), 5, [0, 2]), (PageSelection.of(3, 1, 3, 2), 5, [0, 1, 2]), (PageSelection.between(4, 2), 5, []), (PageSelection(), 0, [])]
    for selection, n, want in cases:
        assert selection.to_indices(n) == want
        assert spark.range(1).select(selected_count(selection, F.lit(n))).first()[0] == len(want)


def test_parsers():
    assert parse_pages(" ALL ") == PageSelection() and parse_pages("3 - 7") == PageSelection.between(3, 7)
    assert parse_pages("5") == PageSelection.single(5) and parse_pages("1, 3,5") == PageSelection.of(1, 3, 5)
    for bad in ("0", "-5", "1,2-4", "7-3", "x", "", "1,,2", "0,1"):
        with pytest.raises(ConversionError):
            parse_pages(bad)
    assert parse_separator("HR") == PageSeparator("rule") == parse_separator("---") and parse_separator("My Sep") == PageSeparator("custom", "my sep")
    c = ConversionConfig(dpi=9999, concurrency=0, temperature=9, max_rendered_pixels=1)
    assert (c.dpi, c.concurrency, c.temperature, c.max_rendered_pixels) == (400, 1, 2.0, 100)


W = "\t\n\x0b\x0c\r \x85\xa0     　"


def model(x):
    """The rules by plain loops over lines."""
    x = x.replace("\r\n", "\n").replace("\r", "\n").strip(W)
    lines = x.split("\n") if x else []
    if lines and lines[0].strip(W).startswith("```") and "`" not in lines[0].strip(W)[3:]:
        lines = lines[1:]
    if lines and lines[-1].strip(W) == "```":
        lines = lines[:-1]
    lines = [line.rstrip(W) for line in (lines[:-1] if lines and lines[-1] == "" else lines)]
    lines = re.sub("\n{4,}", "\n\n\n", "\n".join(lines)).removesuffix("\n").split("\n")
    out = []
    for i, line in enumerate(lines):
        if line.startswith("#") and i > 0 and (" " not in line or len(line) > len(line.split(" ")[0].encode())):
            while out and out[-1] == "":
                out.pop()
            out = [*(out or [""]), "", line]
        else:
            out.append(line)
    row = lambda s: s.strip(W).startswith("|") and s.strip(W).endswith("|") and len(s.strip(W).encode()) > 2
    mark = lambda s: s.strip(W).startswith("|") and not set(s.strip(W)) - set("|-: ")
    wide = []
    for i, line in enumerate(out):
        wide.append(line)
        follows = i + 1 < len(out) and row(out[i + 1]) and not mark(out[i + 1])
        if row(line) and not mark(line) and follows:
            wide.append("|" + " --- |" * max(line.count("|") - 1, 1))
    kept, place = [], 0
    for line in wide:
        place = place + 1 if row(line) else 0
        if not (place and place != 2 and mark(line)):
            kept.append(line)

    def image(m):
        alt, url = m[1].strip(W), m[2].strip(W)
        if re.match("https?://", url) and not any(h in url for h in T.FAKE_HOSTS):
            return m[0]
        return f"*{alt}*" if alt else ""

    x = re.sub(r"!\[([^\]]*)\]\(([^)]*)\)", image, "\n".join(kept))
    x = "".join(c for c in x if c not in T.INVISIBLE)
    return x.rstrip(W) + "\n"


EXAMPLES = {
    "": "\n", "```": "\n", "| A | B |\n| 1 | 2 |": "| A | B |\n| --- | --- |\n| 1 | 2 |\n", "|---|\n|---|\n| x |": "|---|\n| x |\n", "a\n#tag": "a\n\n#tag\n", "a\n#ééé x": "a\n#ééé x\n",
    "﻿```markdown\n# T\n```": "```markdown\n\n# T\n", "```\n\n# T\n```": "\n\n# T\n", "foo​ \nbar": "foo\nbar\n", "    code\nb": "code\nb\n", "```markdown\n# T\n```\nHope this helps": "# T\n```\nHope this helps\n",
    "![Chart Title](chart.png)": "*Chart Title*\n", "![F](https://arxiv.org/f.png)": "![F](https://arxiv.org/f.png)\n", "![e](https://notexample.com/x)": "*e*\n", "hello​world﻿foo­bar": "helloworldfoobar\n",
    "| h | i |\n| --- | --- |\n| 1 | 2 |\n| --- | --- |\n| 3 | 4 |": "| h | i |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n", "a\n\n\n\n\n\nb": "a\n\n\nb\n",
}


def test_rules_equal_the_model(spark):
    rng = random.Random(3)
    bits = ["\n"] * 6 + ["```", "```md", "#", "# H", "#é", "|", "| a |", "|---|", "--- |", " ", "\t", "\xa0", "　", "\r\n", "\r", "é", "x", "![", "](", ")", "![a](b)", "https://x.y", "example.com", "​", "﻿", "`", "| 1 | 2 |\n| 3 | 4 |\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(6000)] + list(EXAMPLES)
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clean_markdown(F.col("t")).alias("c")).orderBy("i").collect()]
    assert [(t, model(t), g) for t, g in zip(texts, got) if model(t) != g][:3] == []
    assert {t: g for t, g in zip(texts, got) if t in EXAMPLES} == EXAMPLES
    pages = T.clean_pages(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(len(texts), " x ", "bad")], "i int, markdown string, error string"))
    assert [r.markdown for r in pages.orderBy("i").collect()] == [*got, " x "]
    assert spark.sql("select cast(null as string) t").select(T.clean_markdown(F.col("t"))).first()[0] is None


def docs(spark):
    return from_bytes(spark, [(1, b"%PDF-1.4\n# One\n\fTwo\n| a |\n| b |\fThree"), (2, b"%PDF-1.7\n```markdown\nonly\n```"), (3, b"junk"), (4, b"%PDF-1.5\n")])


def test_convert(spark, tmp_path):
    out, pages = convert(docs(spark), TextPages(), MockProvider(), ConversionConfig(page_separator=PageSeparator("comment"), include_metadata=True))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].markdown == '---\npages: 3\npdf_version: "Pdf1_4"\n---\n\n# One\n\n\n<!-- page 2 -->\n\nTwo\n| a |\n| --- |\n| b |\n\n\n<!-- page 3 -->\n\nThree\n'
    assert rows[2].markdown.endswith("only\n") and "corrupt" in rows[3].doc_error and rows[4].processed_pages == 1
    none, _ = convert(docs(spark), TextPages(), MockProvider(), ConversionConfig(pages=PageSelection.single(3)))
    assert {r.doc_id: (r.doc_error or "")[:12] for r in none.collect()} == {1: "", 2: "Page 0 is ou", 3: "PDF '3' is c", 4: "Page 0 is ou"}
    specs = spark.createDataFrame([(1, "2-3", "one.pdf"), (2, None, "two.pdf"), (3, "1", "three.pdf"), (4, "3-1", "four.pdf")], "doc_id long, pages string, uri string")
    own = {r.doc_id: r for r in convert(docs(spark).join(specs, "doc_id"), TextPages(), MockProvider())[0].collect()}
    assert own[1].markdown.startswith("Two") and own[2].processed_pages == 1 and own[4].doc_error == "Invalid configuration: invalid page range '3-1'"
    assert own[3].doc_error == "PDF 'three.pdf' is corrupt: FormatError\nTry repairing with: qpdf --decrypt input.pdf output.pdf"
    assert own[1].render_duration_ms >= 0 and own[1].total_duration_ms >= own[1].llm_duration_ms >= 0
    config = ConversionConfig(max_retries=1, retry_backoff_ms=0)
    failed = {r.doc_id: r for r in convert(docs(spark), TextPages(), MockProvider(share=1), config)[0].collect()}
    assert failed[1].failed_pages == 3 and failed[1].doc_error.startswith("All 3 pages failed after 1 retries each.\nFirst error: Page 1: LLM call failed")
    written = convert_to_files(docs(spark), str(tmp_path / "md"), TextPages(), MockProvider()).collect()
    assert {r.doc_id for r in written if r.path} == {1, 2, 4} and (tmp_path / "md" / "2.md").read_text() == "only\n"
    assert not list((tmp_path / "md").glob("*.tmp"))


def test_sequence_and_retries(spark):
    waits = []
    page = {"doc_id": 1, "page_index": 0, "image_b64": "aGk="}
    got = infer_page(MockProvider(share=1, failures=2), page, None, ConversionConfig(), waits.append)
    assert (got["markdown"], got["retries"], waits) == ("hi", 2, [0.5, 1.0])
    out, _ = convert(docs(spark), TextPages(), MockProvider(), ConversionConfig(maintain_format=True))
    assert {r.doc_id: r.total_input_tokens > 3000 for r in out.filter("doc_id = 1").collect()} == {1: True}
    raw = raw_pages(spark, SF).filter("doc_id < 40")
    step = lambda p, prior: {"doc_id": p["doc_id"], "page_num": p["page_num"], "markdown": p["markdown"], "error": p["error"] and "x", "prior": prior}
    loop = in_sequence(raw, step, "doc_id long, page_num int, markdown string, error string, prior string")
    assert sorted((r.doc_id, r.page_num, r.prior or "") for r in loop.collect()) == sorted((r.doc_id, r.page_num, r.prior or "") for r in prior_context(raw).collect())


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nx")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"ab")
    got = {r.uri.rsplit("/", 1)[1]: r.error for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] is None and got["c.pdf"] is None and "First bytes: [60, 104, 116, 109]" in got["b.pdf"]
    asked = spark.createDataFrame([(1, str(tmp_path / "a.pdf")), (2, str(tmp_path / "b.pdf")), (3, str(tmp_path / "no.pdf")), (4, "http://127.0.0.1:9/x.pdf")], "doc_id long, uri string")
    assert {r.doc_id: r.error_kind for r in resolve(asked, timeout_secs=2).collect()} == {1: None, 2: "NotAPdf", 3: "FileNotFound", 4: "DownloadFailed"}
    meta = {r.doc_id: r for r in inspect(docs(spark), TextPages()).collect()}
    assert (meta[1].page_count, meta[1].pdf_version, meta[1].title, meta[3].error) == (3, "Pdf1_4", None, "FormatError")
    with pytest.raises(ConversionError):
        resolve_provider(ConversionConfig(), env={})
    assert isinstance(resolve_provider(ConversionConfig(provider_name="mock"), env={}), MockProvider)


def test_json_and_cli(spark, tmp_path):
    for r in conversion_json(spark, SF).limit(5).collect():
        out = json.loads(r.json)
        assert list(out) == ["markdown", "pages", "stats"] and "error" in out["pages"][0]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nhello\fworld")
    shown = io.StringIO()
    assert cli.main([str(tmp_path), "--provider", "mock", "--separator", "hr"], shown) == 0
    assert shown.getvalue() == "hello\n\n\n---\n\nworld\n"
    assert cli.main([str(tmp_path), "--pages", "0"]) == 1
    shown = io.StringIO()
    assert cli.main([str(tmp_path), "--inspect-only"], shown) == 0 and json.loads(shown.getvalue())["page_count"] == 2


def run_stream(df, folder, name):
    q = df.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / name))


def test_stream_of_selected_pages(spark, tmp_path):
    raw = raw_pages(spark, SF).filter("doc_id < 60").withColumn("page_count", F.col("page_count").cast("int"))
    chosen = raw.filter("page_num between 2 and 7").withColumn("pages", F.sequence(F.lit(2), F.least(F.lit(7), "page_count")))
    came = chosen.filter("(doc_id + page_num) % 4 <> 0")  # some selected pages are never made
    ends = came.select("doc_id").distinct().select(*(F.col(c) if c == "doc_id" else F.lit(None).cast(kind).alias(c) for c, kind in came.dtypes))
    came.repartition(3).write.parquet(str(tmp_path / "in"))
    ends.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    stream = spark.readStream.schema(came.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(with_context(clean_stream(stream)), tmp_path, "out")
    key = lambda df: sorted((r.doc_id, r.page_num, r.prior or "") for r in df.collect())
    assert len(files) >= 2 and key(got) == key(prior_context(T.clean_pages(came)))


def test_documents_as_a_stream(spark, tmp_path):
    docs(spark).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda df: sorted((r.doc_id, r.page_num or 0, r.markdown, r.error.kind if r.error else "") for r in df.collect())
    for n, config in enumerate((ConversionConfig(), ConversionConfig(maintain_format=True), ConversionConfig(pages=PageSelection.between(2, 7)))):
        got = key(run_stream(convert_stream(stream, TextPages(), MockProvider(), config), tmp_path, f"out{n}"))
        batch = key(convert(docs(spark), TextPages(), MockProvider(), config)[1])
        assert [x for x in got if x[1]] == batch and (3, 0, "", "CorruptPdf") in got
        assert ((2, 0, "", "PageOutOfRange") in got) == (n == 2)


class Answers(http.server.BaseHTTPRequestHandler):
    asked = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, self.headers.get("Authorization"), body))
        if body["model"] == "slow":
            time.sleep(3)
        if body["model"] == "bad":
            self.send_error(500)
            return
        data = json.dumps({"choices": [{"message": {"content": "# hi"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path == "/no.pdf":
            self.send_error(404)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b"%PDF-1.4\nfrom afar")

    def log_message(self, *args): ...


@pytest.fixture
def server():
    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}"
    running.shutdown()


def test_http_provider(server, monkeypatch):
    page = {"doc_id": 1, "page_index": 1, "image_b64": "aGk="}
    quick = ConversionConfig(max_retries=0, api_timeout_secs=1, maintain_format=True)
    got = infer_page(HttpProvider(server, "m", "key"), page, "before", quick)
    assert (got["markdown"], got["input_tokens"], got["output_tokens"], got["error"]) == ("# hi", 7, 2, None)
    path, key, body = Answers.asked[-1]
    assert path == "/chat/completions" and key == "Bearer key" and [m["role"] for m in body["messages"]] == ["system", "system", "user"]
    assert body["messages"][-1]["content"][0]["image_url"]["url"] == "data:image/png;base64,aGk="
    assert infer_page(HttpProvider(server, "bad"), page, None, quick)["error"]["detail"].startswith("HTTP 500")
    late = infer_page(HttpProvider(server, "slow"), page, None, quick)["error"]
    assert (late["kind"], late["page"], late["secs"]) == ("Timeout", 2, 1)

    class Slow:
        def complete(self, messages, options):
            time.sleep(2)

    assert infer_page(Timed(Slow(), 0.1), page, None, quick)["error"]["kind"] == "Timeout"
    assert infer_page(Timed(MockProvider(), 5), page, None, quick)["markdown"] == "hi"
    named = resolve_provider(ConversionConfig(), env={"OPENAI_API_KEY": "k"})
    assert isinstance(named, HttpProvider) and named.api_key == "k"


def test_messages_are_built_alike(spark):
    from foliomill.functions import scalars
    from foliomill.sources.provider import messages

    for keep in (False, True):
        for prior in (None, "", "# Before\n"):
            config = ConversionConfig(maintain_format=keep, system_prompt=None if prior else "own prompt")
            built = scalars.messages(F.lit("aGk="), F.lit(prior).cast("string"), maintain_format=keep, system_prompt=config.system_prompt)
            row = spark.range(1).select(built.alias("m")).first()
            assert [m.asDict(True) for m in row.m] == messages("aGk=", prior, config)


def test_urls(spark, server, tmp_path, capsys):
    shown = io.StringIO()
    assert cli.main([f"{server}/a.pdf", "--provider", "mock"], shown) == 0 and shown.getvalue() == "from afar\n"
    assert cli.main([f"{server}/no.pdf", "--provider", "mock"], io.StringIO()) == 1 and "HTTP 404" in capsys.readouterr().err
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\nhello")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    shown = io.StringIO()
    assert cli.main([str(tmp_path), "--provider", "mock", "--json"], shown) == 1 and "not a valid PDF" in capsys.readouterr().err
    assert [json.loads(x)["markdown"] for x in shown.getvalue().splitlines()] == ["hello\n"]


def test_word_scores(spark):
    rng = random.Random(2)
    pairs = [(i, *(" ".join(rng.choices("abcdef", k=rng.randint(0, 30))) for _ in range(2))) for i in range(60)] + [(60, None, "a"), (61, "a b c d e", "a b c d e")]
    df = spark.createDataFrame(pairs, "i int, got string, want string")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_row(row, x, b)]
        return row[-1]

    def _row(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
        return out[1:]

    def brute_bleu(a, b):
        logs = []
        for n in range(1, 5):
            x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
            hit = sum((x & y).values())
            if not hit:
                return 0.0
            logs.append(math.log(hit / sum(x.values())))
        return math.exp(min(0, 1 - len(b) / len(a)) + sum(logs) / 4)

    rouge, scores = ({r[0]: r[1] for r in f(df, "i").collect()} for f in (rouge_l, bleu))
    for i, got, want in pairs:
        a, b = (got or "").split(), (want or "").split()
        assert abs(rouge[i] - (2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0)) < 1e-9
        if a and b:
            assert abs(scores[i] - brute_bleu(a, b)) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    raw = raw_pages(spark, SF).filter("doc_id < 40").withColumn("page_count", F.col("page_count").cast("int"))
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("pages", clean_stream(stream)), ("context", with_context(clean_stream(stream)))):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination(120)
        q.stop()
    batch = cleaned_pages(spark, SF).filter("doc_id < 40")
    key = lambda df, *c: sorted(tuple("" if r[x] is None else r[x] for x in c) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "pages")), "doc_id", "page_num", "markdown") == key(batch, "doc_id", "page_num", "markdown")
    assert key(spark.read.parquet(str(tmp_path / "context")), "doc_id", "page_num", "prior") == key(prior_context(batch), "doc_id", "page_num", "prior")


def test_progress(spark):
    from foliomill.plans.progress import Progress, metadata_lines, observed, replay
    from foliomill.queries import convert_documents

    class Log(Progress):
        def __init__(self):
            self.events = []

        def on_start(self, doc_id, total):
            self.events.append(("start", doc_id))

        def on_page_complete(self, doc_id, page_num, total, markdown_bytes):
            self.events.append(("page", doc_id))

        def on_page_error(self, doc_id, page_num, total, error):
            self.events.append(("error", doc_id))

        def on_complete(self, doc_id, total, processed):
            self.events.append(("done", doc_id))

    raw = raw_pages(spark, SF).filter("doc_id < 60")
    log = Log()
    replay(raw, convert_documents(spark, SF).filter("doc_id < 60"), log)
    pages, seen = observed(raw)
    pages.write.format("noop").mode("overwrite").save()
    kinds = [k for k, _ in log.events]
    assert kinds.count("start") == 60 and kinds.count("page") + kinds.count("error") == seen.get["pages"] and kinds.count("error") == seen.get["failed"]
    assert ("done", 50) not in log.events and ("done", 1) in log.events
    assert metadata_lines(inspect(docs(spark), TextPages())).filter("doc_id = 1").first().lines == "Page count: 3\nPdf version: Pdf1_4\nIs encrypted: false"
