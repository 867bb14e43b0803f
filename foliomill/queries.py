"""The engine's own queries and their DuckDB twins.

The twins work on lines and windows where the engine works on row-local
expressions, so that a slip in one shows against the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import ConversionConfig, PageSelection, PageSeparator
from .errors import message, open_error_kind, page_error_message, short
from .functions import scalars as S
from .functions import text as T
from .operators import assemble as A
from .operators import pages as P
from .operators import quality as Q
from .plans.convert import convert
from .plans.synthetic import CLASSES, FAILS_WHOLE, FORMS, page_counts, raw_pages
from .schema import RAW_PAGE
from .sources.pages import TextPages, inspect, render_pages
from .sources.provider import MockProvider, infer, infer_page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- building blocks of the twins ---------------------------------------------


def _text(s: str) -> str:
    out = "'" + s.replace("'", "''") + "'"
    for c in "\n\r\t ­​﻿":
        out = out.replace(c, f"'||chr({ord(c)})||'")
    return out


def _raw_sql() -> str:
    cases = []
    for k, (before, swaps, after) in FORMS.items():
        text = "text"
        for old, new in swaps:
            text = f"replace({text}, {_text(old)}, {_text(new)})"
        cases.append(f"when {k} then {_text(before)}||{text}||{_text(after)}")
    return f"""
split_lines as (select doc_id, string_split(text, chr(10)) l from documents where text is not null),
cut as (select doc_id, cast(ceil(len(l) / 10.0) as int) page_count, unnest(range(1, cast(ceil(len(l) / 10.0) as int) + 1)) page_num, l from split_lines),
paged as (select doc_id, page_count, cast(page_num as int) page_num, array_to_string(l[(page_num - 1) * 10 + 1:page_num * 10], chr(10)) text from cut),
marked as (select *, (doc_id * 7 + page_num) % {CLASSES} k, (doc_id * 7 + page_num) % {CLASSES} = {CLASSES - 1} or doc_id % {FAILS_WHOLE} = 0 failed from paged),
raw as (select doc_id, page_count, page_num, failed, case when failed then '' else case k {' '.join(cases)} end end markdown from marked)"""


RAW = _raw_sql()
_W = r"\x{09}\x{0B}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\x{{0A}}{_W}]+', ''), '[\\x{{0A}}{_W}]+$', '')"
_ROW = lambda x: f"({_STRIP(x)} like '|%' and {_STRIP(x)} like '%|' and strlen({_STRIP(x)}) > 2)"
_MARK = lambda x: f"regexp_matches({_STRIP(x)}, '^\\|[|\\-: ]*$')"
_DROP = lambda x: f"(case when ends_with({x}, chr(10)) then left({x}, length({x}) - 1) else {x} end)"


def _sql_eol(x: str) -> str:
    return f"replace(replace({x}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"


def _sql_fences(x: str) -> str:
    opened = f"regexp_replace({_STRIP(x)}, '^```[^`\\n]*(\\n|$)', '')"
    return f"regexp_replace({opened}, '(^|\\n)[{_W}]*```$', '')"


def _sql_rstrip(x: str) -> str:
    return f"regexp_replace(regexp_replace({_DROP(x)}, '[{_W}]+(\\n)', '\\1', 'g'), '[{_W}]+$', '')"


def _sql_blanks(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{4,}}', chr(10)||chr(10)||chr(10), 'g')"


def _sql_images(x: str) -> str:
    p = r"!\[[^\]]*\]\([^)]*\)"
    alt = _STRIP(f"regexp_extract(m, '^!\\[([^\\]]*)\\]', 1)")
    url = _STRIP(f"regexp_extract(m, '^!\\[[^\\]]*\\]\\(([^)]*)\\)$', 1)")
    fake = "|".join(h.replace(".", "\\.") for h in T.FAKE_HOSTS)
    each = f"case when regexp_matches({url}, '^https?://') and not regexp_matches({url}, '{fake}') then m when {alt} = '' then '' else '*'||{alt}||'*' end"
    done = f"list_transform(regexp_extract_all({x}, '{p}'), lambda m: {each})"
    return f"array_to_string(list_transform(range(1, len(string_split_regex({x}, '{p}')) + 1), lambda i: string_split_regex({x}, '{p}')[i]||coalesce(({done})[i], '')), '')"


def _sql_invisible(x: str) -> str:
    for c in T.INVISIBLE:
        x = f"replace({x}, chr({ord(c)}), '')"
    return x


def _sql_newline(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{0A}}{_W}]+$', '')||chr(10)"


def _headings_sql(source: str, out: str) -> str:
    """CTEs from (doc_id, page_num, markdown) to the same with spaced headings, by lines and windows."""
    return f"""
{out}_l as (select doc_id, page_num, unnest(string_split({_DROP('markdown')}, chr(10))) l, generate_subscripts(string_split({_DROP('markdown')}, chr(10)), 1) i from {source}),
{out}_h as (select *, starts_with(l, '#') and (instr(l, ' ') = 0 or length(l) > strlen(split_part(l, ' ', 1))) h from {out}_l),
{out}_n as (select *, first_value(case when l <> '' then h end ignore nulls) over (partition by doc_id, page_num order by i rows between current row and unbounded following) nh from {out}_h),
{out} as (select doc_id, page_num, string_agg((case when i = 1 then '' when h then chr(10)||chr(10) else chr(10) end)||l, '' order by i) markdown
  from (select * from {out}_n where not (l = '' and coalesce(nh, false)) or (i = 1 and not coalesce(nh, false) and l = '')) group by all)"""


def _tables_sql(source: str, out: str) -> str:
    pipes = "length(l) - length(replace(l, '|', ''))"
    return f"""
{out}_l as (select doc_id, page_num, unnest(string_split({_DROP('markdown')}, chr(10))) l, generate_subscripts(string_split({_DROP('markdown')}, chr(10)), 1) i from {source}),
{out}_f as (select *, {_ROW('l')} t, {_MARK('l')} s from {out}_l),
{out}_x as (select *, lead(t) over w nt, lead(s) over w ns, sum(case when t then 0 else 1 end) over w island from {out}_f window w as (partition by doc_id, page_num order by i)),
{out}_g as (select doc_id, page_num, i, 0 j, l, t, s, island from {out}_x union all
  select doc_id, page_num, i, 1 j, '|'||repeat(' --- |', greatest({pipes} - 1, 1)), true, true, island from {out}_x where t and not s and nt and not ns),
{out}_p as (select *, row_number() over (partition by doc_id, page_num, island, t order by i, j) p from {out}_g),
{out} as (select doc_id, page_num, string_agg(l, chr(10) order by i, j) markdown from {out}_p where not (t and s and p <> 2) group by all)"""


_KEYS = "cast(doc_id as bigint) doc_id, cast(page_num as int) page_num"


def _rule(rule, sql: str, name: str) -> None:
    """A query that applies one rule to the raw pages, and its twin."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_pages(spark, sf_dir).select("doc_id", "page_num", rule(F.col("markdown")).alias("markdown"))

    QUERIES[name], ORACLE[name] = run, sql


for _name, _f, _s in (
    ("trim_eol", T.normalise_line_endings, _sql_eol), ("strip_fences", T.strip_fences, _sql_fences), ("rstrip_lines", T.rstrip_lines, _sql_rstrip),
    ("collapse_blanks", T.collapse_blank_lines, _sql_blanks), ("image_rewrite", T.rewrite_images, _sql_images), ("strip_invisible", T.strip_invisible, _sql_invisible), ("final_newline", T.end_with_newline, _sql_newline),
):
    _rule(_f, f"with {RAW} select {_KEYS}, {_s('markdown')} markdown from raw", _name)
_rule(lambda x: T.end_with_newline(T.space_headings(x)), f"with {RAW}, {_headings_sql('raw', 'o')} select {_KEYS}, {_sql_newline('markdown')} markdown from o", "heading_spacing")
_rule(lambda x: T.end_with_newline(T.repair_tables(x)), f"with {RAW}, {_tables_sql('raw', 'o')} select {_KEYS}, {_sql_newline('markdown')} markdown from o", "table_repair")

CLEAN = f"""{RAW},
c1 as (select doc_id, page_num, {_sql_fences(_sql_eol('markdown'))} markdown from raw),
c2 as (select doc_id, page_num, {_sql_rstrip('markdown')} markdown from c1),
c3 as (select doc_id, page_num, {_sql_blanks('markdown')} markdown from c2),
{_headings_sql('c3', 'c4')},
{_tables_sql('c4', 'c5')},
c6 as (select doc_id, page_num, {_sql_images('markdown')} markdown from c5),
c7 as (select doc_id, page_num, {_sql_newline(_sql_invisible('markdown'))} markdown from c6),
cleaned as (select r.doc_id, r.page_count, r.page_num, r.failed, case when r.failed then '' else c7.markdown end markdown, strlen(r.markdown) raw_bytes from raw r join c7 using (doc_id, page_num))"""


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clean_pages(raw_pages(spark, sf_dir))


@_query(f"with {CLEAN} select {_KEYS}, markdown from cleaned")
def clean_markdown(spark, sf_dir):
    return cleaned_pages(spark, sf_dir).select("doc_id", "page_num", "markdown")


# -- sources and predicates -----------------------------------------------------


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@_query("select page_id, starts_with(url, 'http://') or starts_with(url, 'https://') is_url from pages")
def url_scheme(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", S.is_url(F.col("url")).alias("is_url"))


@_query("""with p as (select page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) r from pages),
q as (select page_id, case when instr(r, '/') > 0 then string_split(r, '/')[-1] else '' end f from p) select page_id, case when contains(f, '.') then f else 'downloaded.pdf' end filename from q""")
def url_filename(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", S.filename(F.col("url")).alias("filename"))


@_query("""with p as (select page_id, case page_id % 3 when 0 then '%PDF-1.7'||html when 1 then html else left(html, page_id % 5) end c from pages)
select page_id, strlen(c) < 4 or left(c, 4) = '%PDF' accepted from p""")
def magic_check(spark, sf_dir):
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.concat(F.lit("%PDF-1.7"), "html")).when(k == 1, F.col("html")).otherwise(F.left("html", (F.col("page_id") % 5).cast("int")))
    return _pages(spark, sf_dir).select("page_id", S.is_accepted(content.cast("binary")).alias("accepted"))


@_query("""select page_id, case when contains(url, 'com') and page_id % 2 = 0 then 'WrongPassword' when contains(url, 'com') then 'PasswordRequired' else 'CorruptPdf' end kind from pages""")
def open_errors(spark, sf_dir):
    detail = F.when(F.col("url").contains("com"), "PasswordError").otherwise("FormatError")
    return _pages(spark, sf_dir).select("page_id", open_error_kind(detail, F.col("page_id") % 2 == 0).alias("kind"))


@_query("""select page_id, case when strlen(html) > 80 then left(html, 79)||'…' else html end short from pages""")
def error_truncation(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", short(F.col("html")).alias("short"))


@_query(f"""with u as (select page_id, case page_id % 4 when 0 then url when 1 then ' '||url||' ' when 2 then replace(url, 'example.', 'notfake.') else substr(url, 5) end u from pages)
select page_id, not regexp_matches({_STRIP('u')}, '^https?://') or regexp_matches({_STRIP('u')}, '{"|".join(h.replace(".", chr(92) + ".") for h in T.FAKE_HOSTS)}') placeholder from u""")
def placeholder_urls(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" "), "url", F.lit(" "))).when(k == 2, F.replace("url", F.lit("example."), F.lit("notfake."))).otherwise(F.expr("substr(url, 5)"))
    return _pages(spark, sf_dir).select("page_id", T.is_placeholder_url(url).alias("placeholder"))


@_query(f"with {RAW}, l as (select doc_id, page_num, unnest(string_split(markdown, chr(10))) l from raw) select {_KEYS}, count(*) n_lines, count(*) filter ({_ROW('l')}) n_rows, count(*) filter ({_MARK('l')}) n_separators, count(*) filter (starts_with(l, '#') and (instr(l, ' ') = 0 or length(l) > strlen(split_part(l, ' ', 1)))) n_headings from l group by all")
def table_row_predicates(spark, sf_dir):
    lines = F.split("markdown", "\n", -1)
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return raw_pages(spark, sf_dir).select("doc_id", "page_num", F.size(lines).cast("long").alias("n_lines"), count(T.is_table_row).alias("n_rows"), count(T.is_separator_row).alias("n_separators"), count(T.is_heading).alias("n_headings"))


# -- pages ------------------------------------------------------------------------


@_query(f"with {RAW} select {_KEYS}, cast(page_count as int) page_count, text from paged")
def page_expand(spark, sf_dir):
    pages = P.lines_to_pages(P.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.col("page_count").cast("int").alias("page_count"), "text")


def _select(name: str, selection: PageSelection, where: str) -> None:
    def run(spark, sf_dir):
        raw = raw_pages(spark, sf_dir)
        return raw.filter(P.is_selected(selection, F.col("page_num"), F.col("page_count"))).select("doc_id", "page_num", P.selected_count(selection, F.col("page_count")).cast("long").alias("selected"))

    QUERIES[name] = run
    ORACLE[name] = f"with {RAW}, s as (select * from raw where {where}) select {_KEYS}, count(*) over (partition by doc_id) selected from s"


_select("select_all", PageSelection(), "true")
_select("select_single", PageSelection.single(2), "page_num = 2")
_select("select_range_clip", PageSelection.between(0, 3), "page_num <= 3")
_select("select_set", PageSelection.of(3, 1, 3, 99), "page_num in (1, 3, 99)")


def _counts(spark, sf_dir, selection):
    return page_counts(spark, sf_dir).withColumn("selected_count", P.selected_count(selection, F.col("page_count")))


@_query(f"with {RAW} select doc_id, cast(max(page_count) as bigint) page_count from raw group by doc_id having max(page_count) < 3")
def empty_selection(spark, sf_dir):
    docs = _counts(spark, sf_dir, PageSelection.single(3))
    return docs.filter("selected_count = 0").select("doc_id", F.col("page_count").cast("long").alias("page_count"))


@_query(f"with {RAW} select {_KEYS} from raw where not failed")
def success_filter(spark, sf_dir):
    return raw_pages(spark, sf_dir).filter("error is null").select("doc_id", "page_num")


@_query(f"with {RAW} select {_KEYS}, (select r.markdown from raw r where r.doc_id = a.doc_id and r.page_num < a.page_num and not r.failed order by r.page_num desc limit 1) prior from raw a")
def prior_context(spark, sf_dir):
    return P.prior_context(raw_pages(spark, sf_dir)).select("doc_id", "page_num", "prior")


@_query(f"with {CLEAN} select {_KEYS}, last_value(case when not failed then markdown end ignore nulls) over (partition by doc_id order by page_num rows between unbounded preceding and 1 preceding) prior from cleaned")
def prior_context_clean(spark, sf_dir):
    return P.prior_context(cleaned_pages(spark, sf_dir)).select("doc_id", "page_num", "prior")


@_query(f"with {RAW} select {_KEYS}, page_num = min(page_num) over (partition by doc_id) is_first from raw where not failed")
def first_page_flag(spark, sf_dir):
    return P.first_success(raw_pages(spark, sf_dir)).select("doc_id", "page_num", "is_first")


@_query(f"with {RAW} select {_KEYS} from raw where (doc_id + page_num) % 5 = 0")
def skipped_pages(spark, sf_dir):
    raw = raw_pages(spark, sf_dir)
    return P.skipped(raw.select("doc_id", "page_num"), raw.filter((F.col("doc_id") + F.col("page_num")) % 5 != 0))


# -- assembly -----------------------------------------------------------------------

SEPARATORS = {
    "none": (PageSeparator("none"), "chr(10)||chr(10)"), "rule": (PageSeparator("rule"), "chr(10)||chr(10)||'---'||chr(10)||chr(10)"),
    "comment": (PageSeparator("comment"), "chr(10)||chr(10)||'<!-- page '||page_num||' -->'||chr(10)||chr(10)"), "custom": (PageSeparator("custom", "* * *"), "chr(10)||chr(10)||'* * *'||chr(10)||chr(10)"),
}


def _assembled(sep: str) -> str:
    return f"{CLEAN}, good as (select *, row_number() over (partition by doc_id order by page_num) n from cleaned where not failed), assembled as (select doc_id, string_agg((case when n > 1 then {sep} else '' end)||markdown, '' order by page_num) markdown from good group by doc_id)"


def _assemble(name: str, kind: PageSeparator, sep: str) -> None:
    def run(spark, sf_dir):
        return A.assemble(cleaned_pages(spark, sf_dir), kind)

    QUERIES[name] = run
    ORACLE[name] = f"with {_assembled(sep)} select d.doc_id, coalesce(a.markdown, '') markdown from (select distinct doc_id from raw) d left join assembled a using (doc_id)"


for _k, (_kind, _sep) in SEPARATORS.items():
    _assemble(f"assemble_{_k}", _kind, _sep)


@_query(f"with {RAW} select {_KEYS}, {SEPARATORS['none'][1]} s_none, {SEPARATORS['rule'][1]} s_rule, {SEPARATORS['comment'][1]} s_comment, {SEPARATORS['custom'][1]} s_custom from raw")
def separators(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("doc_id", "page_num", *(S.separator(F.col("page_num"), kind).alias(f"s_{k}") for k, (kind, _) in SEPARATORS.items()))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata made from the labels and counts of documents."""
    docs = page_counts(spark, sf_dir)
    named = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    return docs.join(named, "doc_id").select("doc_id", F.when(k % 2 == 0, F.concat(F.lit("Doc "), k.cast("string"))).alias("title"), F.when(k % 3 == 0, F.col("source")).alias("author"), none.alias("subject"), F.col("lang").alias("creator"), F.when(k % 5 == 0, "maker").alias("producer"), "page_count", F.when(k % 7 == 0, "").otherwise("Pdf1_4").alias("pdf_version"))


@_query(f"""with {RAW}, m as (select doc_id, max(page_count) n from raw group by doc_id)
select m.doc_id, '---'||chr(10)||case when m.doc_id % 2 = 0 then 'title: "Doc '||m.doc_id||'"'||chr(10) else '' end||case when m.doc_id % 3 = 0 then coalesce('author: "'||source||'"'||chr(10), '') else '' end
||coalesce('creator: "'||lang||'"'||chr(10), '')||case when m.doc_id % 5 = 0 then 'producer: "maker"'||chr(10) else '' end||'pages: '||n||chr(10)||case when m.doc_id % 7 <> 0 then 'pdf_version: "Pdf1_4"'||chr(10) else '' end||'---'||chr(10)||chr(10) yaml
from m join documents d using (doc_id)""")
def front_matter(spark, sf_dir):
    meta = metadata(spark, sf_dir)
    return meta.select("doc_id", S.front_matter({c: F.col(c) for c in meta.columns}).alias("yaml"))


def _stats(returned: str) -> str:
    """Statistics over the pages that came back; the others were selected and skipped."""
    return f"""{CLEAN}, st as (select doc_id, cast(max(page_count) as bigint) total_pages, count(*) filter (not failed and {returned}) processed_pages, count(*) filter (failed and {returned}) failed_pages, count(*) filter (not ({returned})) skipped_pages,
cast(coalesce(sum(case when failed then 0 else 1000 end) filter ({returned}), 0) as bigint) total_input_tokens, cast(coalesce(sum(cast(ceil(raw_bytes / 4.0) as bigint)) filter ({returned}), 0) as bigint) total_output_tokens,
cast(coalesce(sum(3 * page_num) filter ({returned}), 0) as bigint) render_duration_ms, cast(coalesce(max(110 * page_num + 7) filter ({returned}) - min(100 * page_num) filter ({returned}), 0) as bigint) llm_duration_ms,
min(page_num) filter (failed and {returned}) bad, count(*) filter ({returned}) n from cleaned group by doc_id),
er as (select *, 'Page '||bad||': LLM call failed after 3 retries: mock failure' first_error from st)"""


_STATS = _stats("true")
_DOC_ERROR = "case when processed_pages = 0 then 'All '||n||' pages failed after 3 retries each.'||chr(10)||'First error: '||first_error end"


def _converted(spark, sf_dir, selection=PageSelection(), strict=False, returned=None, keep_pages=False):
    pages = cleaned_pages(spark, sf_dir) if returned is None else cleaned_pages(spark, sf_dir).filter(returned)
    chosen = pages.filter(P.is_selected(selection, F.col("page_num"), F.col("page_count")))
    return A.convert_documents(chosen, _counts(spark, sf_dir, selection), PageSeparator("comment"), strict=strict, keep_pages=keep_pages)


@_query(f"""with {_assembled(SEPARATORS['comment'][1]).replace(CLEAN, _STATS)} select doc_id, markdown, total_pages, processed_pages, failed_pages, skipped_pages, total_input_tokens, total_output_tokens, llm_duration_ms total_duration_ms, render_duration_ms, llm_duration_ms, first_error, {_DOC_ERROR} doc_error from er left join assembled using (doc_id)""")
def convert_documents(spark, sf_dir):
    return _converted(spark, sf_dir)


@_query(f"with {_stats('(doc_id + page_num) % 5 <> 0')} select doc_id, total_pages, processed_pages, failed_pages, skipped_pages, total_input_tokens, total_output_tokens, llm_duration_ms total_duration_ms, render_duration_ms, llm_duration_ms from er")
def conversion_stats(spark, sf_dir):
    """Statistics where every fifth page was skipped."""
    return _converted(spark, sf_dir, returned="(doc_id + page_num) % 5 <> 0").drop("markdown", "first_error", "doc_error")


@_query(f"with {_STATS} select doc_id, first_error from er where failed_pages > 0")
def first_error(spark, sf_dir):
    return _converted(spark, sf_dir).filter("failed_pages > 0").select("doc_id", "first_error")


@_query(f"with {_STATS} select doc_id, {_DOC_ERROR} doc_error from er where processed_pages = 0")
def all_failed(spark, sf_dir):
    return _converted(spark, sf_dir).filter("processed_pages = 0").select("doc_id", "doc_error")


@_query(f"with {_STATS} select doc_id, failed_pages||'/'||total_pages||' pages failed during conversion' doc_error from er where failed_pages > 0 and processed_pages > 0")
def partial_failure(spark, sf_dir):
    return _converted(spark, sf_dir, strict=True).filter("doc_error is not null and processed_pages > 0").select("doc_id", "doc_error")


@_query(f"with {CLEAN} select {_KEYS}, markdown, cast(case when failed then 0 else 1000 end as bigint) input_tokens, cast(ceil(raw_bytes / 4.0) as bigint) output_tokens, cast(page_num * 10 as bigint) duration_ms, case when failed then 3 else 0 end retries, case when failed then 'LlmFailed' end error_kind from cleaned")
def page_results_flat(spark, sf_dir):
    return cleaned_pages(spark, sf_dir).select("doc_id", "page_num", "markdown", "input_tokens", "output_tokens", "duration_ms", "retries", F.col("error.kind").alias("error_kind"))


#: Values of all message formats, from columns of events; and each message as SQL, spelt out.
_VALUES = {
    "path": "event_type", "url": "event_type", "reason": "event_type", "detail": "event_type", "magic": "'[1, 2]'", "hint": "event_type", "provider": "event_type", "first_error": "event_type",
    "secs": "user_id", "page": "event_id % 9", "total": "user_id", "retries": "3", "failed": "event_id % 9",
}
_TEXTS = (
    ("FileNotFound", "'PDF file not found: '''||t||''''||chr(10)||'Check the path exists and is readable.'"), ("PermissionDenied", "'Permission denied reading '''||t||''''||chr(10)||'Try: chmod +r \"'||t||'\"'"),
    ("DownloadFailed", "'Failed to download '''||t||''': '||t||chr(10)||'Check your internet connection.'"), ("DownloadTimeout", "'Download timed out after '||u||'s for '''||t||''''||chr(10)||'Increase --download-timeout.'"),
    ("NotAPdf", "'File is not a valid PDF: '''||t||''''||chr(10)||'First bytes: [1, 2]'"), ("CorruptPdf", "'PDF '''||t||''' is corrupt: '||t||chr(10)||'Try repairing with: qpdf --decrypt input.pdf output.pdf'"),
    ("PasswordRequired", "'PDF '''||t||''' is encrypted and requires a password.'||chr(10)||'Provide it with --password <PASSWORD>.'"), ("WrongPassword", "'Wrong password for PDF '''||t||''''"),
    ("PageOutOfRange", "'Page '||p||' is out of range (document has '||u||' pages)'"), ("RasterisationFailed", "'Rasterisation failed for page '||p||': '||t"),
    ("ProviderNotConfigured", "'LLM provider '''||t||''' is not configured.'||chr(10)||t"), ("AllPagesFailed", "'All '||u||' pages failed after 3 retries each.'||chr(10)||'First error: '||t"),
    ("PartialFailure", "p||'/'||u||' pages failed during conversion'"), ("OutputWriteFailed", "'Failed to write output file '''||t||''': '||t"), ("InvalidConfig", "'Invalid configuration: '||t"), ("Internal", "'Internal error: '||t"),
    ("RenderFailed", "'Page '||p||': rasterisation failed: '||t"), ("LlmFailed", "'Page '||p||': LLM call failed after 3 retries: '||t"), ("Timeout", "'Page '||p||': LLM call timed out after '||u||'s'"),
)


@_query(f"select event_id, case event_id % {len(_TEXTS)} {' '.join(f'when {k} then {x}' for k, (_, x) in enumerate(_TEXTS))} end msg from (select event_id, event_type t, user_id u, event_id % 9 p from events)")
def error_messages(spark, sf_dir):
    """Messages of all kinds, in turn; those of pages from their error struct."""
    at = F.col("event_id") % len(_TEXTS)
    error = F.struct(F.element_at(F.array(*(F.lit(k) for k, _ in _TEXTS)), (at + 1).cast("int")).alias("kind"), (F.col("event_id") % 9).cast("int").alias("page"), F.lit(3).alias("retries"), F.col("user_id").cast("bigint").alias("secs"), F.col("event_type").alias("detail"))
    values = {k: F.expr(v) for k, v in _VALUES.items()}
    text = page_error_message(F.col("error"))
    for k, (kind, _) in enumerate(_TEXTS[:-3]):
        text = F.when(at == k, message(kind, **values)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("error", error).select("event_id", text.alias("msg"))


@_query("""with s as (select page_id, case page_id % 12 when 0 then null when 1 then ' ALL ' when 2 then '3' when 3 then '2-4' when 4 then ' 1, 3,5' when 5 then '7-3' when 6 then 'x' when 7 then '0' when 8 then '1,2-4' when 9 then '3 - 99' when 10 then '2,,3' else '9,2,2' end spec, cast(page_id % 6 as int) n from pages)
select page_id, case page_id % 12 when 5 then 'invalid page range ''7-3''' when 6 then 'invalid page number ''x''' when 7 then 'invalid page number ''0''' when 8 then 'invalid page range ''1,2-4''' when 10 then 'invalid page number ''2,,3''' end error,
coalesce(array_to_string(list_filter(range(1, n + 1), lambda p: case page_id % 12 when 0 then true when 1 then true when 2 then p = 3 when 3 then p between 2 and 4 when 4 then p in (1, 3, 5) when 9 then p >= 3 when 11 then p in (2, 9) else false end), ','), '') pages from s""")
def page_specs(spark, sf_dir):
    """Page options in a column, as each document may have its own."""
    k = F.col("page_id") % 12
    specs = [None, " ALL ", "3", "2-4", " 1, 3,5", "7-3", "x", "0", "1,2-4", "3 - 99", "2,,3", "9,2,2"]
    spec = F.element_at(F.array(*(F.lit(x).cast("string") for x in specs)), (k + 1).cast("int"))
    found = _pages(spark, sf_dir).select("page_id", P.spec_pages(spec, (F.col("page_id") % 6).cast("int")).alias("s"))
    return found.select("page_id", F.col("s.error").alias("error"), F.array_join("s.pages", ",").alias("pages"))


@_query("select cast(a as int) attempt, cast(case when a >= 1 then 500 * (1 << (a - 1)) else 0 end as bigint) delay_ms from range(0, 11) t(a)")
def backoff_schedule(spark, sf_dir):
    return spark.range(11).select(F.col("id").cast("int").alias("attempt"), S.backoff_ms(F.col("id"), 500).cast("long").alias("delay_ms"))


@_query("""with p(provider) as (values ('mistral'), ('mistral-ai'), ('mistralai'), ('ollama'), ('lmstudio'), ('lm-studio'), ('lm_studio'), ('openai'), ('gemini'), (''))
select provider, case when starts_with(provider, 'mistral') then 'pixtral-12b-2409' when provider = 'ollama' or starts_with(provider, 'lm') then 'llava' else 'gpt-4.1-nano' end model from p""")
def default_model(spark, sf_dir):
    names = ["mistral", "mistral-ai", "mistralai", "ollama", "lmstudio", "lm-studio", "lm_studio", "openai", "gemini", ""]
    return spark.createDataFrame([(n,) for n in names], "provider string").select("provider", S.default_model(F.col("provider")).alias("model"))


_CONVERSED = """with c as (select conv_id, turn, last_value(case when role <> 'system' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) prior from conversations)"""


def _conversed(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.col("text").alias("markdown"), F.when(F.col("role") == "system", F.lit("x")).alias("error"))
    found = P.prior_context(pages)
    return found.select(F.col("doc_id").alias("conv_id"), F.col("page_num").alias("turn"), S.messages(F.lit("aGk="), F.col("prior"), maintain_format=True).alias("messages"))


@_query(_CONVERSED + " select conv_id, turn, cast(case when coalesce(prior, '') = '' then 2 else 3 end as bigint) n_messages from c")
def message_count(spark, sf_dir):
    return _conversed(spark, sf_dir).select("conv_id", "turn", F.size("messages").cast("long").alias("n_messages"))


@_query(_CONVERSED + f""" select conv_id, turn, 'system: '||{_text(S.SYSTEM_PROMPT)}||case when coalesce(prior, '') = '' then '' else chr(10)||'system: '||{_text(S.CONTINUITY)}||'\"\"\"'||prior||'\"\"\"' end||chr(10)||'user: image/png high aGk=' texts from c""")
def message_texts(spark, sf_dir):
    """Every message of a page's request, spelt out."""
    line = lambda m: F.concat(m.role, F.lit(": "), m.content, F.array_join(F.transform(m.images, lambda i: F.concat_ws(" ", i.mime_type, i.detail, i.data)), " "))
    return _conversed(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform("messages", line), "\n").alias("texts"))


@_query(f"""with {_STATS}, p(k, provider, model, pin, pout) as (values {', '.join(f"({k}, '{p}', '{m}', {i}, {o})" for k, (p, m, i, o) in enumerate(S.PRICES))}),
u as (select p.provider, p.model, pin, pout, cast(sum(total_input_tokens) as bigint) i, cast(sum(total_output_tokens) as bigint) o from er join p on er.doc_id % {len(S.PRICES)} = p.k group by all)
select provider, model, i total_input_tokens, o total_output_tokens, cast(round(i * pin + o * pout) as bigint) cost_micros from u""")
def cost_estimate(spark, sf_dir):
    stats = _converted(spark, sf_dir)
    names = F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m, _, _ in S.PRICES))
    usage = stats.select(F.get(names, (F.col("doc_id") % len(S.PRICES)).cast("int")).alias("n"), "total_input_tokens", "total_output_tokens").select("n.*", "total_input_tokens", "total_output_tokens")
    usage = usage.groupBy("provider", "model").agg(F.sum("total_input_tokens").alias("total_input_tokens"), F.sum("total_output_tokens").alias("total_output_tokens"))
    return A.cost_micros(usage).select("provider", "model", "total_input_tokens", "total_output_tokens", "cost_micros")


@_query(f"""with {CLEAN} select {_KEYS}, {_STRIP('markdown')} <> '' not_blank, ends_with(markdown, chr(10)) ends_with_newline, not starts_with(markdown, '```') no_leading_fence, not contains(markdown, repeat(chr(10), 4)) no_long_gap,
markdown = replace(replace(replace(replace(replace(markdown, chr(8203), ''), chr(65279), ''), chr(8204), ''), chr(8205), ''), chr(8288), '') no_invisible, strlen(markdown) >= 50 long_enough,
len(list_filter(string_split(markdown, chr(10)), lambda l: starts_with(l, '#'))) > 0 has_headings, cast(len(string_split(markdown, '---')) - 1 as bigint) n_rules from cleaned""")
def markdown_quality(spark, sf_dir):
    md = F.col("markdown")
    return cleaned_pages(spark, sf_dir).select("doc_id", "page_num", *(v.alias(k) for k, v in T.quality_checks(md).items()), T.has_headings(md).alias("has_headings"), T.rule_count(md).cast("long").alias("n_rules"))


#: The twin's edit distance counts bytes, so characters that are not ASCII get one byte each, the same in both texts.
_PAIRED = """with b as (select item_id, text, lead(text) over (order by item_id) other from benchmark),
c as (select distinct unnest(regexp_extract_all(text, '[^ -~]')) c from benchmark),
m as (select coalesce(string_agg(c, '' order by c), '') f, array_to_string(list_transform(range(1, count(*) + 1), lambda i: chr(cast(i as int))), '') g from c)"""


def _paired(spark, sf_dir):
    """Each benchmark text and the next; the table is small, so one task may order it."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select("item_id", "text", F.lead("text").over(Window.orderBy("item_id")).alias("other")).filter("other is not null")


@_query(_PAIRED + " select item_id, levenshtein(translate(text, f, g), translate(other, f, g)) / cast(length(other) as double) cer from b, m where other is not null")
def character_error_rate(spark, sf_dir):
    return _paired(spark, sf_dir).select("item_id", T.character_error_rate(F.col("text"), F.col("other")).alias("cer"))


_GRAMS = lambda side: f"select item_id, {side == 'text'} mine, n, array_to_string(w[i:i + n - 1], ' ') gram from (select item_id, string_split_regex(trim(regexp_replace({side}, '[ \t-\r]+', ' ', 'g')), ' ') w from b where other is not null), range(1, 5) r(n), range(1, len(w) - n + 2) s(i)"


@_query(f"""{_PAIRED}, g as ({_GRAMS('text')} union all {_GRAMS('other')}), k as (select item_id, n, gram, count(*) filter (mine) x, count(*) filter (not mine) y from g group by all),
p as (select item_id, n, cast(sum(least(x, y)) as double) hit, cast(sum(x) as double) total, cast(sum(y) as double) wanted from k group by all)
select item_id, round(case when count(*) filter (hit > 0) = 4 then exp(least(0, 1 - max(wanted) filter (n = 1) / max(total) filter (n = 1))) * exp(avg(ln(hit / total)) filter (hit > 0)) else 0 end, 9) bleu from p group by item_id""")
def bleu(spark, sf_dir):
    return Q.bleu(_paired(spark, sf_dir).select("item_id", F.col("text").alias("got"), F.col("other").alias("want")), "item_id").select("item_id", F.round("bleu", 9).alias("bleu"))


@_query()
def rouge_l(spark, sf_dir):
    """Longest common subsequences have no SQL; tested by brute force."""
    return Q.rouge_l(_paired(spark, sf_dir).select("item_id", F.col("text").alias("got"), F.col("other").alias("want")), "item_id")


@_query(f"with {CLEAN}, l as (select doc_id, page_num, unnest(string_split(markdown, chr(10))) l from cleaned) select {_KEYS}, count(*) filter (regexp_matches(l, '^#+ ')) n_headings, count(*) filter (length(l) > 1 and starts_with(l, '|') and ends_with(l, '|')) n_table_rows, count(*) filter (regexp_matches(l, '^([-*+]|[0-9]+\\.) ')) n_list_items from l group by all")
def structure_counts(spark, sf_dir):
    return cleaned_pages(spark, sf_dir).select("doc_id", "page_num", *(v.cast("long").alias(k) for k, v in T.structure_counts(F.col("markdown")).items()))


@_query(f"""with {_assembled(SEPARATORS['comment'][1]).replace(CLEAN, _STATS)},
pg as (select doc_id, list({{'page_num': cast(page_num as int), 'markdown': markdown, 'input_tokens': case when failed then 0 else 1000 end, 'output_tokens': cast(ceil(raw_bytes / 4.0) as bigint), 'duration_ms': page_num * 10, 'retries': case when failed then 3 else 0 end,
  'error': case when failed then {{'kind': 'LlmFailed', 'page': cast(page_num as int), 'retries': 3, 'secs': null, 'detail': 'mock failure'}} end}} order by page_num) pages from cleaned group by doc_id)
select doc_id, cast(to_json({{'markdown': markdown, 'pages': pages, 'stats': {{'total_pages': total_pages, 'processed_pages': processed_pages, 'failed_pages': failed_pages, 'skipped_pages': skipped_pages, 'total_input_tokens': total_input_tokens, 'total_output_tokens': total_output_tokens,
  'total_duration_ms': llm_duration_ms, 'render_duration_ms': render_duration_ms, 'llm_duration_ms': llm_duration_ms}}}}) as varchar) json from er join pg using (doc_id) left join assembled using (doc_id)""")
def conversion_json(spark, sf_dir):
    return A.conversion_output(None, _converted(spark, sf_dir, keep_pages=True))


# -- the conversion job, from bytes to documents -------------------------------------

#: Pages as the documents' text has them, without planted defects; form feeds would be page breaks of their own.
_PLAIN = """split_lines as (select doc_id, string_split(replace(text, chr(12), ' '), chr(10)) l from documents where text is not null),
cut as (select doc_id, cast(ceil(len(l) / 10.0) as int) page_count, unnest(range(1, cast(ceil(len(l) / 10.0) as int) + 1)) page_num, l from split_lines),
raw as (select doc_id, page_count, page_num, array_to_string(l[(page_num - 1) * 10 + 1:page_num * 10], chr(10)) markdown, false failed from cut)"""
_PLAIN_CLEAN = CLEAN.replace(RAW, _PLAIN)
_UNLUCKY = 0.25
_RETRIES = ConversionConfig(max_retries=1, retry_backoff_ms=0)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes for the stand-in page source: ten lines a page."""
    docs = P.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("text is not null")
    joined = F.array_join(P.page_texts(F.replace("text", F.lit("\f"), F.lit(" "))), "\f")
    return docs.select("doc_id", F.concat(F.lit("%PDF-1.4\n"), joined).cast("binary").alias("content"))


def _images(spark: SparkSession, sf_dir: str, config: ConversionConfig = ConversionConfig()) -> DataFrame:
    return render_pages(_files(spark, sf_dir), TextPages(), config)


@_query(f"with {_PLAIN} select doc_id, cast(max(page_count) as int) page_count, 'Pdf1_4' pdf_version, false is_encrypted, cast(null as varchar) title from raw group by doc_id")
def document_metadata(spark, sf_dir):
    return inspect(_files(spark, sf_dir), TextPages()).select("doc_id", "page_count", "pdf_version", "is_encrypted", "title")


@_query(f"with {_PLAIN} select doc_id, cast(page_num - 1 as int) page_index, md5(base64(encode(markdown))) image_md5, 'image/png' mime_type, 'high' detail from raw")
def page_images(spark, sf_dir):
    return _images(spark, sf_dir).select("doc_id", "page_index", F.md5("image_b64").alias("image_md5"), "mime_type", "detail")


@_query(f"""with {_PLAIN}, r as (select *, ('0x'||left(md5(markdown), 2))::int < {256 * _UNLUCKY} bad from raw)
select {_KEYS}, case when bad then '' else markdown end markdown, cast(case when bad then 0 else 1000 end as bigint) input_tokens, cast(case when bad then 0 else ceil(strlen(markdown) / 4.0) end as bigint) output_tokens,
case when bad then 1 else 0 end retries, case when bad then 'Page '||page_num||': LLM call failed after 1 retries: mock failure' end error from r""")
def infer_pages(spark, sf_dir):
    """Rendered pages through a provider of which a quarter of the pages fail, however often they are tried."""
    found = infer(_images(spark, sf_dir), MockProvider(share=_UNLUCKY), _RETRIES)
    return found.select("doc_id", "page_num", "markdown", "input_tokens", "output_tokens", "retries", page_error_message(F.col("error")).alias("error"))


@_query(f"""with {_PLAIN}, r as (select *, ('0x'||left(md5(markdown), 2))::int < {256 * _UNLUCKY} bad from raw),
p as (select *, coalesce(last_value(case when not bad then markdown end ignore nulls) over (partition by doc_id order by page_num rows between unbounded preceding and 1 preceding), '') prior from r)
select {_KEYS}, cast(case when bad then 0 else 1000 + case when prior = '' then 0 else (strlen({_text(S.CONTINUITY)}) + 6 + strlen(prior)) // 4 end end as bigint) input_tokens from p""")
def sequential_pages(spark, sf_dir):
    """Each page is told the last good one before it: the mock counts that text as input."""
    provider, config = MockProvider(share=_UNLUCKY), ConversionConfig(max_retries=1, retry_backoff_ms=0, maintain_format=True)
    step = lambda page, prior: infer_page(provider, page, prior, config)
    return P.in_sequence(_images(spark, sf_dir).withColumn("page_num", F.col("page_index") + 1), step, RAW_PAGE).select("doc_id", "page_num", "input_tokens")


@_query(f"""with {_assembled(SEPARATORS['rule'][1]).replace(CLEAN, _PLAIN_CLEAN)}, n as (select doc_id, count(*) n, cast(sum(ceil(raw_bytes / 4.0)) as bigint) o from cleaned where page_num <= 3 group by doc_id),
three as (select doc_id, string_agg((case when page_num > 1 then {SEPARATORS['rule'][1]} else '' end)||markdown, '' order by page_num) markdown from cleaned where page_num <= 3 group by doc_id)
select doc_id, markdown, n processed_pages, cast(0 as bigint) failed_pages, 1000 * n total_input_tokens, o total_output_tokens, cast(null as varchar) doc_error from n join three using (doc_id)""")
def conversion_job(spark, sf_dir):
    """The whole job over bytes: inspect, select, render, infer, clean, assemble."""
    config = ConversionConfig(pages=PageSelection.between(1, 3), page_separator=PageSeparator("rule"))
    documents, _ = convert(_files(spark, sf_dir), TextPages(), MockProvider(), config)
    return documents.select("doc_id", "markdown", "processed_pages", "failed_pages", "total_input_tokens", "total_output_tokens", "doc_error")
