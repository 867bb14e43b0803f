"""Queries opN_<name>: each applies one operator to its whole table; others show the parts of operators that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .fingerprints import fingerprints
from .mixing import mix
from .near_duplicates import near_duplicates
from .packing import pack
from .pseudonyms import pseudonyms
from .quality_rules import policy_ablations, quality_rules
from .secrets import secret_scan
from .substrings import repeated_passages
from .token_counts import token_counts
from .url_filters import RULES, parts, rule_of, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its id: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter(pages, pages.join(labels, "page_id").select("url", "bad"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


#: The queries' key; a real job passes its own secret.
KEY = b"key of the test queries"


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"), KEY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the ledger of op9."""
    return policy_ablations(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 decides without its trees: host, path and the longest rule."""
    host, path = parts(F.col("url"))
    found = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return found.withColumn("rule", rule_of(F.col("host"), F.col("path"), RULES)[0])


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the base spans of op2."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of op10."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filters, op2_secret_scans, op3_pseudonyms, op4_token_counts, op5_mix_sources, op6_repeated_passages, op7_near_duplicates, op8_packing, op9_quality_rules, op10_fingerprints, quality_ablations, url_rules, secret_counts, edited_texts)}


_LEDGER = r"""with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from d),
p as (select doc_id, ws, unnest(range(1, len(ws) - 3)) i from w),
g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i + 4], ' ')) c from p),
v as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 5)) j from g where c > 1) group by doc_id),
m as (select w.doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(coalesce(v.n, 0) as bigint) n_repeat_words, cast(len(ls) as bigint) n_lines,
  cast(len(list_filter(ls, lambda l: regexp_matches(l, '[.!?:;]["'')\]]*[\x20\x09-\x0D]*\z'))) as bigint) n_ended_lines, cast(coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) as bigint) longest_line,
  cast(length(array_to_string(ls, '')) as bigint) line_chars, cast(len(regexp_extract_all(t, '\p{L}')) as bigint) n_letters from w left join v using (doc_id)),
f as (select *, n_words < 10 f0, 100 * n_repeat_words > 20 * n_words f1, 10 * n_symbols > n_words f2, 2 * n_dup_lines > n_lines f3, word_chars > 12 * n_words or word_chars < 2 * n_words f4,
  10 * n_letters < 6 * word_chars f5, n_lines >= 5 and 10 * n_ended_lines < n_lines f6, n_lines >= 5 and longest_line * n_lines > 20 * line_chars f7 from m)
"""

_QUALITY = _LEDGER + """select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 or f1 base_failed, not (f0 or f1 or f2 or f3 or f4) kept, n_lines, n_ended_lines, longest_line, line_chars, n_letters,
  cast(f0::int + 2 * f1::int + 4 * f2::int + 8 * f3::int + 16 * f4::int + 32 * f5::int + 64 * f6::int + 128 * f7::int as bigint) failure_bits,
  not (f0 or f1) kept_v1, not (f0 or f1 or f2 or f3 or f4) kept_v2, not (f0 or f1 or f2 or f3 or f4 or f5 or f6 or f7) kept_v3 from f"""

_RULE_NAMES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "few_letters", "open_lines", "line_spread")


def _ablation_sql() -> str:
    """One select for each policy and rule, spelt over the flags f0, f1 and so on."""
    selects = []
    for policy, last in (("v1", 2), ("v2", 5), ("v3", 8)):
        for k in range(last):
            rest = " or ".join(f"f{i}" for i in range(last) if i != k)
            selects.append(f"select '{policy}' as policy, '{_RULE_NAMES[k]}' as rule, count(*) filter (f{k}) fails, count(*) filter (f{k} and not ({rest})) fails_alone, count(*) filter ({rest}) rejected_without from f having count(*) > 0")
    return _LEDGER + " union all ".join(selects)


_MIX = r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size, md5('mix:' || coalesce(cast(doc_id as varchar), '')) k from documents),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 rank from s),
c as (select *, ([5, 2, 1])[rank % 3 + 1] w, 2 * source_size cap from r),
o as (select *, cast(cap as double) / w ratio, sum(cap) over q - cap before, sum(w) over () - (sum(w) over q - w) left_w, sum(source_size) over () total from c window q as (order by cast(cap as double) / w, rank rows unbounded preceding)),
l as (select min_by((cast(1.5 as double) * cast(total as double) - cast(before as double)) / cast(left_w as double), ratio) level from o where (cast(1.5 as double) * cast(total as double) - cast(before as double)) / cast(left_w as double) <= ratio),
t as (select source, source_size, least(cast(cap as double), level * w) target from c, l),
a as (select doc_id, size, source_size, target, floor(target) budget, case when source_size > 0 then floor(floor(target) / source_size) else 0 end epochs,
  sum(size) over (partition by d.source order by k, doc_id, size rows unbounded preceding) - size before from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) as bigint) taken from a"""


_URLS = r"""with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end r from pages),
h as (select page_id, regexp_extract(r, '^[^/?#]*') raw, r from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') path from h),
k as (select p.*, rule from p left join (values ('net/'), ('example.net/en/'), ('example.com/de/'), ('org/fr/')) t(rule) on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, instr(rule, '/'))))
select page_id, host, path, arg_max(rule, length(rule)) rule from k group by page_id, host, path"""

_SECRETS = r"""with d as (select doc_id, coalesce(text, '') t from documents)
select doc_id, cast(len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as bigint) n_assign,
  cast(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as bigint) n_access, cast(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) as bigint) n_hex from d"""

_EDITED = """with d as (select doc_id, coalesce(text, '') t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) following from d)
select doc_id, length(t) n_chars, sha256(left(t, length(t) - length(t) // 4) || left(following, length(t) // 4)) edited_sha256 from n"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; models, tokens and similarity are tested by brute force."""
    return {"op5_mix_sources": _MIX, "op9_quality_rules": _QUALITY, "quality_ablations": _ablation_sql(), "url_rules": _URLS, "secret_counts": _SECRETS, "edited_texts": _EDITED}
