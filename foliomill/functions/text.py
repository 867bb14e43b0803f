"""The ten cleanup rules for page Markdown, as native expressions.

``clean_markdown`` applies them in order. Blank characters are Unicode white
space, so classes are spelled out: Java's ``\\s`` is ASCII only. Every rule is
linear in the text. Patterns cost far more than the engine's byte-wise functions,
so ends are trimmed by those, and a pattern runs only over texts that hold what it
is after.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, the same without line feed, invisible characters, image hosts that are never real.
_H = r"\x{09}\x{0B}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = rf"[\x{{0A}}{_H}]"
SPACE = rf"[{_H}]"
#: The same characters spelt out, for the trimming functions.
SPACES = "".join(chr(c) for c in (0x9, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
BLANKS = "\n" + SPACES
INVISIBLE = "​﻿­‌‍⁠"
FAKE_HOSTS = ("example.com", "placeholder.com", "dummyimage.com", "lorempixel.com", "picsum.photos", "placehold.it")
IMAGE = r"!\[[^\]]*\]\([^)]*\)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def only_if(test: Column, x: Column, pattern: str, new: str) -> Column:
    """A replacement in texts that pass a cheap test; others can't hold the pattern."""
    return F.when(test, F.regexp_replace(x, pattern, new)).otherwise(x)


def drop_line_feed(x: Column) -> Column:
    """Without the line feed at the end, if there is one."""
    return F.when(x.endswith("\n"), F.left(x, F.length(x) - 1)).otherwise(x)


def normalise_line_endings(x: Column) -> Column:
    return only_if(x.contains("\r"), x, r"\r\n?", "\n")


def open_fence(x: Column) -> Column:
    return only_if(x.startswith("```"), x, r"\A```[^`\n]*(?:\n|\z)", "")


def close_fence(x: Column) -> Column:
    return only_if(x.endswith("```"), x, rf"(?:\A|\n){SPACE}*```\z", "")


def strip_fences(x: Column) -> Column:
    """Drop a fence that opens the text and, independently, one that closes it."""
    return close_fence(open_fence(strip(x)))


def rstrip_inner_lines(x: Column) -> Column:
    """All lines but the last; a run of blanks is looked at from its first only."""
    return only_if(x.rlike(rf"\n(?<={SPACE}\n)"), x, rf"(?<!{SPACE}){SPACE}++(?=\n)", "")


def rstrip_last_line(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def rstrip_lines(x: Column) -> Column:
    return rstrip_last_line(rstrip_inner_lines(drop_line_feed(x)))


def collapse_blank_lines(x: Column) -> Column:
    return only_if(x.contains("\n\n\n\n"), x, r"\n{4,}", "\n\n\n")


def is_heading(line: Column) -> Column:
    """A line that starts with #; with multi-byte signs before the first space only if it is longer than their bytes."""
    return line.startswith("#") & ((F.instr(line, " ") == 0) | (F.length(line) > F.octet_length(F.substring_index(line, " ", 1))))


def space_headings(x: Column) -> Column:
    """Exactly one blank line before every heading but one on the first line."""

    def respaced(parts: Column) -> Column:
        def piece(line: Column, i: Column) -> Column:
            return F.when(i == 0, line).otherwise(F.concat(F.when(is_heading(line), "\n\n").otherwise(F.get(parts.gaps, i - 1)), line))

        return F.array_join(F.transform(parts.lines, piece), "")

    once = drop_line_feed(x)
    done = let(F.struct(F.split(once, r"\n+", -1).alias("lines"), F.regexp_extract_all(once, F.lit(r"(\n+)"), F.lit(1)).alias("gaps")), respaced)
    return F.when(F.instr(x, "\n#") > 0, done).otherwise(once)


def is_table_row(line: Column) -> Column:
    t = strip(line)
    return t.startswith("|") & t.endswith("|") & (F.octet_length(t) > 2)


def is_separator_row(line: Column) -> Column:
    return strip(line).rlike(r"\A\|[|\-: ]*\z")


def repair_tables(x: Column) -> Column:
    """In every run of table rows: a separator at the second place and nowhere else.

    Line i depends on lines i-2 to i+1 only: a separator stays if it is second of
    its run; a first row that is no separator and is followed by one that is
    none either gets a separator of its own width.
    """

    def stencil(v: Column) -> Column:
        row = lambda i: F.coalesce(F.get(v.rows, i), F.lit(False))
        mark = lambda i: F.coalesce(F.get(v.marks, i), F.lit(False))

        def each(line: Column, i: Column) -> Column:
            first = row(i) & ~row(i - 1)
            second = row(i) & row(i - 1) & ~row(i - 2)
            made = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.greatest(F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) - 1, F.lit(1))))
            own = F.when(row(i) & mark(i) & ~second, F.array().cast("array<string>")).otherwise(F.array(line))
            added = F.when(first & ~mark(i) & row(i + 1) & ~mark(i + 1), F.array(made)).otherwise(F.array().cast("array<string>"))
            return F.concat(own, added)

        return F.array_join(F.flatten(F.transform(v.lines, each)), "\n")

    flags = lambda lines: F.struct(lines.alias("lines"), F.transform(lines, is_table_row).alias("rows"), F.transform(lines, is_separator_row).alias("marks"))
    once = drop_line_feed(x)
    done = let(F.split(once, "\n", -1), lambda lines: let(flags(lines), stencil))
    return F.when(F.instr(x, "|") > 0, done).otherwise(once)


def is_placeholder_url(url: Column) -> Column:
    t = strip(url)
    hosts = "|".join(h.replace(".", r"\.") for h in FAKE_HOSTS)
    return ~t.rlike("^https?://") | t.rlike(hosts)


def rewrite_images(x: Column) -> Column:
    """Images without a real url become their emphasised text, or nothing."""

    def rewritten(found: Column) -> Column:
        alt = strip(F.regexp_extract(found, r"\A!\[([^\]]*)\]", 1))
        url = F.regexp_extract(found, r"\A!\[[^\]]*\]\(([^)]*)\)\z", 1)
        return F.when(~is_placeholder_url(url), found).when(alt == "", "").otherwise(F.concat(F.lit("*"), alt, F.lit("*")))

    def joined(v: Column) -> Column:
        return F.array_join(F.transform(v.parts, lambda part, i: F.concat(part, F.coalesce(F.get(v.images, i), F.lit("")))), "")

    images = F.transform(F.regexp_extract_all(x, F.lit(f"({IMAGE})"), F.lit(1)), rewritten)
    return F.when(F.instr(x, "![") > 0, let(F.struct(F.split(x, IMAGE, -1).alias("parts"), images.alias("images")), joined)).otherwise(x)


def strip_invisible(x: Column) -> Column:
    return only_if(reduce(or_, (x.contains(c) for c in INVISIBLE)), x, f"[{INVISIBLE}]+", "")


def end_with_newline(x: Column) -> Column:
    return F.concat(F.rtrim(x, F.lit(BLANKS)), F.lit("\n"))


#: The rules in the order in which they are applied, those of several steps by step.
RULES = (normalise_line_endings, strip, open_fence, close_fence, drop_line_feed, rstrip_inner_lines, rstrip_last_line, collapse_blank_lines, space_headings, repair_tables, rewrite_images, strip_invisible, end_with_newline)


def clean_markdown(x: Column) -> Column:
    """All rules in order; null stays null, an empty text becomes a line feed."""
    for rule in RULES:
        x = let(x, rule)
    return x


def clean_pages(pages: DataFrame) -> DataFrame:
    """Page results with clean Markdown; rows with an error keep theirs.

    One projection for each rule: what one rule makes is computed once however
    often the next refers to it, and simple rules stay in generated code.
    """
    out = pages.withColumn("_clean", F.col("markdown"))
    for rule in RULES:
        out = out.withColumn("_clean", rule(F.col("_clean")))
    return out.withColumn("markdown", F.when(F.col("error").isNull(), F.col("_clean")).otherwise(F.col("markdown"))).drop("_clean")


# -- quality predicates -------------------------------------------------------


def quality_checks(markdown: Column) -> dict[str, Column]:
    """Boolean columns by name; all true for well-formed page Markdown."""
    return {
        "not_blank": strip(markdown) != "",
        "ends_with_newline": markdown.endswith("\n"),
        "no_leading_fence": ~markdown.startswith("```"),
        "no_long_gap": ~markdown.contains("\n\n\n\n"),
        "no_invisible": ~markdown.rlike("[​﻿‌‍⁠]"),
        "long_enough": F.octet_length(markdown) >= 50,
    }


def has_headings(markdown: Column) -> Column:
    return markdown.rlike(r"(?:\A|\n)#")


def rule_count(markdown: Column) -> Column:
    return F.regexp_count(markdown, F.lit("---"))


def character_error_rate(got: Column, want: Column) -> Column:
    """Edit distance by the length of the wanted text; null for an empty one."""
    return F.when(F.length(want) > 0, F.levenshtein(got, want) / F.length(want))


def structure_counts(markdown: Column) -> dict[str, Column]:
    return {
        "n_headings": F.regexp_count(markdown, F.lit(r"(?m)^#+ ")), "n_table_rows": F.regexp_count(markdown, F.lit(r"(?m)^\|.*\|$")),
        "n_list_items": F.regexp_count(markdown, F.lit(r"(?m)^(?:[-*+]|[0-9]+\.) ")),
    }
