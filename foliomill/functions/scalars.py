"""Small scalar functions: urls, separators, front-matter, prompts, messages, models, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PageSeparator

MAGIC = "%PDF"

# Default models by provider name, and prices in USD per million tokens (input, output).
DEFAULT_MODELS = {
    "pixtral-12b-2409": ("mistral", "mistral-ai", "mistralai"),
    "llava": ("ollama", "lmstudio", "lm-studio", "lm_studio"),
}
DEFAULT_MODEL = "gpt-4.1-nano"
PRICES = (
    ("openai", "gpt-4.1-nano", 0.10, 0.40), ("openai", "gpt-4.1-mini", 0.40, 1.60), ("openai", "gpt-4.1", 2.0, 8.0), ("openai", "gpt-4o", 2.50, 10.0),
    ("anthropic", "claude-sonnet-4-20250514", 3.0, 15.0), ("anthropic", "claude-haiku-4-20250514", 0.80, 4.0),
    ("gemini", "gemini-2.0-flash", 0.10, 0.40), ("gemini", "gemini-2.5-pro", 1.25, 10.0), ("mistral", "pixtral-12b-2409", 0.15, 0.15),
)

SYSTEM_PROMPT = "Transcribe the page image into Markdown. Keep the reading order, headings, lists, tables and formulas; do not add, drop or comment on anything."
CONTINUITY = "Continue in the format of the page before, which was: "


def is_url(path: Column) -> Column:
    return path.startswith("http://") | path.startswith("https://")


def filename(url: Column) -> Column:
    """Last segment of a url's path if it has a dot, else a default; query and fragment don't count."""
    last = F.substring_index(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1), "/", -1)
    return F.when(last.contains("."), last).otherwise("downloaded.pdf")


def is_accepted(content: Column) -> Column:
    """Bytes that pass the magic check; fewer than four pass as well."""
    return (F.octet_length(content) < 4) | (F.substring(content, 1, 4) == F.lit(MAGIC).cast("binary"))


def separator(page_num: Column, kind: PageSeparator) -> Column:
    middle = {
        "none": F.lit("\n\n"), "rule": F.lit("\n\n---\n\n"), "custom": F.lit(f"\n\n{kind.text}\n\n"),
        "comment": F.concat(F.lit("\n\n<!-- page "), page_num.cast("string"), F.lit(" -->\n\n")),
    }
    return middle[kind.kind]


def front_matter(meta: dict[str, Column]) -> Column:
    """YAML block from metadata columns by name; absent fields are left out, values are not escaped."""
    quoted = lambda name: F.coalesce(F.concat(F.lit(f'{name}: "'), meta[name], F.lit('"\n')), F.lit(""))
    version = F.when(F.coalesce(meta["pdf_version"], F.lit("")) != "", quoted("pdf_version")).otherwise("")
    names = ("title", "author", "subject", "creator", "producer")
    return F.concat(F.lit("---\n"), *map(quoted, names), F.lit("pages: "), meta["page_count"].cast("string"), F.lit("\n"), version, F.lit("---\n\n"))


def continuity_prompt(prior: Column) -> Column:
    return F.concat(F.lit(CONTINUITY + '"""'), prior, F.lit('"""'))


def messages(image_b64: Column, prior: Column, *, maintain_format: bool, system_prompt: str | None = None) -> Column:
    """Chat messages of a page: system, continuity if there is a prior page, and the image."""
    image = "array<struct<data:string,mime_type:string,detail:string>>"
    none = F.array().cast(image)
    turn = lambda role, content, images: F.struct(F.lit(role).alias("role"), content.alias("content"), images.alias("images"))
    user = turn("user", F.lit(""), F.array(F.struct(image_b64.alias("data"), F.lit("image/png").alias("mime_type"), F.lit("high").alias("detail"))))
    before = F.when(F.lit(maintain_format) & (F.coalesce(prior, F.lit("")) != ""), turn("system", continuity_prompt(prior), none))
    return F.array_compact(F.array(turn("system", F.lit(system_prompt or SYSTEM_PROMPT), none), before, user))


def default_model(provider: Column) -> Column:
    out = F.lit(DEFAULT_MODEL)
    for model, names in DEFAULT_MODELS.items():
        out = F.when(provider.isin(*names), model).otherwise(out)
    return out


def backoff_ms(attempt: Column, base_ms: int) -> Column:
    """Wait before a retry: doubles with each attempt, none before the first."""
    return F.when(attempt >= 1, F.lit(base_ms).cast("long") * F.pow(F.lit(2), attempt - 1).cast("long")).otherwise(0)


def encode_page(content: Column) -> Column:
    return F.struct(F.replace(F.replace(F.base64(content), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")).alias("image_b64"), F.lit("image/png").alias("mime_type"), F.lit("high").alias("detail"))
