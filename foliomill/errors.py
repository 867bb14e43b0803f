"""Errors: kinds, message formats, and the columns that render them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Message formats by kind.
MESSAGES = {
    "FileNotFound": "PDF file not found: '{path}'\nCheck the path exists and is readable.",
    "PermissionDenied": "Permission denied reading '{path}'\nTry: chmod +r \"{path}\"",
    "DownloadFailed": "Failed to download '{url}': {reason}\nCheck your internet connection.",
    "DownloadTimeout": "Download timed out after {secs}s for '{url}'\nIncrease --download-timeout.",
    "NotAPdf": "File is not a valid PDF: '{path}'\nFirst bytes: {magic}",
    "CorruptPdf": "PDF '{path}' is corrupt: {detail}\nTry repairing with: qpdf --decrypt input.pdf output.pdf",
    "PasswordRequired": "PDF '{path}' is encrypted and requires a password.\nProvide it with --password <PASSWORD>.",
    "WrongPassword": "Wrong password for PDF '{path}'",
    "PageOutOfRange": "Page {page} is out of range (document has {total} pages)",
    "RasterisationFailed": "Rasterisation failed for page {page}: {detail}",
    "ProviderNotConfigured": "LLM provider '{provider}' is not configured.\n{hint}",
    "AllPagesFailed": "All {total} pages failed after {retries} retries each.\nFirst error: {first_error}",
    "PartialFailure": "{failed}/{total} pages failed during conversion",
    "OutputWriteFailed": "Failed to write output file '{path}': {detail}",
    "InvalidConfig": "Invalid configuration: {detail}",
    "Internal": "Internal error: {detail}",
    "RenderFailed": "Page {page}: rasterisation failed: {detail}",
    "LlmFailed": "Page {page}: LLM call failed after {retries} retries: {detail}",
    "Timeout": "Page {page}: LLM call timed out after {secs}s",
}


class ConversionError(Exception):
    """A fatal error of a kind in MESSAGES."""

    def __init__(self, kind: str, **values):
        self.kind, self.values = kind, values
        super().__init__(MESSAGES[kind].format(**values))


def message(kind: str, **values: Column) -> Column:
    """The message of one kind, from columns."""
    parts, rest = [], MESSAGES[kind]
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def page_error_message(error: Column) -> Column:
    """Message of a page error struct (kind, page, retries, secs, detail); null without an error."""
    return (
        F.when(error.kind == "RenderFailed", message("RenderFailed", page=error.page, detail=error.detail))
        .when(error.kind == "LlmFailed", message("LlmFailed", page=error.page, retries=error.retries, detail=error.detail))
        .when(error.kind == "Timeout", message("Timeout", page=error.page, secs=error.secs))
    )


def open_error_kind(detail: Column, has_password: Column) -> Column:
    """Kind of an error met on opening a file."""
    asks = detail.contains("Password") | detail.contains("password")
    return F.when(asks & has_password, "WrongPassword").when(asks, "PasswordRequired").otherwise("CorruptPdf")


def short(text: Column, most: int = 80) -> Column:
    """At most ``most`` bytes, else all but one of as many characters and an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)
