"""Configuration of a conversion: values, clamps and the parsers of page and separator options."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import ConversionError

FIDELITY = ("tier1", "tier2", "tier3")


@dataclass(frozen=True)
class PageSelection:
    """Which pages: kind is all, single, range or set; numbers are 1-based."""

    kind: str = "all"
    pages: tuple[int, ...] = ()

    @staticmethod
    def single(page: int) -> PageSelection:
        return PageSelection("single", (page,))

    @staticmethod
    def between(first: int, last: int) -> PageSelection:
        return PageSelection("range", (first, last))

    @staticmethod
    def of(*pages: int) -> PageSelection:
        return PageSelection("set", pages)

    def to_indices(self, total: int) -> list[int]:
        """Sorted distinct 0-based indices within a document of ``total`` pages."""
        if self.kind == "all":
            return list(range(total))
        if self.kind == "range":
            return list(range(max(self.pages[0], 1) - 1, min(self.pages[1], total)))
        return sorted({p - 1 for p in self.pages if 1 <= p <= total})


def parse_pages(text: str) -> PageSelection:
    """``all``, ``5``, ``3-7`` or ``1,3,5``; a hyphen is looked for before a comma."""

    def number(part: str) -> int:
        digits = part.strip()
        if not digits.isascii() or not digits.removeprefix("+").isdigit():
            raise ConversionError("InvalidConfig", detail=f"invalid page number '{part.strip()}'")
        return int(digits)

    spec = text.strip().lower()
    if spec == "all":
        return PageSelection()
    if "-" in spec:
        first, last = map(number, spec.split("-", 1))
        if first < 1 or first > last:
            raise ConversionError("InvalidConfig", detail=f"invalid page range '{spec}'")
        return PageSelection.between(first, last)
    pages = tuple(map(number, spec.split(",")))
    if min(pages) < 1:
        raise ConversionError("InvalidConfig", detail="pages are numbered from 1")
    return PageSelection.of(*pages) if "," in spec else PageSelection.single(pages[0])


@dataclass(frozen=True)
class PageSeparator:
    """What stands between pages: kind is none, rule, comment or custom."""

    kind: str = "none"
    text: str = ""


def parse_separator(text: str) -> PageSeparator:
    """Option text to separator; a custom text is lower-cased, as the option always was."""
    lowered = text.lower()
    kinds = {"none": "none", "hr": "rule", "---": "rule", "comment": "comment"}
    return PageSeparator(kinds[lowered]) if lowered in kinds else PageSeparator("custom", lowered)


def _clamp(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class ConversionConfig:
    """All options; numbers are clamped to their ranges. ``dpi`` and ``fidelity`` are kept as metadata only."""

    dpi: int = 150
    max_rendered_pixels: int = 2000
    concurrency: int = 10
    model: str | None = None
    provider_name: str | None = None
    temperature: float = 0.1
    max_tokens: int = 4096
    max_retries: int = 3
    retry_backoff_ms: int = 500
    maintain_format: bool = False
    fidelity: str = "tier2"
    system_prompt: str | None = None
    pages: PageSelection = field(default_factory=PageSelection)
    page_separator: PageSeparator = field(default_factory=PageSeparator)
    include_metadata: bool = False
    password: str | None = None
    download_timeout_secs: int = 120
    api_timeout_secs: int = 60

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("dpi", _clamp(self.dpi, 72, 400))
        put("max_rendered_pixels", max(self.max_rendered_pixels, 100))
        put("concurrency", max(self.concurrency, 1))
        put("temperature", _clamp(self.temperature, 0.0, 2.0))
        if self.fidelity not in FIDELITY:
            raise ConversionError("InvalidConfig", detail=f"fidelity '{self.fidelity}'")
