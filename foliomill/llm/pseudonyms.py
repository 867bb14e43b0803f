"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers,
IPv4 addresses, calendar dates and the names in mail addresses are found and
validated; each value is permuted within the set of valid values of its own
format. The permutation depends on the key and the format only, so equal values
stay equal in all documents, and who holds the key can invert it. A value that
the permutation leads out of the valid set is permuted again until it is back
(cycle walking), which keeps the mapping one to one.

Left in clear are numbers that fail their check, plain runs of ten digits without
any separator, and dates with month names other than English ones.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

# Names of months, and the shapes that are looked for, in the order in which they are tried.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(f"{name}|{name[:3]}" for name in MONTHS)
SHAPES = (
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))",
    r"(?P<iso>[0-9]{4}(?P<cut>[-/.])[0-9]{2}(?P=cut)[0-9]{2}(?![0-9]))",
    rf"(?P<named>(?:[0-9]{{1,2}} (?:{_MONTH})|(?:{_MONTH}) [0-9]{{1,2}},) [0-9]{{4}}(?![0-9]))",
    r"(?P<dmy>[0-9]{1,2}(?P<sign>[/.])[0-9]{1,2}(?P=sign)[0-9]{4}(?![0-9]))",
    r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))",
    r"(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))",
    r"(?P<card>(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))",
    r"(?P<phone>(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})(?![0-9]))",
)
_NUMBERS = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Z+(])(?:" + "|".join(SHAPES) + ")")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")


class Feistel:
    """A keyed permutation of the integers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, k: int, half: int, bits: int, tweak: bytes) -> int:
        digest = hashlib.blake2b(half.to_bytes(32, "big") + bytes([k]) + tweak, key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        low = (1 << bits) - 1
        left, right = x >> bits, x & low
        if back:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ self._round(k, left, bits, tweak), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ self._round(k, right, bits, tweak)
        return left << bits | right

    def permute(self, x: int, bound: int, tweak: str, valid: Callable[[int], bool] = lambda x: True, back: bool = False) -> int:
        bits = max(1, (max(bound - 1, 1).bit_length() + 1) // 2)
        mark = f"{tweak}/{bound}".encode()
        while True:
            x = self._once(x, bits, mark, back)
            if x < bound and valid(x):
                return x


def _luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _refill(shape: str, chars: str) -> str:
    """Put the characters where the shape has letters or digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Finds and permutes values; ``back`` inverts."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _permute(self, x, bound, tweak, valid=lambda x: True):
        return self.feistel.permute(x, bound, tweak, valid, self.back)

    def _mixed(self, chars: str, tweak: str, valid: Callable[[str], bool] = lambda chars: True) -> str:
        """Permute a string in which each character keeps its class: digit, upper or lower case."""
        radix = [(48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26) for c in chars]

        def spelt(x: int) -> str:
            out = []
            for base, size in reversed(radix):
                x, r = divmod(x, size)
                out.append(chr(base + r))
            return "".join(reversed(out))

        x, bound = 0, 1
        for c, (base, size) in zip(chars, radix):
            x, bound = x * size + ord(c) - base, bound * size
        kinds = "".join("dUl"[(base > 48) + (base > 65)] for base, _ in radix)
        return spelt(self._permute(x, bound, tweak + kinds, lambda y: valid(spelt(y))))

    def card(self, m: str) -> str | None:
        digits = re.sub("[ -]", "", m)
        if _luhn(digits[:-1]) != int(digits[-1]):
            return None
        body = f"{self._permute(int(digits[:-1]), 10 ** (len(digits) - 1), 'card'):0{len(digits) - 1}d}"
        return _refill(m, body + str(_luhn(body)))

    def iban(self, m: str) -> str | None:
        """Groups after the number may be words: the longest whole number of groups that is valid counts."""
        groups = m.split(" ")
        for n in range(len(groups), 0, -1):
            number, rest = "".join(groups[:n]), " ".join(groups[n:])
            if len(number) >= 15 and _mod97(number) == 1:
                break
        else:
            return None
        longer = ["".join(groups[n:k]) for k in range(n + 1, len(groups) + 1)]
        # a pseudonym must not become valid together with the groups that follow it
        alone = lambda new: not any(_mod97(new + more) == 1 for more in longer)
        with_check = lambda body: f"{number[:2]}{98 - _mod97(number[:2] + '00' + body):02d}{body}"
        new = with_check(self._mixed(number[4:], "iban" + number[:2], lambda body: alone(with_check(body))))
        return _refill(" ".join(groups[:n]), new) + (" " + rest if rest else "")

    def ssn(self, m: str) -> str | None:
        valid = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 > 0 and x % 10**4 > 0
        x = int(m.replace("-", ""))
        return _refill(m, f"{self._permute(x, 10**9, 'ssn', valid):09d}") if valid(x) else None

    def phone(self, m: str) -> str | None:
        prefix = re.match(r"\+[0-9]{1,3}(?=[ .(-])[ .-]?", m)
        kept = prefix[0] if prefix else ""
        digits = re.sub("[^0-9]", "", m[len(kept) :])
        if not 7 <= len(re.sub("[^0-9]", "", m)) <= 15:
            return None
        return kept + _refill(m[len(kept) :], f"{self._permute(int(digits), 10 ** len(digits), 'phone'):0{len(digits)}d}")

    def ip(self, m: str) -> str | None:
        fields = m.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in fields):
            return None
        x = self._permute(int.from_bytes(bytes(map(int, fields)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, day: int, tweak: str, valid) -> datetime.date:
        return datetime.date.fromordinal(FIRST_DAY + self._permute(day - FIRST_DAY, DAYS, tweak, lambda x: valid(datetime.date.fromordinal(FIRST_DAY + x))))

    def iso(self, m: str) -> str | None:
        try:
            day = datetime.date.fromisoformat(re.sub("[/.]", "-", m)).toordinal()
        except ValueError:
            return None
        return self._day(day, "iso", lambda d: True).isoformat().replace("-", m[4]) if 0 <= day - FIRST_DAY < DAYS else None

    def named(self, m: str) -> str | None:
        name, digits = re.search("[A-Z][a-z]+", m)[0], re.search("[0-9]+", m)[0]
        month = next(k for k, full in enumerate(MONTHS, 1) if full.startswith(name))
        try:
            found = datetime.date(int(m[-4:]), month, int(digits))
        except ValueError:
            return None
        if not 0 <= found.toordinal() - FIRST_DAY < DAYS:
            return None
        # days of one digit stay so, and so does the style of the name; May is both
        written = lambda d: MONTHS[d.month - 1] if len(name) > 3 or name == "May" else MONTHS[d.month - 1][:3]
        style = "May" if name == "May" else "full" if len(name) > 3 else "short"
        valid = lambda d: (len(digits) == 2 or d.day < 10) and (style == "May") == (d.month == 5)
        d = self._day(found.toordinal(), f"named{len(digits)}{style}", valid)
        return m[:-4].replace(name, written(d)).replace(digits, f"{d.day:0{len(digits)}d}") + str(d.year)

    def dmy(self, m: str) -> str | None:
        sign = m[-5]
        first, second, year = m.split(sign)

        def read(day, month):
            try:
                return datetime.date(int(year), int(month), int(day))
            except ValueError:
                return None

        wide = lambda n, text: n > 9 or len(text) == 2
        found, flipped = read(first, second), False
        if not found:
            found, flipped = read(second, first), True
        if not found or not 0 <= found.toordinal() - FIRST_DAY < DAYS:
            return None

        def valid(d):  # fields of one digit stay so, and month-first dates can't be read day-first
            a, b = (d.month, d.day) if flipped else (d.day, d.month)
            return (len(first) == 2 or a < 10) and (len(second) == 2 or b < 10) and (not flipped or d.day > 12)

        d = self._day(found.toordinal(), f"dmy{len(first)}{len(second)}{flipped}", valid)
        a, b = (d.month, d.day) if flipped else (d.day, d.month)
        return f"{a:0{len(first)}d}{sign}{b:0{len(second)}d}{sign}{d.year}"

    def email(self, name: str) -> str:
        chars = "".join(c for c in name if c.isalnum())
        return _refill(name, self._mixed(chars, "email")) if chars else name

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with its values permuted, and how many of each kind."""
        found = dict.fromkeys(KINDS, 0)

        def number(m: re.Match) -> str:
            kind = m.lastgroup
            new = getattr(self, kind)(m[0])
            if new is None:
                return m[0]
            found["date" if kind in ("iso", "dmy", "named") else kind] += 1
            return new

        def mail(m: re.Match) -> str:
            found["email"] += 1
            return self.email(m[1]) + m[2]

        if "@" not in text:
            return _NUMBERS.sub(number, text), found
        # mail addresses first; numbers are looked for between them
        out, at = [], 0
        for m in _MAIL.finditer(text):
            out += [_NUMBERS.sub(number, text[at : m.start()]), mail(m)]
            at = m.end()
        return "".join(out) + _NUMBERS.sub(number, text[at:]), found


def pseudonyms(docs: DataFrame, key: bytes, *, back: bool = False) -> DataFrame:
    """Every document with its private values permuted: doc_id, text, n_card ... n_email.

    Reads ``doc_id`` and ``text``; whole texts are searched. A null text stays
    null and counts nothing; invalid values stay as they are; repeated rows keep
    their rows; an empty table gives an empty result. ``back`` inverts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            out = [(None, dict.fromkeys(KINDS, 0)) if t is None else names.text(t) for t in batch.column("text").to_pylist()]
            columns = {"doc_id": batch.column("doc_id"), "text": pa.array([t for t, _ in out], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {f"n_{k}": pa.array([n[k] for _, n in out], pa.int64()) for k in KINDS})

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
