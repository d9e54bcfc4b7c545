"""Format-preserving pseudonyms for numbers, dates and addresses in texts.

Each kind is found by a pattern and validated (Luhn, calendar, octets, mod 97, area
codes); a valid value becomes a number below the count of valid values of its format,
a keyed Feistel permutation maps this number, and the result is written in the same
format. So equal values have equal pseudonyms in all documents, different ones different
pseudonyms, and a pseudonym is valid in turn. A value never maps to itself: between
the permutation and its inverse the numbers are turned by one place.

A text is rewritten by itself, in one pass without a shuffle; where matches overlap, the
leftmost is taken, and of equal starts the kind listed first.

Cases: a null text stays null; a text without values stays as it is, whatever its
length. Invalid numbers are left alone. Rows are rewritten one by one, so repeated
rows stay equal. An empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

from pyspark.sql import DataFrame, functions as F

DEMO_KEY = b"change this key for every corpus"
ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # up to 2099-12-31

#: The accepted forms, in order of precedence.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    # A whole run of groups with 13 digits or more; _cards looks for the numbers in it.
    "card": r"(?<![0-9])(?=(?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![\w+])(?:\+[1-9][0-9]{0,2}[\x20.-]?)(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9])"
    r"|(?<![\w+])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9.])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9]|\.[0-9])",
}

#: How the digits of a card are grouped, if they are.
CARD_GROUPS = (
    (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 5, 6), (8, 8), (4, 3, 3, 3), (4, 4, 5), (6, 13), (4, 4, 4, 4, 3),
)
#: Beginnings and lengths in use, which decide between two valid numbers that overlap.
ISSUED = re.compile(
    r"4(?:.{12}|.{15}|.{18})|5[1-5].{14}|2[2-7].{14}|3[47].{13}|3(?:0[0-5]|[689].).{11}|35.{14}|(?:5[06-9]|6.).{11,17}"
)
_GROUP = re.compile("[0-9]+")
_ANY_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])")


class Permutation:
    """Keyed permutations of range(n), without fixed points for n > 1."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, int, int], int] = {}

    def _round(self, tweak: bytes, number: int, half: int, below: int) -> int:
        text = tweak + number.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 8) // 8, "big")
        return int.from_bytes(hmac.digest(self.key, text, "sha256"), "big") % below

    def _feistel(self, tweak: bytes, value: int, n: int, back: bool) -> int:
        """Two uneven halves that add into each other; values beyond n are walked on until one is below."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if r % 2 == 0:
                    left = (left + sign * self._round(tweak, r, right, a)) % a
                else:
                    right = (right + sign * self._round(tweak, r, left, b)) % b
            value = left * b + right
            if value < n:
                return value

    def __call__(self, kind: str, value: int, n: int) -> int:
        if n < 2:
            return value
        found = self.known.get((kind, n, value))
        if found is None:
            tweak = f"{kind}/{n}/".encode()
            turned = (self._feistel(tweak, value, n, False) + 1) % n
            found = self._feistel(tweak, turned, n, True)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[kind, n, value] = found
        return found


def _rank(digits: list[int], bases: list[int]) -> int:
    value = 0
    for d, base in zip(digits, bases):
        value = value * base + d
    return value


def _unrank(value: int, bases: list[int]) -> list[int]:
    digits = []
    for base in reversed(bases):
        value, d = divmod(value, base)
        digits.append(d)
    return digits[::-1]


def _size(bases: list[int]) -> int:
    n = 1
    for base in bases:
        n *= base
    return n


def _filled(form: str, digits: str) -> str:
    """form with its digits replaced, separators kept."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(text: str, permute: Permutation) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    # The first digit stays apart from zero, so that the number keeps its length.
    bases = [9] + [10] * (len(digits) - 2)
    head = [int(digits[0]) - 1, *map(int, digits[1:-1])]
    if head[0] < 0:
        return None
    out = _unrank(permute(f"card{len(digits)}", _rank(head, bases), _size(bases)), bases)
    body = "".join(map(str, [out[0] + 1, *out[1:]]))
    return _filled(text, body + next(c for c in "0123456789" if luhn(body + c)))


def _cards(pattern: re.Pattern, text: str, permute: Permutation) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in runs of digit groups, whatever numbers stand beside them.

    Unbroken numbers and those in the usual groups go first, wherever in the run they are;
    between them, other groupings are taken from the left, as long as they can be.
    """
    for match in pattern.finditer(text):
        at = match.start()
        spans = [m.span() for m in _GROUP.finditer(text, at, match.end())]
        if text[at - 1 : at] == ".":
            del spans[0]  # decimals
        sizes = [end - start for start, end in spans]
        usual = []
        for i, size in enumerate(sizes):
            forms = [(size,)] if 13 <= size <= 19 else [f for f in CARD_GROUPS if tuple(sizes[i : i + len(f)]) == f]
            for form in forms:
                start, end = spans[i][0], spans[i + len(form) - 1][1]
                new = _card(text[start:end], permute)
                if new is not None:
                    digits = "".join(_GROUP.findall(text[start:end]))
                    # Spaces inside, and a hyphen that ties an outer group to a number beside it.
                    tied = " " in text[start:end] and (
                        (i > 0 and text[start - 1] == "-") or (i + len(form) < len(spans) and text[end] == "-")
                    )
                    usual.append((tied, not ISSUED.fullmatch(digits), i, i + len(form), new))
        taken: dict[int, tuple[int, str]] = {}
        used: set[int] = set()
        for _, _, i, j, new in sorted(usual):
            if used.isdisjoint(range(i, j)):
                used.update(range(i, j))
                taken[i] = j, new
        i = 0
        while i < len(spans):
            if i in taken:
                j, new = taken[i]
                yield spans[i][0], spans[j - 1][1], new
            else:
                j = next((k for k in range(i, len(spans)) if k in taken), len(spans))
                for other in _ANY_CARD.finditer(text, spans[i][0], spans[j - 1][1]):
                    new = _card(other.group(), permute)
                    if new is not None:
                        yield *other.span(), new
            i = j


def _ssn(text: str, permute: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    bases = [898, 99, 9999]
    place = area - 1 - (area > 666)
    a, g, s = _unrank(permute("ssn", _rank([place, group - 1, serial - 1], bases), _size(bases)), bases)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(text: str, permute: Permutation) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not 8 <= len(digits) <= 15:
        return None
    country = re.match(r"\+[0-9]{1,3}", text)
    code = country.group()[1:] if country else ""
    if code.startswith("1"):
        code = "1"  # +1 is followed by the area code, with or without a space
    own = digits[len(code) :]
    # Ten digits under +1, or without a country: area and exchange begin with 2 to 9. Either way
    # it is the same number, with the same pseudonym.
    bases, kind = [10] * len(own), f"phone{code}-any"
    national = [8, 10, 10, 8, 10, 10, 10, 10, 10, 10] if len(own) == 10 and code in ("", "1") else None

    def in_plan(digits: str) -> bool:
        return national is not None and digits[0] > "1" and digits[3] > "1"

    if in_plan(own):
        bases, kind = national, "phone"
    low = [10 - b for b in bases]
    new = own
    while True:  # a number outside the plan stays outside
        out = _unrank(permute(kind, _rank([int(c) - x for c, x in zip(new, low)], bases), _size(bases)), bases)
        new = "".join(str(o + x) for o, x in zip(out, low))
        if in_plan(new) == in_plan(own):
            return _filled(text, code + new)


def _phone_end(text: str) -> int:
    """Where the number ends in a match that may have swallowed the groups behind it."""
    if text[0] != "+":
        return len(text)
    ends, digits = [], 0
    for match in _GROUP.finditer(text):
        digits += len(match.group())
        ends.append((match.end(), digits))
    if text[1] == "1":  # ten digits follow +1; other plans have no fixed length
        national = [end for end, digits in ends if digits == 11]
        if national:
            return national[0]
    return max((end for end, digits in ends if digits <= 15), default=len(text))


def _phones(pattern: re.Pattern, text: str, permute: Permutation) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the phones; the search goes on right behind each."""
    match = pattern.search(text)
    while match:
        start, end = match.start(), match.start() + _phone_end(match.group())
        new = _phone(text[start:end], permute)
        if new is not None:
            yield start, end, new
        match = pattern.search(text, start + 1 if new is None else end)


def _ip(text: str, permute: Permutation) -> str | None:
    octets = [int(p) for p in text.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, _unrank(permute("ip", _rank(octets, [256] * 4), 1 << 32), [256] * 4)))


def _date(text: str, permute: Permutation) -> str | None:
    mark = re.search(r"[-/.]", text).group()
    parts = text.split(mark)
    year_first = len(parts[0]) == 4
    year, first, second = (parts[0], parts[1], parts[2]) if year_first else (parts[2], parts[0], parts[1])
    # Slashes put the month first, other marks the day. Where that gives no date, the other
    # reading is taken.
    month_leads = year_first or mark == "/"
    if not year_first and int(first if month_leads else second) > 12:
        month_leads = not month_leads
    month, day = (first, second) if month_leads else (second, first)
    try:
        value = date(int(year), int(month), int(day))
    except ValueError:
        return None
    if not 0 <= (value - FIRST_DAY).days < DAYS:
        return None
    # Days move among those whose fields are as wide and can be read in as many ways, whatever the
    # notation: so a date has one pseudonym in all, and each reads and looks as the date did.
    kind = _date_class(value)
    same = _days_like(kind)
    new = same[permute(f"date{kind}", bisect_left(same, value), len(same))]
    rest = [f"{new.month:0{len(month)}d}", f"{new.day:0{len(day)}d}"]
    rest = rest if month_leads else rest[::-1]
    return mark.join([f"{new.year:04d}", *rest] if year_first else [*rest, f"{new.year:04d}"])


def _date_class(day: date) -> tuple[bool, int]:
    """Whether the month has two digits; whether the day has one, two, or is no month either."""
    return day.month > 9, (day.day > 9) + (day.day > 12)


@lru_cache(None)
def _days_like(kind: tuple[bool, int]) -> list[date]:
    days = (FIRST_DAY + timedelta(days=i) for i in range(DAYS))
    return [d for d in days if _date_class(d) == kind]


def _iban(text: str, permute: Permutation) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    bases = [10 if c.isdigit() else 26 for c in body]
    values = [int(c) if c.isdigit() else ord(c) - 65 for c in body]
    form = "".join("9" if c.isdigit() else "A" for c in body)
    out = _unrank(permute(f"iban{plain[:2]}{form}", _rank(values, bases), _size(bases)), bases)
    body = "".join(chr(65 + o) if base == 26 else str(o) for o, base in zip(out, bases))
    check = 98 - number(body + plain[:2] + "00") % 97
    rest = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def _email(text: str, permute: Permutation) -> str | None:
    # Letters and digits move within their class; marks and the last label stay. An address is the
    # same in capitals: they stay where they are and don't change the pseudonym.
    head, dot, top = text.rpartition(".")
    alphabet = {"a": "abcdefghijklmnopqrstuvwxyz", "9": "0123456789"}
    form = ["a" if "a" <= c <= "z" else "9" if c.isdigit() else c for c in head.lower()]
    bases = [len(alphabet[f]) for f in form if f in alphabet]
    values = [alphabet[f].index(c) for f, c in zip(form, head.lower()) if f in alphabet]
    kind = "email" + hashlib.sha256("".join(form).encode()).hexdigest()[:16]
    out = iter(_unrank(permute(kind, _rank(values, bases), _size(bases)), bases))
    new = [alphabet[f][next(out)] if f in alphabet else f for f in form]
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, head)) + dot + top


WRITERS = {
    "email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date,
}
#: Kinds whose numbers are not whole matches of their pattern.
SEARCHES = {"card": _cards, "phone": _phones}


def _found(kind: str, pattern: re.Pattern, text: str, permute: Permutation) -> Iterator[tuple[int, int, str]]:
    """(start, end, pseudonym) of the valid values of a kind."""
    if kind in SEARCHES:
        yield from SEARCHES[kind](pattern, text, permute)
        return
    for match in pattern.finditer(text):
        new = WRITERS[kind](match.group(), permute)
        if new is not None:
            yield *match.span(), new


class Pseudonymiser:
    """Rewrites texts under one key."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        self.permute = Permutation(key)
        self.kinds = kinds
        self.patterns = [(k, re.compile(PATTERNS[k], re.ASCII)) for k in kinds]
        self.hint = re.compile("[0-9@]")

    def values(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the valid values, in order, without overlaps."""
        if not self.hint.search(text):
            return []
        found = []
        for place, (kind, pattern) in enumerate(self.patterns):
            for start, stop, new in _found(kind, pattern, text, self.permute):
                found.append((start, place, stop, kind, new))
        out, end = [], 0
        for start, _, stop, kind, new in sorted(found):
            if start >= end:
                out.append((start, stop, kind, new))
                end = stop
        return out

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        """The rewritten text and how many values of each kind it had."""
        parts, at, counts = [], 0, {}
        for start, stop, kind, new in self.values(text):
            parts += [text[at:start], new]
            at = stop
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*parts, text[at:]]) if parts else text, counts


def pseudonymised(
    docs: DataFrame, key: bytes = DEMO_KEY, kinds: tuple[str, ...] = KINDS, report: bool = False
) -> DataFrame:
    """docs with rewritten texts; ``report`` adds n_<kind>, how many values of a kind were replaced."""

    @F.pandas_udf("text string, " + ", ".join(f"{k} long" for k in kinds))
    def rewritten(texts):
        import pandas as pd

        rewrite = Pseudonymiser(key, kinds)
        rows = []
        for text in texts:
            new, counts = (None, {}) if text is None else rewrite(text)
            rows.append((new, *[counts.get(k, 0) for k in kinds]))
        return pd.DataFrame(rows, columns=["text", *kinds])

    named = docs.select(F.struct(F.col("*")).alias("_doc")).withColumn("_pii", rewritten("_doc.text"))
    others = [F.col("_pii.text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]
    counts = [F.col("_pii")[k].alias(f"n_{k}") for k in kinds]
    return named.select(*others, *(counts if report else []))
