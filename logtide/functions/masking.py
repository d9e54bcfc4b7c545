"""Variable masks, template tokens and the variables a template leaves open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from logtide.functions.bind import bind


def _run_sequence(sizes: list[str], open_size: str) -> str:
    """Linear-time regex for ``needed`` or more pieces in blank-separated runs.

    ``sizes[k]`` matches a run worth exactly k+1 pieces, ``open_size`` one piece
    or more. Every way of reaching ``needed = len(sizes) + 1`` pieces is one
    branch of possessive runs, so no branch backtracks into a run; what follows
    is taken whole. A blank before a further word belongs to the match.
    """
    needed = len(sizes) + 1
    end = r"(?!\w)"

    def ways(left: int) -> list[str]:
        whole = open_size.replace("N", str(left))
        out = [f"{whole}{end}"]
        for k in range(1, left):
            out += [f"{sizes[k - 1]}{end} {rest}" for rest in ways(left - k)]
        return out

    more = open_size.replace("N", "1")
    return rf"\b(?:{'|'.join(ways(needed))})(?: {more}{end})*+(?: (?=\w))?"


LOWER_HEX, UPPER_HEX = "[0-9a-f]", "[0-9A-F]"

# What is masked, in this order, and the name put in its place.
MASKS: list[tuple[str, str]] = [
    (rf"\b{LOWER_HEX}{{2,}}+(?::{LOWER_HEX}{{2,}}+\b){{3,}}+", "ID"),
    (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", "IP"),
    (
        _run_sequence(
            [f"{LOWER_HEX}{{6,11}}+", f"{LOWER_HEX}{{12,17}}+"],
            f"(?:{LOWER_HEX}{{6}}){{N}}{LOWER_HEX}*+",
        ),
        "SEQ",
    ),
    (
        _run_sequence(
            [f"{UPPER_HEX}{{4}}", f"{UPPER_HEX}{{8}}", f"{UPPER_HEX}{{12}}"],
            f"(?:{UPPER_HEX}{{4}}){{N,}}+",
        ),
        "SEQ",
    ),
    (r"\b(0x[a-f0-9A-F]+)\b", "HEX"),
    (r"\b([\-\+]?\d+)\b", "NUM"),
    (r'(?<=executed cmd )(".+?")', "CMD"),
]
# What a text must hold for the mask at the same place to match; found much faster than the mask.
SIGNS: list[Callable[[Column], Column]] = [
    lambda text: text.contains(":"),
    lambda text: text.rlike(r"\d\.\d{1,3}\.\d"),
    lambda text: text.rlike("[0123456789abcdef]" * 6),  # single characters are looked up in a table, ranges are not
    lambda text: text.rlike("[0123456789ABCDEF]" * 4),
    lambda text: text.contains("0x"),
    lambda text: text.rlike(r"\d"),
    lambda text: text.contains("executed cmd "),
]
NUMBERED = {"IP", "HEX", "NUM"}  # masks that need a digit; no mask puts one in
WILDCARD = "<*>"


def mask_variables(text: Column) -> Column:
    """Replace ids, addresses, hex runs, numbers and quoted commands by names."""

    def masked(text: Column, digits: bool) -> Column:
        for (pattern, name), sign in zip(MASKS, SIGNS, strict=True):
            if digits or name not in NUMBERED:
                text = bind(text, lambda t: F.when(sign(t), F.regexp_replace(t, pattern, f"<:{name}:>")).otherwise(t))
        return text

    return bind(text, lambda t: F.when(t.rlike(r"\d"), masked(t, True)).otherwise(masked(t, False)))


def template_tokens(text: Column) -> Column:
    """Whitespace tokens, with underscores as blanks."""
    flat = F.trim(F.regexp_replace(text, r"[_\s]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ", -1))


def extract_variables(text: Column, template: Column) -> Column:
    """Tokens of text at the template's wildcards; a final wildcard takes the rest."""

    def collect(pair: Column) -> Column:
        tokens, shape = pair["tokens"], pair["shape"]
        last = F.size(shape)

        def value(place: Column) -> Column:
            rest = F.array_join(F.slice(tokens, place, F.size(tokens)), " ")
            return F.when(place == last, rest).otherwise(F.get(tokens, place - 1))

        shared = F.least(F.size(tokens), last)
        places = F.filter(F.sequence(F.lit(1), shared), lambda i: F.get(shape, i - 1) == WILDCARD)
        return F.when(shared == 0, F.array().cast("array<string>")).otherwise(
            F.transform(places, value)
        )

    pair = F.struct(
        template_tokens(text).alias("tokens"), template_tokens(template).alias("shape")
    )
    return bind(pair, collect)


def var_count(template: Column) -> Column:
    return F.size(F.split(template, r"<\*>", -1)) - 1
