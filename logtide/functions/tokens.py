"""Names in log lines: bracketed words and processes, and keyword scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from logtide.functions.bind import bind

# Bracket contents that are dates, and a process before its id.
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}|^\d{2}:\d{2}:\d{2}|^\w{3}\s+\d{1,2}"
BRACKETED = r"\[([^\[\]]+)\]"
PROCESS = r"(\b[a-zA-Z][\w._-]+)\[\d+\]"


def bracket_tokens(text: Column) -> Column:
    """Lower-case names in brackets, then new process names before ``[pid]``."""
    inside = F.transform(
        F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1)), lambda t: F.trim(t)
    )
    named = F.filter(
        inside, lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\d+$") & ~t.rlike(DATE_LIKE)
    )
    processes = F.transform(F.regexp_extract_all(text, F.lit(PROCESS), F.lit(1)), F.lower)
    pair = F.struct(
        F.transform(named, F.lower).alias("named"), F.array_distinct(processes).alias("processes")
    )
    return bind(
        pair,
        lambda p: F.concat(
            p["named"], F.filter(p["processes"], lambda t: ~F.array_contains(p["named"], t))
        ),
    )


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def match_tag(tokens: Column, text: Column, tags: list[dict], default_tag: str) -> Column:
    """Tag with the highest score, the first on ties, the default at score zero.

    A tag scores one per token that contains a keyword, and one if any of its
    patterns occurs in the text.
    """
    if not tags:
        return F.lit(default_tag)

    def score(tag: dict) -> Column:
        total = F.lit(0)
        keywords = tag.get("keywords", [])
        if keywords:
            total = total + F.size(
                F.filter(tokens, lambda t: F.arrays_overlap(
                    F.array(F.lit(True)), F.array(*[F.contains(t, F.lit(k)) for k in keywords])
                ))
            )
        patterns = [p for p in tag.get("patterns", []) if _valid(p)]
        if patterns:
            found = F.lit(False)
            for pattern in patterns:
                found = found | text.rlike(f"(?i){pattern}")
            total = total + found.cast("int")
        return total

    ranked = F.array(*[
        F.struct(score(tag).alias("score"), F.lit(-i).alias("rank"), F.lit(tag["name"]).alias("name"))
        for i, tag in enumerate(tags)
    ])
    return bind(
        F.array_max(ranked),
        lambda best: F.when(best["score"] > 0, best["name"]).otherwise(default_tag),
    )
