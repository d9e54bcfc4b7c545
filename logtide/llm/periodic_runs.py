"""Maximal periodic runs of words, found from minimizers at several scales.

A run is a stretch of consecutive words with smallest period q, at least ``exponent``
times as long as q and ``least`` words long, that no neighbouring word extends. Its
words from the second period on repeat what stands q words before.

Periods up to SHORT are read off directly: words equal to those q places on. Longer
ones have a scale each, of periods from span + 1 to 2 span. There, of every ``span``
neighbouring grams of 2 span words the one with the least hash is a minimizer. Inside a
run, a minimizer lies a period behind each other one of the same gram and none between
(a gram no shorter than the period occurs once in it), so neighbouring equal minimizers
at such a distance are the seeds. Each seed is extended to both sides word by word. Four
periods hold a whole window and the window a period further, so no run is missed;
extension compares words, so hashes decide only where to look.

The texts of a block lie one behind the other with a word of its own after each, which
no run can cross. Scales go on until no text of the block holds ``exponent`` periods.

Cases: a null text is an empty one and has no words, no runs and an empty text. Texts of
any length are read whole; one text is held by one task. Equal runs in copies of a text
are found in each copy. Rows that repeat a doc_id, or have none, are read one by one. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm.texts import blocks, id_and_text

SHORT = 8  # periods scanned directly; a power of two
RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of both halves of a gram, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the first least hash of each window; ``width`` is a power of two."""
    least, at, step = hashes, np.arange(len(hashes)), 1
    while step < width:
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        step *= 2
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` whose words equal those ``lag`` places on."""
    start, end, step = at, at, 64
    while start:
        low = max(0, start - step)
        differ = (words[low:start] != words[low + lag : start + lag])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            start -= first
            break
        start, step = low, 2 * step
    step, last = 64, len(words) - lag
    while end < last:
        high = min(last, end + step)
        differ = words[end:high] != words[end + lag : high + lag]
        first = int(differ.argmax())
        if differ[first]:
            end += first
            break
        end, step = high, 2 * step
    return start, end + lag


def find_runs(words: np.ndarray, longest: list[tuple[int, int]], exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, end, period) of the runs in the numbered words of a block, by start, then period.

    ``longest`` has (words of a text, place behind it) with the longest texts first, which
    come first in the block, so that a scale reads only those that can hold its periods.
    """
    if exponent < 4:
        raise ValueError("a run has four periods at least")
    found: list[np.ndarray] = [np.empty((0, 3), np.int64)]

    def reach(period: int) -> int:
        return max((end for size, end in longest if size >= max(least, exponent * period)), default=0)

    for lag in range(1, SHORT + 1):
        held = words[: reach(lag)]
        if len(held) > lag:
            same = np.zeros(len(held) - lag + 2, np.int8)
            same[1:-1] = held[:-lag] == held[lag:]
            edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
            edges = edges[edges[:, 1] - edges[:, 0] + lag >= max(least, exponent * lag)]
            found.append(np.column_stack((edges[:, 0], edges[:, 1] + lag, np.full(len(edges), lag))))

    span, gram = SHORT, 1
    hashes = _mixed(words.astype(np.uint64), words.astype(np.uint64))
    while (end := reach(span + 1)) > 0:
        hashes = hashes[:end]
        while gram < 2 * span and len(hashes) > gram:
            hashes = _mixed(hashes[:-gram], hashes[gram:])
            gram *= 2
        if len(hashes) < span:
            break
        places = _minimizers(hashes, span)
        order = np.argsort(hashes[places], kind="stable")
        places = places[order]
        alike = hashes[places[1:]] == hashes[places[:-1]]
        lags = places[1:] - places[:-1]
        alike &= (lags > span) & (lags <= 2 * span)
        seeds, lags = places[:-1][alike], lags[alike]
        order = np.lexsort((seeds, lags))
        rows, reached = [], (0, 0)
        for at, lag in zip(seeds[order].tolist(), lags[order].tolist()):
            if (lag, at) < reached:
                continue  # inside the stretch of the seed before
            start, stop = _extent(words, at, lag)
            reached = (lag, stop - lag)
            if stop - start >= exponent * lag:
                rows.append((start, stop, lag))
        if rows:
            found.append(np.array(rows, np.int64))
        span *= 2

    # A stretch whose smallest period divides the lag was found at that period too.
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        new = np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))
        runs = runs[new]
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def runs_of_texts(
    texts: list[bytes], exponent: int = 4, least: int = 6
) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text the number of words, its runs as (start, length, period), and its words without repeats."""
    split = [t.split() for t in texts]  # of bytes: at space and 09 to 0D alone
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    flat = [w for i in order for w in split[i]]
    number = {w: n for n, w in enumerate(dict.fromkeys(flat))}
    sizes = np.array([len(split[i]) for i in order], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # in the block, with the words between texts
    words = np.empty(len(flat) + len(order), np.int32)
    between = starts + sizes
    inside = np.ones(len(words), bool)
    inside[between] = False
    words[inside] = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
    words[between] = -1 - np.arange(len(order))
    runs = find_runs(words, list(zip(sizes.tolist(), between.tolist())), exponent, least)

    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    dropped = np.cumsum(cover) > 0
    owners = np.searchsorted(starts, runs[:, 0], side="right") - 1
    of_text: dict[int, list[tuple[int, int, int]]] = {}
    for owner, (start, end, period) in zip(owners.tolist(), runs.tolist()):
        base = int(starts[owner])
        of_text.setdefault(owner, []).append((start - base, end - start, period))
    out: list = [None] * len(order)
    for place, i in enumerate(order):
        own = split[i]
        found = of_text.get(place, [])
        if found:
            gone = dropped[starts[place] : starts[place] + len(own)].tolist()
            own = [w for w, g in zip(own, gone) if not g]
        out[i] = (len(split[i]), found, b" ".join(own))
    return out


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """Per row doc_id, n_words, all runs by start, then period, and the text without repeated periods."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in blocks(batches):
            found = runs_of_texts(batch["text"].cast(pa.binary()).to_pylist(), exponent, least)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, run),
                    pa.array([t for _, _, t in found], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    return id_and_text(docs).mapInArrow(scanned, f"doc_id long, n_words long, runs {RUNS}, text string")
