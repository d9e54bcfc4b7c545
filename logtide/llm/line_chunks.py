"""Line deduplication by content-defined chunks.

A rolling hash over the hashes of the last WINDOW lines cuts a text where it hits one of
AVERAGE values, so the same run of lines is cut alike wherever it stands.

``drop_shared_lines`` takes chunks that reach MIN_LINES - 1 lines into the next one, so that
each MIN_LINES lines in a row lie in one chunk (``spans``). A chunk that an earlier document
holds goes whole. A passage that begins or ends within a chunk leaves it different from all
others: of chunks that stay, the lines in a row are compared, each as a digest and those that
meet again byte for byte, so that every passage is followed to its first and last line and
short ones without a cut are found too. A line goes if MIN_LINES lines over it stand in a
document of smaller doc_id, or earlier in the text without overlap; so each line that goes is
left in an earlier place. Blank lines are not part of a chunk; they go with the line before
them, those in front with the first.

``drop_repeated_lines`` takes disjoint chunks and no more, which misses most
short passages and the edges of long ones. A chunk of MIN_LINES lines or more that occurs in several documents stays in
the one with the smallest doc_id and is removed from the others; repeated within a
document, its first place stays. Chunks are grouped by digest and by all their bytes.

Chunks go to groups with a partial aggregate in front, the removals come back as
digests per document, and the join on a digest is one the engine can split when
half the corpus shares a chunk.

Cases: a null text is an empty one and stays null. Blank lines in a chunk belong to the chunk they
stand in and don't count as lines. Rows with the same doc_id count as one document,
and each loses the same chunks; rows without doc_id lose none but repeats of their own.
Two different chunks of one digest are both left alone. A text that loses all is
empty. An empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logtide.llm.texts import BLOCK_BYTES, blocks, id_and_text
from logtide.plans.common import materialize
from logtide.plans.places import likely_in

MIN_LINES = 2
MAX_LINES = 64
WINDOW = 2
AVERAGE = 4
MET_BITS = 1 << 26  # of the bitmap of digests that meet: 8 MB at most
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
_WORD = (1 << 64) - 1
Cut = Callable[[str, int], dict[bytes, str]]


def _cuts(lines: Iterable[str]) -> Iterator[bool]:
    """For each line whether the rolling hash over it and those before cuts behind it."""
    import xxhash

    gone = pow(_BASE, WINDOW, 1 << 64)
    rolled = 0
    recent: list[int] = []
    for line in lines:
        value = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"))
        recent.append(value)
        rolled = (rolled * _BASE + value) & _WORD
        if len(recent) > WINDOW:
            rolled = (rolled - recent.pop(0) * gone) & _WORD
        yield len(recent) == WINDOW and (rolled >> 32) % AVERAGE == 0


def chunks(text: str) -> list[tuple[str, int]]:
    """The text cut into chunks, each with its count of lines that hold a word."""
    lines = text.split("\n")
    filled = [i for i, line in enumerate(lines) if line and not line.isspace()]
    found: list[tuple[str, int]] = []
    start = count = 0
    for at, cut in zip(filled, _cuts(lines[i] for i in filled)):
        count += 1
        if count >= MAX_LINES or (cut and count >= MIN_LINES):
            found.append(("\n".join(lines[start : at + 1]), count))
            start, count = at + 1, 0
    if start < len(lines):
        found.append(("\n".join(lines[start:]), count))
    return found


def _digest(chunk: str) -> bytes:
    import hashlib

    return hashlib.blake2b(chunk.encode("utf-8", "replace"), digest_size=16).digest()


def _long_chunks(text: str, min_lines: int) -> dict[bytes, str]:
    return {_digest(c): c for c, n in chunks(text) if n >= min_lines}


def windows(text: str, min_lines: int = MIN_LINES) -> tuple[list[str], list[int], list[str]]:
    """The lines, the places of those that hold a word, and each min_lines of these in a row."""
    lines = text.split("\n")
    places = [i for i, line in enumerate(lines) if line and not line.isspace()]
    filled = [lines[i] for i in places]
    return lines, places, ["\n".join(filled[i : i + min_lines]) for i in range(len(filled) - min_lines + 1)]


def spans(filled: list[str], min_lines: int = MIN_LINES) -> list[tuple[int, int]]:
    """The chunks of a text's lines that hold a word, as (first, last) of the places where min_lines in a row begin.

    A chunk's text reaches min_lines - 1 lines further than its last place.
    """
    places = len(filled) - min_lines + 1
    found, start = [], 0
    for i, cut in enumerate(_cuts(filled[: max(0, places)])):
        if cut or i - start + 1 >= MAX_LINES or i == places - 1:
            found.append((start, i))
            start = i + 1
    return found


def _span_texts(filled: list[str], min_lines: int) -> list[str]:
    return ["\n".join(filled[a : b + min_lines]) for a, b in spans(filled, min_lines)]


def _filled(text: str) -> list[str]:
    return [line for line in text.split("\n") if line and not line.isspace()]


def _shared_chunks(text: str, min_lines: int) -> dict[bytes, str]:
    return {_digest(c): c for c in _span_texts(_filled(text), min_lines)}


def repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES, cut_text: Cut = _long_chunks) -> DataFrame:
    """(digest, keep_id, n_docs) of the chunks that more than one document holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.string())],
                ["doc_id", "digest", "chunk"],
            )

        for batch in blocks(batches):
            ids, digests, texts, held = [], [], [], 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for digest, chunk in cut_text(text, min_lines).items():
                    ids.append(doc)
                    digests.append(digest)
                    texts.append(chunk)
                    held += len(chunk)
                    if held > BLOCK_BYTES:
                        yield made()
                        ids, digests, texts, held = [], [], [], 0
            yield made()

    rows = id_and_text(docs).mapInArrow(cut, "doc_id long, digest binary, chunk string")
    # Groups are equal byte for byte; a digest with two of them names neither.
    same = rows.groupBy("digest", "chunk").agg(
        F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n_rows")
    ).drop("chunk")
    return same.groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"), F.max("last_id").alias("last_id"),
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("variants"),
    ).where("variants = 1 AND keep_id < last_id").select("digest", "keep_id", "n_rows")


def removals(
    docs: DataFrame, repeated: DataFrame, min_lines: int = MIN_LINES, cut_text: Cut = _long_chunks
) -> DataFrame:
    """(doc_id, digests): the chunks that each document loses to an earlier one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, digests = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found = cut_text(text, min_lines)
                ids += [doc] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"]
            )

    held = id_and_text(docs).mapInArrow(cut, "doc_id long, digest binary")
    return (
        held.join(repeated.select("digest", "keep_id"), "digest").where("doc_id > keep_id")
        .groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))
    )


def _without_chunks(text: str, lost: set[bytes], min_lines: int) -> tuple[str, int, int, int]:
    """The text that is left, its chunks, and how many of them and of their lines went."""
    seen, kept, n, removed, lines = set(), [], 0, 0, 0
    for chunk, count in chunks(text):
        n += 1
        if count >= min_lines and (chunk in seen or (lost and _digest(chunk) in lost)):
            removed += 1
            lines += count
        else:
            kept.append(chunk)
            if count >= min_lines:
                seen.add(chunk)
    return "\n".join(kept), n, removed, lines


def kept_windows(docs: DataFrame, lost: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, digest) of each min_lines lines in a row of the chunks that stay: the first document of any keeps its chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, owners, digests = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                _, _, found = windows(text, min_lines)
                filled = _filled(text)
                held = set()
                for (a, b), chunk in zip(spans(filled, min_lines), _span_texts(filled, min_lines)):
                    owner = _digest(chunk)
                    if owner not in held:
                        held.add(owner)
                        ids += [doc] * (b - a + 1)
                        owners += [owner] * (b - a + 1)
                        digests += map(_digest, found[a : b + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(owners, pa.binary()), pa.array(digests, pa.binary())],
                ["doc_id", "chunk", "digest"],
            )

    rows = id_and_text(docs).mapInArrow(cut, "doc_id long, chunk binary, digest binary")
    gone = lost.select("doc_id", F.explode("digests").alias("chunk")).hint("merge")
    return rows.join(gone, ["doc_id", "chunk"], "left_anti").select("doc_id", "digest")


def shared_windows(docs: DataFrame, kept: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(digest, keep_id) of the lines in a row that several documents hold, equal byte for byte."""
    met = materialize(
        kept.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last_id"))
        .where("keep_id < last_id").select("digest", "keep_id"), "met-windows",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = {w for text in batch["text"].to_pylist() for w in windows(text, min_lines)[2]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(_digest, found)), pa.binary()), pa.array(list(found), pa.string())], ["digest", "lines"]
            )

    # Only texts of digests that have met move.
    texts = likely_in(id_and_text(docs).mapInArrow(cut, "digest binary, lines string"), met, ["digest"], MET_BITS)
    variants = texts.groupBy("digest", "lines").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.count(F.lit(1)).alias("variants")
    )
    # A digest with two texts names neither.
    return met.join(variants.where("variants = 1").hint("merge"), "digest").select("digest", "keep_id")


def _without_shared(text: str, lost: set[bytes], min_lines: int) -> tuple[str, int, int, int]:
    """The text that is left, its chunks, and how many of them and of all lines went whole."""
    lines, places, found = windows(text, min_lines)
    filled = [lines[i] for i in places]
    first: dict[str, int] = {}
    gone: set[int] = set()
    cut = spans(filled, min_lines)
    if lost:
        for (a, b), chunk in zip(cut, _span_texts(filled, min_lines)):
            if _digest(chunk) in lost:
                gone.update(range(a, b + min_lines))
    for i, window in enumerate(found):
        if first.setdefault(window, i) <= i - min_lines or (lost and _digest(window) in lost):
            gone.update(range(i, i + min_lines))
    if not gone:
        return text, len(cut), 0, 0
    removed = sum(gone.issuperset(range(a, b + min_lines)) for a, b in cut)
    ends = [*places[1:], len(lines)]
    starts = [0, *places[1:]]
    kept = [line for i in range(len(places)) if i not in gone for line in lines[starts[i] : ends[i]]]
    return "\n".join(kept), len(cut), removed, len(gone)


def drop_shared_lines(docs: DataFrame, min_lines: int = MIN_LINES, report: bool = False) -> DataFrame:
    """docs without the lines that stand in an earlier place; ``report`` as below."""
    lost = _lost_chunks(docs, min_lines, _shared_chunks)
    kept = materialize(kept_windows(docs, lost, min_lines), "kept-windows")
    shared = shared_windows(docs, kept, min_lines).hint("merge")
    edges = kept.join(shared, "digest").where("doc_id > keep_id").select("doc_id", "digest")
    # Digests of chunks and of lines in a row are of one kind: a chunk of min_lines lines is both.
    gone = lost.select("doc_id", F.explode("digests").alias("digest")).union(edges)
    digests = materialize(gone.groupBy("doc_id").agg(F.collect_set("digest").alias("digests")), "lost-lines")
    return _dropped(docs, min_lines, report, digests, _without_shared)


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, report: bool = False) -> DataFrame:
    """docs with the text that is left; ``report`` adds n_chunks, n_removed and n_lines_removed."""
    return _dropped(docs, min_lines, report, _lost_chunks(docs, min_lines, _long_chunks), _without_chunks)


def _lost_chunks(docs: DataFrame, min_lines: int, cut_text: Cut) -> DataFrame:
    repeated = materialize(repeated_chunks(docs, min_lines, cut_text), "repeated-chunks")
    return materialize(removals(docs, repeated, min_lines, cut_text), "removals")


def _dropped(
    docs: DataFrame, min_lines: int, report: bool, lost: DataFrame,
    without: Callable[[str, set[bytes], int], tuple[str, int, int, int]],
) -> DataFrame:
    # The removals grow with the corpus: one plan at every size, not a broadcast while they are few.
    keyed = lost.select(F.col("doc_id").alias("_lost_id"), "digests").hint("merge")
    # Columns of docs travel as one struct, so that none of their names meets one used here.
    named = docs.select(F.struct(F.col("*")).alias("_doc"))
    joined = named.join(keyed, F.col("_doc.doc_id").cast("long") == F.col("_lost_id"), "left")

    @F.pandas_udf("text string, n_chunks long, n_removed long, n_lines_removed long")
    def left(texts, digests):
        import pandas as pd

        out = []
        for text, gone in zip(texts, digests):
            if text is None:
                out.append((None, 0, 0, 0))
                continue
            out.append(without(text, set(gone if gone is not None else ()), min_lines))
        return pd.DataFrame(out, columns=["text", "n_chunks", "n_removed", "n_lines_removed"])

    cut = joined.withColumn("_cut", left("_doc.text", "digests"))
    others = [F.col("_cut.text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]
    counts = [F.col("_cut")[c].alias(c) for c in ("n_chunks", "n_removed", "n_lines_removed")]
    return cut.select(*others, *(counts if report else []))
