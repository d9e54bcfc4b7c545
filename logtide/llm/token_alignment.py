"""Alignment of the tokens of two vocabularies over the same texts.

Byte places where tokens of both vocabularies end cut a text into groups, and the two
tokens that end at such a place are linked. How often each pair is linked is counted over
all texts. Most groups are one token of either side with the same bytes. For these an
array from A ids to B ids of the same bytes is made beforehand; a task counts them in one
vector as long as vocabulary A, and these vectors are added up. Only the other links, the
irregular ones, are shuffled as pairs.

A text is read in segments that begin at the spaces in front of a word, at a line end
between two visible characters, and at a mark behind a Latin letter, if no piece of B joins
the two. No token of either side reaches across their borders: pieces of B have spaces
at their beginning only and no line ends, and A's pattern starts anew at the last space of a
run, unless other white space stands before it and more behind (such texts are read as one
segment). A distinct segment is encoded and aligned once and remembered by the Python
worker, in arrays; only its own text and its place in them are Python objects. Long ones are
not remembered.

Counts come back to the texts without a shuffle for regular links and the ``HOT`` most
frequent irregular pairs (arrays of a size that does not grow with the data) and by a
join for the others, where no pair can hold more than one HOT-th of the links.

Cases: a text that is null or empty, or that the tokens of either side don't spell byte
for byte, has no tokens: zeros and an empty string of groups. Strings of special tokens
are plain text. Texts are read whole. Rows that repeat a doc_id, or have none, are aligned
one by one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from logtide.llm.texts import blocks, byte_letters, id_and_text, tokenizer_path, worker_kept
from logtide.plans.common import materialize

KEPT_SEGMENTS = 400_000  # distinct segments that a Python worker remembers, beside those of a block
LONG = 256  # letters of a segment; longer ones are not remembered
AT_ONCE = 5000  # segments that are encoded in one call
MARKS = ".,;:!?"
LATIN = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
TEXT_BYTES = 1 << 20  # texts aligned together
HOT = 65_536  # irregular pairs whose counts every task holds
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, groups string, regular array<int>, irregular array<long>, "
    "vector array<long>"
)
Segment = tuple[int, int, str, bytes, bytes]
# Token numbers (-1 if a side spells other bytes), groups, regular A ids and irregular links of a segment or text.
SEGMENTS = pa.schema([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("regular", pa.list_(pa.int32())),
    ("irregular", pa.list_(pa.int64())),
])
NONE = pa.RecordBatch.from_pylist([], schema=SEGMENTS)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between each bound and the next."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _ends(spelled: pa.Array) -> np.ndarray:
    """Where each of the strings, which are not cut from others, ends in their bytes."""
    return np.frombuffer(spelled.buffers()[1], np.int32)[1 : len(spelled) + 1].astype(np.int64)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)


class Aligner:
    """Aligns texts under a byte-level vocabulary file A and a sentencepiece model B."""

    def __init__(self, path_a: str, path_b: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        bytes_a = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        piece = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(piece)
        ]
        self.space = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") for p in piece):
            raise ValueError("a piece of B has a space behind its first letter")
        # Of several B ids with the same bytes, the one that is a piece and not a byte.
        same = {self.bytes_b[i]: i for i in range(size) if self.b.is_byte(i)}
        same |= {self.bytes_b[i]: i for i in range(size) if not (
            self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)
        )}
        self.identity = np.full(max(bytes_a) + 1, -1, np.int64)
        for i, spelled in bytes_a.items():
            self.identity[i] = same.get(spelled, -1)
        self.spelled = (
            pa.array([bytes_a.get(i, b"") for i in range(len(self.identity))], pa.binary()),
            pa.array(self.bytes_b, pa.binary()),
        )
        self.names = pa.array(list(map(str, range(max(len(self.identity), size)))), pa.string())
        whole = [p for i, p in enumerate(piece) if not self.b.is_byte(i)]
        if any("\n" in p for p in whole):
            raise ValueError("a piece of B has a line end")
        joined = {x for p in whole for x, y in zip(p, p[1:]) if y in MARKS}
        if "a" in joined:
            raise ValueError("a piece of B joins a mark to the letter a")
        letters = "".join(c for c in LATIN if c not in joined)
        # What a segment begins with, then anything up to a space, a mark behind a letter, or a line end between visible
        # characters. Spaces at the end of a text are a segment of their own.
        self.segments = re.compile(rf"(?: +|\n|[{MARKS}])(?:[^ \n{MARKS}]+|(?<![{letters}])[{MARKS}]|(?<!\S)\n|\n(?!\S))*")
        self.wide = re.compile(r"[^\S ] (?!\S)")
        self.newer: dict[str, int] = {}  # the rows of segments
        self.older: dict[str, int] = {}
        self.newer_rows = self.older_rows = NONE

    def aligned(self, parts: list[str], a: list[list[int]], b: list[list[int]]) -> pa.RecordBatch:
        """A row per part. The parts are laid end to end, so that all are compared at once."""
        spelled = pa.array(parts, pa.string())
        ends = _ends(spelled)
        whole = np.frombuffer(spelled.buffers()[2], np.uint8)[: ends[-1]]
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        a_last, b_last = np.cumsum(n_a), np.cumsum(n_b)
        a_ids = np.fromiter(itertools.chain.from_iterable(a), np.int64, int(a_last[-1]))
        b_ids = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(b_last[-1]))
        equal = bool(n_a.all() and n_b.all())
        token_ends = []
        for ids, last, vocabulary in ((a_ids, a_last, self.spelled[0]), (b_ids, b_last, self.spelled[1])):
            tokens = vocabulary.take(pa.array(ids))
            own = _ends(tokens)
            token_ends.append(own)
            equal = equal and own[-1] == ends[-1] and np.array_equal(own[last - 1], ends) and np.array_equal(
                np.frombuffer(tokens.buffers()[2], np.uint8)[: own[-1]], whole
            )
        if not equal:
            if len(parts) == 1:
                return pa.RecordBatch.from_pylist(
                    [{"n_a": -1, "n_b": -1, "groups": "", "regular": [], "irregular": []}], schema=SEGMENTS
                )
            half = len(parts) // 2
            return pa.concat_batches([self.aligned(parts[c], a[c], b[c]) for c in (slice(half), slice(half, None))])
        a_ends, b_ends = token_ends
        j = np.searchsorted(b_ends, a_ends)
        i = np.flatnonzero(b_ends[j] == a_ends)
        j = j[i]
        at_a, at_b = a_ids[i], b_ids[j]
        plain = (np.diff(i, prepend=-1) == 1) & (np.diff(j, prepend=-1) == 1) & (self.identity[at_a] == at_b)
        groups = pc.binary_join_element_wise(*[
            pc.binary_join(_lists(self.names.take(pa.array(ids)), last + 1), ",") for ids, last in ((a_ids, i), (b_ids, j))
        ], "|")
        last = np.searchsorted(i, a_last - 1) + 1  # the group behind each part's last
        seen = np.concatenate(([0], np.cumsum(plain)))[last]
        return pa.RecordBatch.from_arrays([
            pa.array(n_a), pa.array(n_b), pc.binary_join(_lists(groups, last), ";"),
            _lists(pa.array(at_a[plain], pa.int32()), seen),
            _lists(pa.array(at_a[~plain] << 32 | at_b[~plain], pa.int64()), last - seen),
        ], schema=SEGMENTS)

    def _align(self, parts: list[str]) -> Iterator[pa.RecordBatch]:
        """Segments and whole texts, some at a time. B adds a space in front, which stands for that of a word; in front of
        a line end it is a token by itself, and marks get a letter that they don't join."""
        for at in range(0, len(parts), AT_ONCE):
            some = parts[at : at + AT_ONCE]
            a = self.a.encode_batch_fast(some, add_special_tokens=False)
            b = self.b.encode([p[1:] if p[0] == " " else p if p[0] == "\n" else "a" + p for p in some], num_threads=1)
            b = [y[1:] if p[0] != " " else y if len(p) > 1 else [self.space] for p, y in zip(some, b)]
            yield self.aligned(some, [x.ids for x in a], b)

    def _remember(self, parts: list[str]) -> np.ndarray:
        """The rows of segments in the newer half of the memory; what a whole half did not ask for is forgotten."""
        at = np.fromiter(map(self.newer.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        if len(self.newer) + len({parts[n] for n in missing.tolist()}) > KEPT_SEGMENTS // 2:
            self.older, self.older_rows = self.newer, self.newer_rows
            self.newer, self.newer_rows = {}, NONE
            missing = np.arange(len(parts))
        asked = [parts[n] for n in missing.tolist()]
        wanted = dict.fromkeys(asked)
        known = [p for p in wanted if p in self.older]
        new = [p for p in wanted if p not in self.older]
        again = self.older_rows.take(pa.array([self.older[p] for p in known], pa.int64()))
        self.newer_rows = pa.concat_batches([self.newer_rows, again, *self._align(new)])
        self.newer.update(zip(known + new, range(len(self.newer), self.newer_rows.num_rows)))
        at[missing] = np.fromiter(map(self.newer.__getitem__, asked), np.int64, len(asked))
        return at

    def arrays(self, texts: list[str]) -> pa.RecordBatch:
        """A row per text; zeros and nothing for an empty text and one that isn't spelled byte for byte."""
        find, wide = self.segments.findall, self.wide.search
        split = [[] if not t else [" " + t] if wide(" " + t) else find(" " + t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        parts = list(itertools.chain.from_iterable(split))
        del split
        long = np.fromiter(map(len, parts), np.int64, len(parts)) > LONG
        at = np.zeros(len(parts), np.int64)
        if long.any():
            apart = np.flatnonzero(long)
            at[~long] = self._remember([parts[n] for n in np.flatnonzero(~long).tolist()])
            at[apart] = self.newer_rows.num_rows + np.arange(len(apart))
            rows = pa.concat_batches([self.newer_rows, *self._align([parts[n] for n in apart.tolist()])])
        else:
            at = self._remember(parts)
            rows = self.newer_rows
        bounds = np.concatenate(([0], np.cumsum(counts)))
        failed = _sums(rows["n_a"].to_numpy()[at] < 0, bounds) > 0
        if failed.any():
            at, counts = at[~np.repeat(failed, counts)], np.where(failed, 0, counts)
            bounds = np.concatenate(([0], np.cumsum(counts)))
        rows = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([
            pa.array(_sums(rows["n_a"].to_numpy(), bounds)), pa.array(_sums(rows["n_b"].to_numpy(), bounds)),
            pc.binary_join(_lists(rows["groups"], bounds[1:]), ";"),
            *[_lists(rows[c].values, rows[c].offsets.to_numpy()[bounds[1:]]) for c in ("regular", "irregular")],
        ], schema=SEGMENTS)

    def __call__(self, texts: list[str]) -> list[list[Segment]]:
        """Per text what ``arrays`` has, numbers as little-endian bytes; none for an empty text and one that isn't
        spelled byte for byte."""
        found = self.arrays(texts)
        return [
            [(n_a, n_b, groups, np.array(regular, "<i4").tobytes(), np.array(irregular, "<i8").tobytes())] if n_a else []
            for n_a, n_b, groups, regular, irregular in zip(*[c.to_pylist() for c in found.columns])
        ]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document row, doc_id, token numbers, groups and links; beside them a row per task with its vector of
    regular links (doc columns null)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        schema = pa.schema([
            ("row", pa.int64()), ("doc_id", pa.int64()), *SEGMENTS, ("vector", pa.list_(pa.int64())),
        ])
        row = TaskContext.get().partitionId() << 33
        vector = np.zeros(len(aligner.identity), np.int64)
        for batch in blocks(batches, TEXT_BYTES):
            found = aligner.arrays(batch["text"].to_pylist())
            vector += np.bincount(found["regular"].values.to_numpy(), minlength=len(vector))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + found.num_rows), pa.int64()), batch["doc_id"], *found.columns,
                    pa.nulls(found.num_rows, pa.list_(pa.int64())),
                ],
                schema=schema,
            )
            row += found.num_rows
            pa.default_memory_pool().release_unused()  # else workers keep all that any block needed
        if vector.any():
            yield pa.RecordBatch.from_pylist([{"vector": vector.tolist()}], schema=schema)

    return id_and_text(docs).mapInArrow(scanned, ALIGNED)


def _added(vectors: DataFrame) -> DataFrame:
    """(a, n): the vectors of all tasks added up, first within a partition."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for vector in batch["vector"]:
                one = vector.values.to_numpy(zero_copy_only=False)
                total = one.copy() if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["a", "n"])

    return vectors.mapInArrow(added, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def link_counts(aligned: DataFrame, identity: np.ndarray) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(code, n) of irregular pairs, written; the vector of regular ones; (b, best) per B id."""
    regular = np.zeros(len(identity), np.int64)
    vectors = aligned.where(F.col("vector").isNotNull()).select("vector")
    for a, n in _added(vectors).collect():  # at most as many as A has ids
        regular[a] = n
    irregular = materialize(
        aligned.select(F.explode("irregular").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "pairs"
    )
    best = irregular.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("best"))
    return irregular, regular, best


def alignments(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    groups: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``: the ids of each group as
    ``a1,a2|b1;a3|b2``, or what the function ``groups`` makes of this text before it is written.

    n_best counts the links whose pair is the most frequent one of its B id (ties
    included), count_sum adds up the counts of the pairs of all links.
    """
    path_a = path_a or tokenizer_path("byte_bpe_50k.json")
    path_b = path_b or tokenizer_path("piece_bpe_32k.model")
    aligner = Aligner(path_a, path_b)
    identity = aligner.identity
    found = align(docs, path_a, path_b).withColumn("groups", groups(F.col("groups")))
    aligned = materialize(found, "aligned")
    pairs, regular, best_of = link_counts(aligned, identity)
    best = np.zeros(len(aligner.bytes_b), np.int64)
    np.maximum.at(best, identity[regular > 0], regular[regular > 0])
    for b, n in best_of.collect():  # at most as many as B has ids
        best[b] = max(best[b], n)
    regular_best = (regular > 0) & (regular == best[np.maximum(identity, 0)])
    # The most frequent pairs; a full tie at the end makes no difference, as the others are joined.
    hot = pairs.orderBy(F.desc("n"), "code").limit(HOT).toPandas().sort_values("code")
    hot_code, hot_n = hot["code"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            lists, others = batch["regular"], batch["irregular"]
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            n_best, total = _sums(regular_best[ids], bounds - bounds[0]), _sums(regular[ids], bounds - bounds[0])
            bounds = others.offsets.to_numpy().astype(np.int64) - others.offsets[0].as_py()
            codes = others.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(hot_code, codes), max(len(hot_code) - 1, 0))
            known = hot_code[at] == codes if len(hot_code) else np.zeros(len(codes), bool)
            n = np.where(known, hot_n[at], 0) if len(hot_code) else np.zeros(len(codes), np.int64)
            n_best += _sums(known & (n == best[codes & 0xFFFFFFFF]) if len(codes) else known, bounds)
            total += _sums(n, bounds)
            left = np.concatenate(([0], np.cumsum(~known)))[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"], pa.array(np.diff(lists.offsets) + np.diff(others.offsets), pa.int64()),
                    pa.array(n_best, pa.int64()), pa.array(total, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(codes[~known], pa.int64())),
                ],
                ["row", "n_groups", "n_best", "count_sum", "rest"],
            )
            pa.default_memory_pool().release_unused()

    texts = aligned.where(F.col("row").isNotNull())
    near = materialize(
        texts.select("row", "regular", "irregular").mapInArrow(
            counted, "row long, n_groups long, n_best long, count_sum long, rest array<long>"
        ), "counted",
    )
    # Of B ids at most as many rows as B has.
    tops = F.broadcast(best_of.sparkSession.createDataFrame(
        [(int(b), int(best[b])) for b in np.flatnonzero(best)], "b long, best long"
    ))
    rest = (
        near.select("row", F.explode("rest").alias("code"))
        .join(pairs, "code")
        .withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)).join(tops, "b")
        .groupBy("row").agg(
            F.sum((F.col("n") == F.col("best")).cast("long")).alias("more_best"), F.sum("n").alias("more_sum")
        )
    )
    none = F.lit(0).cast("long")
    return (
        texts.select("row", "doc_id", "n_a", "n_b", "groups")
        .join(near.select("row", "n_groups", "n_best", "count_sum"), "row")
        .join(rest, "row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
            (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"), "groups",
        )
    )
