"""Katz backoff language model: counted, normalised and evaluated over blocks of texts.

P(w | h) of order k is d(c) c(hw) / C(h) for an n-gram hw met in training, with
Good-Turing discounts d(c) for counts up to ``MAX_DISCOUNTED``, and a(h) P(w | h without
its first word) otherwise. a(h) is the weight that makes the sum over all words and the
unknown one 1: what the discounts leave, divided by 1 less the sum of the lower order's
probabilities of the words met behind h, which are added up word by word. The lowest
order gives what the discounts leave to the unknown word.

A block is some millions of tokens; its texts are written once as numbers of the block's
own words. One level after another, the block sends its distinct n-grams of that level,
each once with its count in training and its probability by the level below, to the part
that owns the n-gram's history. A part adds up the counts, keeps them as its share of the
level's table, and answers every block with the totals of its n-grams and, per history,
what the weight needs. So counts, weights and the scores of all texts need two shuffles of
distinct n-grams a level and none of tokens by n-gram. An n-gram's number within its level
is its rank by count within its part, times the parts, plus the part: small for frequent
ones. It is the history of the next level.

A history with over a quarter of a part's share of the tokens is spread over all parts by
word; their sums for it are added up apart. There can be no more than four such histories
a part, so what is known of them goes to all tasks.

Where a level's counts of counts don't give discounts between 0 and 1 (small tables),
half a count is taken off each count up to MAX_DISCOUNTED. A history that no discount
touches gets one count more in its total, so that something is left for other words.

Words are numbered by their 64-bit XXH64, so two words are one with a chance of about
V^2 / 2^65. Every text ends with an end token, which also stands before its first word.

Cases: a null text is an empty one: one token, the end. Rows without an id are training
rows. Rows that repeat a doc_id are texts of their own. Without training rows every token
is unknown, with probability 1. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from logtide.llm.texts import blocks, id_and_text
from logtide.plans.common import materialize

MAX_DISCOUNTED = 5
BLOCK_TOKENS = 2_000_000
PART_TOKENS = 2_000_000
STATE = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, tokens binary"
TYPES = "part int, block long, size long, h binary, w binary, n binary, p binary"
ANSWERS = (
    "level int, part int, block long, size long, h binary, w binary, n binary, ids binary, histories long, "
    "totals binary, sums binary, counts array<long>, tokens long, types long, hot array<long>, hot_h array<long>, "
    "hot_totals array<array<long>>, hot_sums array<double>"
)
LIST = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(ddl: str) -> pa.Schema:
    fields = []
    for field in ddl.split(", "):
        name, kind = field.split(" ")
        depth = kind.count("array<")
        type_ = LIST[kind.replace("array<", "").rstrip(">")]
        for _ in range(depth):
            type_ = pa.list_(type_)
        fields.append((name, type_))
    return pa.schema(fields)


def packed(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, compressed: high bytes that are alike take next to nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, size * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def packed_few(values: np.ndarray) -> bytes:
    """Probabilities as places in the list of distinct ones, where that is short: unigrams have one per count."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) >= len(values) // 4:
        return np.zeros(2, "<i8").tobytes() + packed(values)
    listed = packed(distinct)
    return np.array([len(distinct), len(listed)], "<i8").tobytes() + listed + packed(at)


def unpacked_few(data: bytes, size: int) -> np.ndarray:
    count, length = np.frombuffer(data[:16], "<i8").tolist()
    if not count:
        return unpacked(data[16:], size, np.float64)
    return unpacked(data[16 : 16 + length], count, np.float64)[unpacked(data[16 + length :], size)]


def _steps(h: np.ndarray, w: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted pairs as differences: of h to the h before, of w to the w before under the same h."""
    same = np.concatenate(([False], h[1:] == h[:-1]))
    before = np.concatenate(([0], w[:-1]))
    return packed(np.diff(h, prepend=0)), packed(w - np.where(same, before, 0))


def _unstepped(h: bytes, w: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    steps = unpacked(h, size)
    total = np.cumsum(unpacked(w, size))
    first = steps != 0
    first[:1] = True
    at = np.flatnonzero(first)
    base = np.concatenate(([0], total[at[1:] - 1]))
    return np.cumsum(steps), total - np.repeat(base, np.diff(np.append(at, size)))


def _hash(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def parts_of(h: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns each n-gram: by its history, by its word too under a hot history."""
    at = _hash(h)
    spread = np.isin(h, hot)
    at[spread] = _hash(at[spread].view(np.int64) ^ w[spread])
    return (at % np.uint64(parts)).astype(np.int64)


def discounts(counts: list[int]) -> np.ndarray:
    """d(r) for r from 0 to MAX_DISCOUNTED + 1 from the numbers of n-grams met r times; the last stands for all
    larger counts."""
    k = MAX_DISCOUNTED
    found = np.ones(k + 2)
    n = [0, *counts]
    if n[1]:
        most = (k + 1) * n[k + 1] / n[1]
        if most < 1 and all(n[1 : k + 1]):
            found[1 : k + 1] = [((r + 1) * n[r + 1] / (r * n[r]) - most) / (1 - most) for r in range(1, k + 1)]
    if not ((found[1 : k + 1] > 0) & (found[1 : k + 1] < 1)).all():
        found[1 : k + 1] = [(r - 0.5) / r for r in range(1, k + 1)]
    return found


def probabilities(
    c: np.ndarray, total: np.ndarray, few: np.ndarray, seen: np.ndarray, lower: np.ndarray, d: np.ndarray
) -> np.ndarray:
    """P of n-grams with count c, by their history's total, counts of counts and sum of lower probabilities."""
    left = few @ (np.arange(1, MAX_DISCOUNTED + 1) * (1 - d[1:-1]))
    whole = np.where(left > 0, total, total + 1)
    left = np.where(left > 0, left, 1)
    backed = np.where(total > 0, left / whole / (1 - seen) * lower, lower)
    return np.where(c > 0, d[np.minimum(c, MAX_DISCOUNTED + 1)] * c / whole, backed)


def block_table(docs: DataFrame, folds: int, fold: int, block_tokens: int) -> DataFrame:
    """A row per block: ids, fold and size of its texts, its words' hashes, its tokens as numbers of these words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        block = TaskContext.get().partitionId() << 33
        words: dict[bytes, int] = {b"": 0}  # the end token
        ids: list[int | None] = []
        sizes: list[int] = []
        tokens: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            joined = np.concatenate(tokens)
            order = np.argsort(-np.bincount(joined, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))[order].view(np.int64)
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids]
            return pa.RecordBatch.from_pylist(
                [{
                    "block": block, "doc_ids": ids, "held": held, "sizes": sizes, "words": hashes.tobytes(),
                    "tokens": packed(rank[joined]),
                }], schema=_schema(STATE),
            )

        for batch in blocks(batches):
            split = [t.lower().split() for t in batch["text"].cast(pa.binary()).to_pylist()]
            for own in split:
                own.append(b"")
            flat = [w for own in split for w in own]
            for w in set(flat).difference(words):
                words[w] = len(words)
            tokens.append(np.fromiter(map(words.__getitem__, flat), np.int64, len(flat)))
            ids += batch["doc_id"].to_pylist()
            sizes += map(len, split)
            if sum(map(len, tokens)) >= block_tokens:
                yield row()
                block, words, ids, sizes, tokens = block + 1, {b"": 0}, [], [], []
        if tokens:
            yield row()

    return id_and_text(docs).mapInArrow(cut, STATE)


class Block:
    """The tokens of a block, and their n-grams level by level."""

    def __init__(self, state: dict):
        self.block = state["block"]
        self.doc_ids, self.sizes = state["doc_ids"], np.array(state["sizes"], np.int64)
        self.held = np.array([bool(x) for x in state["held"]])
        self.tokens = unpacked(state["tokens"], int(self.sizes.sum()))
        self.training = np.repeat(~self.held, self.sizes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))  # place of each text's first token
        self.level = 1
        # N-grams of the level, sorted by history and word: their ids, and the one at each token.
        self.w = np.frombuffer(state["words"], np.int64)
        order = np.argsort(self.w, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.end = int(rank[self.tokens[-1]])
        self.w = self.w[order]
        self.h = np.zeros(len(self.w), np.int64)
        self.at = rank[self.tokens]
        self.lower = np.zeros(len(self.w))

    def own_counts(self) -> np.ndarray:
        return np.bincount(self.at[self.training], minlength=len(self.w))

    def divided(self, hot: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each part the places of its n-grams."""
        owner = parts_of(self.h, self.w, hot, parts)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(parts + 1))
        for part in range(parts):
            if bounds[part] < bounds[part + 1]:
                yield part, order[bounds[part] : bounds[part + 1]]

    def sent(self, hot: np.ndarray, parts: int) -> pa.Table:
        n, rows = self.own_counts(), []
        for part, own in self.divided(hot, parts):
            h, w = _steps(self.h[own], self.w[own])
            rows.append({
                "part": part, "block": self.block, "size": len(own), "h": h, "w": w, "n": packed(n[own]),
                "p": packed_few(self.lower[own]),
            })
        return pa.Table.from_pylist(rows, schema=_schema(TYPES))

    def answered(self, answers: dict[int, dict], known: dict) -> None:
        """Take in the parts' totals: ids, counts and probabilities of this level's n-grams."""
        size, k = len(self.w), MAX_DISCOUNTED
        self.c, self.ids = np.zeros(size, np.int64), np.zeros(size, np.int64)
        totals, seen = np.zeros((size, k + 1), np.int64), np.zeros(size)
        hot = known["hot"]
        for part, own in self.divided(hot, known["parts"]):
            answer = answers[part]
            self.c[own] = unpacked(answer["n"], len(own))
            if answer["ids"]:
                self.ids[own] = unpacked(answer["ids"], len(own))
            cold = own[~np.isin(self.h[own], hot)]
            if len(cold):
                new = np.concatenate(([True], self.h[cold][1:] != self.h[cold][:-1]))
                which, histories = np.cumsum(new) - 1, answer["histories"]
                totals[cold] = unpacked(answer["totals"], histories * (k + 1)).reshape(k + 1, -1).T[which]
                seen[cold] = unpacked(answer["sums"], histories, np.float64)[which]
        warm = np.flatnonzero(np.isin(self.h, hot))
        if len(warm):
            at = np.searchsorted(hot, self.h[warm])
            totals[warm], seen[warm] = known["hot_totals"][at], known["hot_sums"][at]
        lower = np.ones(size) if self.level == 1 else self.lower
        self.p = probabilities(
            self.c, totals[:, 0], totals[:, 1:], np.zeros(size) if self.level == 1 else seen, lower, known["d"]
        )

    def next_level(self) -> None:
        """N-grams one word longer; their histories are those of this level at the token before."""
        if self.level == 1:
            self.word_ids, self.word_at, self.counts = self.ids, self.at, self.c
            self.by_word = np.argsort(self.word_ids, kind="stable")
            self.word_rank = np.empty(len(self.by_word), np.int64)
            self.word_rank[self.by_word] = np.arange(len(self.by_word))
        order = np.argsort(self.ids, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        before = np.concatenate(([0], rank[self.at[:-1]] + 1))
        # Before a text stands the end token; longer histories than that are one by themselves.
        before[self.first] = rank[self.end] + 1 if self.level == 1 else 0
        codes, first, at = np.unique(
            before * len(self.word_ids) + self.word_rank[self.word_at], return_index=True, return_inverse=True
        )
        history = codes // len(self.word_ids)
        self.h = np.concatenate(([-1], self.ids[order]))[history]
        self.w = self.word_ids[self.by_word[codes % len(self.word_ids)]]
        self.lower = self.p[self.at[first]]
        self.at = at
        self.level += 1

    def through(self, answers: pa.Table, known: list[dict]) -> None:
        """Up to the last level that has been answered."""
        of: dict[int, dict[int, dict]] = {}
        for row in answers.to_pylist():
            of.setdefault(row["level"], {})[row["part"]] = row
        for level, what in enumerate(known, 1):
            if level > 1:
                self.next_level()
            self.answered(of[level], what)


def merge(level: int, hot: np.ndarray, parts: int, last: bool, often: float):
    """The function that adds up one part's n-grams and answers the blocks."""
    k, schema = MAX_DISCOUNTED, _schema(ANSWERS)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        part, rows = key[0].as_py(), rows.to_pylist()
        hs, ws = zip(*[_unstepped(r["h"], r["w"], r["size"]) for r in rows])
        h, w = np.concatenate(hs), np.concatenate(ws)
        n = np.concatenate([unpacked(r["n"], r["size"]) for r in rows])
        p = np.concatenate([unpacked_few(r["p"], r["size"]) for r in rows])
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        starts = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        h, w, c, p = h[starts], w[starts], np.add.reduceat(n[order], starts), p[order][starts]
        ids = np.empty(len(c), np.int64)
        ids[np.argsort(-c, kind="stable")] = np.arange(len(c)) * parts + part
        begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        totals = np.stack(
            [np.add.reduceat(c, begins), *[np.add.reduceat((c == r).astype(np.int64), begins) for r in range(1, k + 1)]]
        )
        sums = np.add.reduceat(np.where(c > 0, p, 0.0), begins)
        history = np.cumsum(np.concatenate(([False], h[1:] != h[:-1])))
        spread = np.isin(h[begins], hot)
        out, at = [], 0
        for r in rows:
            own = which[at : at + r["size"]]
            at += r["size"]
            asked = history[own]
            asked = asked[np.concatenate(([True], asked[1:] != asked[:-1]))]
            asked = asked[~spread[asked]]
            out.append({
                "level": level, "part": part, "block": r["block"], "size": r["size"], "n": packed(c[own]),
                "ids": None if last else packed(ids[own]), "histories": len(asked),
                "totals": packed(totals[:, asked].ravel()), "sums": packed(sums[asked]),
            })
        met = c > 0
        steps = _steps(h[met], w[met])
        out.append({
            "level": level, "part": part, "block": -1, "size": int(met.sum()), "h": steps[0], "w": steps[1],
            "n": packed(c[met]), "ids": None if last else packed(ids[met]),
            "counts": [int((c == r).sum()) for r in range(1, k + 2)], "tokens": int(c.sum()), "types": int(met.sum()),
            "hot": [] if last else ids[c > often].tolist(), "hot_h": h[begins][spread].tolist(),
            "hot_totals": totals[:, spread].T.tolist(), "hot_sums": sums[spread].tolist(),
        })
        return pa.Table.from_pylist(out, schema=schema)

    return merged


def _learned(answers: DataFrame, hot: np.ndarray, parts: int) -> dict:
    """What all tasks need of a level: discounts, totals, and the sums of hot histories (four a part at most)."""
    tables = answers.where("block = -1")
    k = MAX_DISCOUNTED
    row = tables.agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types"),
        *[F.sum(F.col("counts")[r]).alias(f"n{r}") for r in range(k + 1)],
    ).first()
    sums = tables.select(F.explode(F.arrays_zip("hot_h", "hot_totals", "hot_sums")).alias("x")).groupBy(
        F.col("x.hot_h").alias("h")
    ).agg(*[F.sum(F.col("x.hot_totals")[i]) for i in range(k + 1)], F.sum("x.hot_sums")).collect()
    totals, seen = np.zeros((len(hot), k + 1), np.int64), np.zeros(len(hot))
    for r in sums:
        at = int(np.searchsorted(hot, r[0]))
        totals[at], seen[at] = r[1 : k + 2], r[k + 2]
    often = [r[0] for r in tables.select(F.explode("hot")).collect()]
    return {
        "hot": hot, "parts": parts, "hot_totals": totals, "hot_sums": seen, "tokens": row["tokens"] or 0,
        "types": row["types"] or 0, "d": discounts([row[f"n{r}"] or 0 for r in range(k + 1)]),
        "often": np.array(sorted(often), np.int64),
    }


def katz_scores(
    docs: DataFrame, order: int = 2, folds: int = 5, fold: int = 1, block_tokens: int = BLOCK_TOKENS,
    part_tokens: int = PART_TOKENS, tables: list[DataFrame] | None = None,
) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod ``folds`` is not ``fold`` and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, train_types, base_score (add a
    half, unigrams) and score (log10). ``tables``, if given, receives the written table of each
    level, one row per part: n-grams as (h, w, n), read with ``ngrams``.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    state = materialize(block_table(docs, folds, fold, block_tokens), "blocks")
    size = state.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-size // part_tokens))
    known: list[dict] = []
    answers: DataFrame | None = None
    hot = np.zeros(1, np.int64)  # the one history of the first level
    for level in range(1, order + 1):
        if answers is None:

            def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        yield from Block(row).sent(hot, parts).to_batches()

            sent = state.mapInArrow(first, TYPES)
        else:

            def longer(rows: pa.Table, found: pa.Table) -> pa.Table:
                block = Block(rows.to_pylist()[0])
                block.through(found, known)
                block.next_level()
                return block.sent(hot, parts)

            sent = _with_answers(state, answers, longer, TYPES)
        part = merge(level, hot, parts, level == order, size / (4 * parts))
        met = materialize(sent.groupBy("part").applyInArrow(part, ANSWERS), f"ngrams-{level}")
        if tables is not None:
            tables.append(met.where("block = -1"))
        learned = _learned(met, hot, parts)
        known.append(learned)
        answers = met if answers is None else answers.unionByName(met)
        # No text's beginning is counted as a history, and many texts may have one.
        hot = np.concatenate(([-1], learned["often"])) if level > 1 else learned["often"]

    base = np.log10(known[0]["tokens"] + 0.5 * (known[0]["types"] + 1))
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, train_types long, " \
        "base_score double, score double"
    schema = _schema(columns)

    def scored(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0])
        block.through(found, known)
        counts, at = (block.c, block.at) if order == 1 else (block.counts, block.word_at)
        c = counts[at]
        size = len(block.doc_ids)
        return pa.table(
            [
                block.doc_ids, block.held, block.sizes, np.add.reduceat((c > 0).astype(np.int64), block.first),
                np.full(size, known[0]["tokens"], np.int64), np.full(size, known[0]["types"], np.int64),
                np.add.reduceat(np.log10(c + 0.5) - base, block.first),
                np.add.reduceat(np.log10(block.p)[block.at], block.first),
            ], schema=schema,
        )

    return _with_answers(state, answers, scored, columns)


def _with_answers(state: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """Each block with what the parts have answered it."""
    asked = answers.where("block >= 0").select("level", "part", "block", "n", "ids", "histories", "totals", "sums")
    return state.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(function, schema)


def ngrams(table: DataFrame) -> DataFrame:
    """(level, h, w, n): the n-grams of a written level, h and w being ids of the levels below (w at the first
    level: the word's XXH64)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                h, w = _unstepped(r["h"], r["w"], r["size"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(r["size"], r["level"], np.int32)), pa.array(h), pa.array(w), pa.array(unpacked(r["n"], r["size"]))],
                    ["level", "h", "w", "n"],
                )

    return table.select("level", "size", "h", "w", "n").mapInArrow(listed, "level int, h long, w long, n long")
