"""Katz backoff against a dictionary version of its formulas, and its sums over all words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm import katz

K = katz.MAX_DISCOUNTED
END = "\n"


class Plain:
    """The model with dictionaries: n-grams as tuples, the end token in front of a text too."""

    def __init__(self, texts, order):
        self.order = order
        self.grams = [None, *[Counter() for _ in range(order)]]
        for words in texts:
            row = [*words, END]
            for i in range(len(row)):
                for n in range(1, order + 1):
                    self.grams[n][(*self.history(row, i, n), row[i])] += 1
        self.d = [None, *[self.discounts(g) for g in self.grams[1:]]]
        self.behind = [None, *[self.grouped(g) for g in self.grams[1:]]]
        self.sums = {}

    @staticmethod
    def history(row, i, n):
        """n - 1 words; before a text stands the end token, and nothing that a longer history could hold."""
        if n == 1:
            return ()
        return (END,) if i == 0 and n == 2 else ("start",) if i == 0 else (
            *Plain.history(row, i - 1, n - 1), row[i - 1]
        )

    @staticmethod
    def grouped(grams):
        found = defaultdict(dict)
        for gram, c in grams.items():
            found[gram[:-1]][gram[-1]] = c
        return found

    @staticmethod
    def discounts(grams):
        n = Counter(grams.values())
        d = {}
        if n[1]:
            most = (K + 1) * n[K + 1] / n[1]
            if most < 1 and all(n[r] for r in range(1, K + 1)):
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - most) / (1 - most) for r in range(1, K + 1)}
        if not d or not all(0 < x < 1 for x in d.values()):
            d = {r: (r - 0.5) / r for r in range(1, K + 1)}
        return d

    def p(self, row, i, n=None, word=None):
        n = n or self.order
        word = word if word is not None else row[i]
        h = self.history(row, i, n)
        met = self.behind[n].get(h, {})
        lower = (lambda w: self.p(row, i, n - 1, w)) if n > 1 else (lambda w: 1.0)
        total = sum(met.values())
        if not total:
            return lower(word)
        d = self.d[n]
        left = sum(c * (1 - d.get(c, 1)) for c in met.values())
        whole, left = (total, left) if left > 0 else (total + 1, 1)
        if word in met:
            return d.get(met[word], 1) * met[word] / whole
        if (n, h) not in self.sums:
            self.sums[n, h] = math.fsum(map(lower, met)) if n > 1 else 0
        return left / whole / (1 - self.sums[n, h]) * lower(word)


def words_of(text):
    return [w.decode() for w in text.encode().lower().split()]


def expected(rows, order, folds=5, fold=1):
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i, _ in rows]
    texts = [words_of(t) for _, t in rows]
    model = Plain([t for t, h in zip(texts, held) if not h], order)
    counts = Counter({g[0]: c for g, c in model.grams[1].items()})
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, _), h, words in zip(rows, held, texts):
        row = [*words, END]
        out.append((
            i, h, len(row), sum(counts[w] > 0 for w in row), n,
            sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in row),
            sum(math.log10(model.p(row, at)) for at in range(len(row))),
        ))
    return out, model


def close(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[6], 6))
    got = sorted([tuple(r[c] for c in (
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )) for r in got], key=key)
    wanted = sorted(wanted, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for a, b in zip(got, wanted):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def sentences(count, seed, words=60):
    chance = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    out = []
    for i in range(count):
        text = chance.choices(names, weights, k=chance.randint(0, 40))
        out.append((i, " ".join(text + ([f"only{i}"] if i % 3 else ["The", "END"]))))
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_scores_equal_the_formulas(make, order):
    rows = sentences(100, order)
    wanted, _ = expected(rows, order)
    # Small blocks and parts: every history that is frequent is spread, most n-grams are in several blocks.
    got = katz.katz_scores(make(rows).repartition(3), order, block_tokens=800, part_tokens=600).collect()
    close(got, wanted)


def test_odd_rows(odd, odd_rows):
    wanted, _ = expected(odd_rows, 2)
    close(katz.katz_scores(odd).collect(), wanted)


def test_documents(documents, document_rows):
    # The plain version adds up every history's words anew, so the longest texts are left to the other tests.
    wanted, _ = expected([(i, t) for i, t in document_rows if len(t) < 1500], 2)
    documents = documents.where(F.length(F.coalesce("text", F.lit(""))) < 1500)
    got = katz.katz_scores(documents, block_tokens=40_000, part_tokens=40_000).collect()
    close(got, wanted)


def test_empty_and_untrained(make):
    assert katz.katz_scores(make([])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = katz.katz_scores(make([(i, "a b a") for i in held])).collect()
    assert {(r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 4, 0.0, 0.0)}


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    rows = sentences(80, 9)
    _, model = expected(rows, order)
    vocabulary = {g[0] for g in model.grams[1]}
    for _, text in rows[:12]:
        row = [*words_of(text), END]
        for i in range(len(row)):
            total = sum(model.p(row, i, word=w) for w in vocabulary) + model.p(row, i, word="never met")
            assert total == pytest.approx(1, abs=1e-9)


def test_tables_hold_the_counts(make):
    rows = sentences(60, 4)
    tables = []
    katz.katz_scores(make(rows), 2, block_tokens=300, part_tokens=200, tables=tables).count()
    _, model = expected(rows, 2)
    for level, table in enumerate(tables, 1):
        found = katz.ngrams(table)
        assert sorted(r.n for r in found.collect()) == sorted(model.grams[level].values())
        assert found.agg(F.sum("n")).first()[0] == sum(model.grams[level].values())


def test_packing_of_numbers():
    values = np.array([0, -1, 5, 1 << 62, -(1 << 62)], np.int64)
    assert katz.unpacked(katz.packed(values), 5).tolist() == values.tolist()
    for some in (np.array([0.5] * 9 + [0.25]), np.array([0.1, 0.2, 0.3])):
        assert katz.unpacked_few(katz.packed_few(some), len(some)).tolist() == some.tolist()
    h = np.array([-1, -1, 0, 3, 3, 3, 9], np.int64)
    w = np.array([4, 9, 1, 0, 2, 70, 5], np.int64)
    back = katz._unstepped(*katz._steps(h, w), 7)
    assert back[0].tolist() == h.tolist() and back[1].tolist() == w.tolist()
