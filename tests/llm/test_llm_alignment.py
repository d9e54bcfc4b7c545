"""Token alignment and periodic runs against plain versions."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logtide.llm import queries, token_alignment
from logtide.llm.periodic_runs import periodic_runs, runs_of_texts
from logtide.llm.texts import byte_letters, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SPECIAL = [
    "a b, c.\nd", "  two  spaces ", " ", "  ", "\n", "a\n\nb\n c \n  d", "x <|endoftext|> <s> </s> <unk> y", "don't, e.g. ok?!",
    "tab\there \x1c odd\x85white\xa0space", "a▁b", "½².² ﬁﬃ é́.", "日本語。🙂👍🏽 ok,", "\0 a\0b", "<0x41> ▁", "w." * 400, "a.\n.b\n,\nc",
    "\nfirst\nline", "end.\n", "a \nb", "a\n b", "x,,;;!?",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(sides, text):
    """Token numbers, groups and links of one text, over byte places."""
    one, two = sides
    letters = byte_letters()
    a = one.encode(" " + text, add_special_tokens=False).ids if text else []
    b = two.encode(text) if text else []
    ends = []
    for ids, spelled in (
        (a, [bytes(letters[c] for c in one.id_to_token(i)) for i in a]),
        (b, [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]),
    ):
        if b"".join(spelled) != (" " + text).encode() or not text:
            return 0, 0, [], []
        at, found = 0, {}
        for n, s in enumerate(spelled):
            at += len(s)
            found[at] = n
        ends.append(found)
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i1, j1 = ends[0][cut] + 1, ends[1][cut] + 1
        groups.append(",".join(map(str, a[i:i1])) + "|" + ",".join(map(str, b[j:j1])))
        links.append((a[i1 - 1], b[j1 - 1]))
        i, j = i1, j1
    return len(a), len(b), groups, links


def plain_table(sides, rows):
    found = [(doc, *plain_alignment(sides, text)) for doc, text in rows]
    counts = Counter(x for f in found for x in f[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (doc, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         ";".join(groups)) for doc, n_a, n_b, groups, links in found
    ]


@pytest.mark.parametrize("hot", [token_alignment.HOT, 3])
def test_alignment_equals_plain(make, sides, document_rows, equal, monkeypatch, hot):
    """With few hot pairs, the counts of most irregular links come back by the join."""
    monkeypatch.setattr(token_alignment, "HOT", hot)
    rows = document_rows[:60] + [(1000 + i, t) for i, t in enumerate(SPECIAL)] + [(5000, SPECIAL[0])] * 2
    equal(token_alignment.alignments(make(rows).repartition(5)).collect(), plain_table(sides, rows))


def test_alignment_of_odd_rows(odd, odd_rows, sides, equal, make):
    equal(token_alignment.alignments(odd).collect(), plain_table(sides, odd_rows))
    assert token_alignment.alignments(make([])).count() == 0
    assert token_alignment.alignments(make([None, ""])).agg({"n_a": "sum"}).first()[0] == 0


@pytest.fixture(scope="module")
def aligner():
    return token_alignment.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abEé1. ,!\n\t'▁²<s>", max_size=40))
def test_segments_equal_whole_texts(sides, aligner, text):
    n_a, n_b, groups, links = plain_alignment(sides, text)
    found = aligner([text])[0]
    assert (sum(s[0] for s in found), sum(s[1] for s in found)) == (n_a, n_b)
    assert ";".join(s[2] for s in found) == ";".join(groups)
    assert sum(len(s[3]) // 4 + len(s[4]) // 8 for s in found) == len(links)


def test_memory_of_segments_is_bounded(sides, monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_SEGMENTS", 40)
    aligner = token_alignment.Aligner(A, B)
    for i in range(30):
        text = f"the word{i} and word{i % 7}, again"
        assert ";".join(s[2] for s in aligner([text])[0]) == ";".join(plain_alignment(sides, text)[2])
        assert len(aligner.newer) + len(aligner.older) < 80


def test_memory_of_segments_is_small():
    """A remembered segment is a string and its place in arrays; long segments are not remembered."""
    aligner = token_alignment.Aligner(A, B)
    aligner(["the word"])
    texts = [" ".join(f"{x}ing{n}re, {n}tion{x}" for n in range(i, i + 100)) for i in range(0, 10_000, 100) for x in "ab"]
    tracemalloc.start()
    arrow = pyarrow.total_allocated_bytes()
    for text in texts:
        aligner([text])
    held = tracemalloc.get_traced_memory()[0] + pyarrow.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 300 * len({word for text in texts for word in text.split()})
    long = "ab" * 20_000 + " c"
    assert ";".join(s[2] for s in aligner([long])[0]) == ";".join(plain_alignment((aligner.a, aligner.b), long)[2])
    assert max(map(len, [*aligner.newer, *aligner.older])) < 1000


def test_marks_behind_letters(sides, aligner):
    texts = [" ".join(f"x{c}{m}y{c}{m}" for m in token_alignment.MARKS) for c in map(chr, range(33, 0x250))]
    for text, found in zip(texts, aligner(texts)):
        assert ";".join(s[2] for s in found) == ";".join(plain_alignment(sides, text)[2])


def plain_runs(words, exponent=4, least=6):
    """Every lag over all words; of stretches found at several lags the smallest."""
    found = {}
    for lag in range(1, len(words) // exponent + 1):
        i = 0
        while i + lag < len(words):
            j = i
            while j + lag < len(words) and words[j] == words[j + lag]:
                j += 1
            if j > i and j - i + lag >= max(least, exponent * lag):
                found.setdefault((i, j + lag), lag)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_text(chance):
    words = []
    for _ in range(chance.randint(0, 5)):
        size, letters = chance.choice([1, 2, 3, 7, 8, 9, 10, 16, 17, 18, 31, 33, 64, 65, 90]), chance.choice([1, 2, 40])
        period = [f"w{chance.randint(0, letters)}" for _ in range(size)]
        words += (period * 9)[: chance.randint(0, 9 * size)]
        words += [f"w{chance.randint(0, letters)}" for _ in range(chance.randint(0, 9))]
    return " ".join(words)


def test_runs_equal_lag_scans():
    chance = random.Random(2)
    for _ in range(60):
        texts = [periodic_text(chance) for _ in range(chance.randint(1, 5))]
        for text, (n, runs, left) in zip(texts, runs_of_texts([t.encode() for t in texts])):
            words = text.split()
            assert (n, runs) == (len(words), plain_runs(words))
            assert left.decode() == collapsed(words, runs)


@pytest.mark.parametrize("words", [
    ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], (["a"] * 40 + ["b"]) * 30, ["a", "a", "b"] * 300,
    [str(bin(i).count("1") % 2) for i in range(2048)], [f"x{i}" for i in range(500)] * 5,
])
def test_runs_of_known_words(words):
    assert runs_of_texts([" ".join(words).encode()])[0][1] == plain_runs(words)


def digests(rows):
    """The query's columns from plain runs of the texts with planted periods."""
    out = []
    for doc, text in rows:
        words = [w.decode() for w in text.encode().split()]
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if doc is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        out.append((
            doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    return out


def test_runs_of_documents(spark, document_rows, equal):
    got = queries.op13_multiscale_minimizers(spark, "/root/testdata/sf0.001").collect()
    short = [(i, t) for i, t in document_rows if len(t) < 20_000]
    equal([r for r in got if r.doc_id in {i for i, _ in short}], digests(short))


def test_runs_of_odd_rows(odd, odd_rows, make, equal):
    got = periodic_runs(odd).collect()
    wanted = []
    for doc, text in odd_rows:
        words = [w.decode() for w in text.encode().split()]
        runs = plain_runs(words) if len(words) < 5000 else []
        wanted.append((doc, len(words), str([tuple(r) for r in runs]), collapsed(words, runs)))
    equal([(r.doc_id, r.n_words, str([tuple(x) for x in r.runs]), r.text) for r in got], wanted)
    assert periodic_runs(make([])).count() == 0
    assert queries.with_planted_runs(odd).count() == len(odd_rows)
    with pytest.raises(ValueError):
        runs_of_texts([b"a a a"], exponent=3)
