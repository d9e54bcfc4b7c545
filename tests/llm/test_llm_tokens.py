"""Packing, token files and trie encoding against the tokenizers library."""

import glob
import hashlib
import json
import random
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logtide.llm import packing, token_files, trie_bpe
from logtide.llm.texts import TextEncoder

BYTES = "/opt/tokenizers/byte_bpe_50k.json"
WORDS = "/opt/tokenizers/word_bpe_49k.json"
ODD = [
    "", "a", "  a   b \n  c\n\n d ", "x <|endoftext|> y  <|endoftext|>", " \n ", "aaaa aaaaaaa a a", "\0 a\0b",
    "don't we'll 123456 ½ ² Ⅷ é́", " x   y", "🙂👍🏽 ok", "a  ", "a \n", "\n a\n  b", "x" * 2000, "\x1c \x1d x",
    "İstanbul ΣΑΣ <|startoftext|>x",
]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


@pytest.fixture(scope="module")
def encoders():
    return {BYTES: TextEncoder(BYTES, True), WORDS: TextEncoder(WORDS, False)}


@pytest.fixture(scope="module")
def trie():
    return trie_bpe.TrieEncoder(BYTES)


def ids_of(found):
    return [int(i) for text, _, _ in found for i in text.split(",") if i]


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
def test_encoder_equals_library(library, path, keeps_space, document_rows):
    marks = ["word$$$ Über&&& x²%% don't*** a.# É##", "a$b c*.d %%% q$ $q #", "naïve%\nnext* line&&\nend"]
    texts = ODD + marks + [t for _, t in document_rows]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in TextEncoder(path, keeps_space)(texts)]
    assert got == [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abÉß×÷7 \n\t'.,#$-\0\u0301\u00a0\u2003日e", max_size=30), max_size=4))
def test_encoder_equals_library_on_any_texts(library, encoders, texts):
    for path, encoder in encoders.items():
        ids, sizes = encoder.arrays(pa.array(["cut off", *texts], pa.string())[1:])
        wanted = [e.ids for e in library[path].encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in wanted for i in w] and sizes.tolist() == [len(w) for w in wanted]


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
def test_encoder_forgets_pieces(library, monkeypatch, path, keeps_space):
    """Beyond the bound only the pieces of the block at hand stay known; texts that go whole are never kept."""
    monkeypatch.setattr("logtide.llm.texts.CACHED_PIECES", 50)
    encoder = TextEncoder(path, keeps_space)
    for n in range(0, 300, 15):
        texts = [" ".join(f"{w}a{'bcdefghij'[i % 9]}{'klm'[i % 3]}," for i in range(n, n + 30)) for w in ("x", "y")]
        texts.append(f"two  blanks {n} <|endoftext|>")
        raw = b"".join(encoder(texts))
        wanted = [i for e in library[path].encode_batch(texts, add_special_tokens=False) for i in e.ids]
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == wanted
    assert len(encoder.cache) <= 120 and texts[-1] not in encoder.cache


@pytest.mark.parametrize("path, keeps_space", [(BYTES, True), (WORDS, False)])
def test_encoder_knows_a_word_before_any_marks(path, keeps_space):
    """Each word is encoded once, whatever marks or line ends stand beside it."""
    encoder = TextEncoder(path, keeps_space)
    encoder(["x word word, word. word###\nword\nword x"])
    assert sum("word" in piece for piece in encoder.cache) == 2  # behind a space and behind a line end


def test_trie_equals_library(library, trie, document_rows):
    texts = ODD + [t for _, t in document_rows]
    for text, found in zip(texts, trie(texts)):
        want = library[BYTES].encode(text, add_special_tokens=False).ids
        assert ids_of(found) == want
        decoded = b"".join(b for _, _, b in found).decode("utf-8", "replace")
        assert decoded == library[BYTES].decode(want, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abteh rn\n '1é.", max_size=40))
def test_trie_equals_library_on_any_text(library, trie, text):
    assert ids_of(trie([text])[0]) == library[BYTES].encode(text, add_special_tokens=False).ids


def merged(word, merges, vocabulary):
    parts = list(word)
    while True:
        best = min((merges.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else None
        if best is None or best[0] == 1 << 30:
            return [vocabulary[p] for p in parts]
        parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]


def test_trie_on_small_vocabularies(tmp_path):
    """Random merge lists, with tokens that their own bytes never lead to."""
    for seed in range(60):
        rng = random.Random(seed)
        tokens, merges = ["a", "b"], []
        while len(merges) < 9:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        vocabulary = {t: i for i, t in enumerate(tokens)}
        path = tmp_path / f"{seed}.json"
        path.write_text(json.dumps(
            {"model": {"vocab": vocabulary, "merges": [list(m) for m in merges]}, "added_tokens": []}))
        encoder = trie_bpe.TrieEncoder(str(path))
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(200)}
        found = encoder.encode_words([w.encode() for w in words])
        ranks = {m: i for i, m in enumerate(merges)}
        for word in words:
            assert found[word.encode()] == merged(word, ranks, vocabulary), (seed, word, merges)


def test_trie_query(odd, odd_rows, library, equal):
    def want(doc, text):
        ids = library[BYTES].encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return doc, len(ids), sha(",".join(map(str, ids))), sha(library[BYTES].decode(ids, skip_special_tokens=False))

    equal(trie_bpe.encoded_and_decoded(odd).collect(), [want(*r) for r in odd_rows])
    assert trie_bpe.encoded_and_decoded(odd.where("false")).collect() == []


def check_packing(rows, capacity):
    """Every sequence is filled without gaps; returns the number of sequences."""
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(used)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing(request, table, library, equal):
    docs = request.getfixturevalue(table)
    rows = packing.packed_sequences(docs).collect()
    wanted = []
    for doc, text in ((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()):
        ids = [*library[WORDS].encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            wanted.append((doc, piece, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])))
    equal([tuple(r)[:5] for r in rows], wanted)
    tokens = sum(r.length for r in rows)
    assert check_packing(rows, 2048) <= -(-tokens // 2048) * 1.02 + 1


def test_packing_of_nothing(odd):
    assert packing.packed_sequences(odd.where("false")).collect() == []


def test_sum_of_squares_places_by_squares():
    """Each choice against the sums of squares of all choices."""
    rng = random.Random(3)
    lengths = [rng.randint(1, 20) for _ in range(400)]
    chosen, places = packing.sum_of_squares(lengths, 20)
    left = {}
    for length, sequence, place in zip(lengths, chosen, places):
        def squares(gaps):
            count = defaultdict(int)
            for g in gaps:
                count[g] += 0 < g < 20
            return sum(n * n for n in count.values())

        open_gaps = list(left.values())
        options = {g: squares([*open_gaps, g - length]) for g in [20]}
        for g in set(open_gaps):
            if g >= length:
                rest = open_gaps.copy()
                rest.remove(g)
                options[g] = squares([*rest, g - length])
        gap = left.get(sequence, 20)
        assert place == 20 - gap and options[gap] == min(options.values())
        left[sequence] = gap - length
    assert len(left) <= sum(lengths) / 20 * 1.05 + 2


def test_packing_in_groups_stays_close(spark):
    pieces = spark.range(3000).selectExpr(
        "id as doc_id", "0 as piece", "0L as start", "cast(1 + 99 * pow(pmod(xxhash64(id), 1000) / 1000, 3) as long) as length", "0L as ids_crc32")
    from logtide.plans.common import materialize

    rows = packing.pack(materialize(pieces, "pieces"), 100, group=500).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 100) <= sum(r.length for r in rows) / 100 * 1.04 + 6


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd, odd_rows, library, tmp_path, encoding):
    folder = str(tmp_path / encoding)
    token_files.write_tokens(odd, folder, encoding=encoding, row_group_bytes=1 << 16, page_bytes=1 << 12)
    tokens = token_files.read_tokens(spark, folder)
    rows = sorted(token_files.token_ranges(tokens).collect(), key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)
    start, found = 0, []
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        found.append((r.doc_id, r.n_tokens, r.ids_crc32))
    wanted = []
    for doc, text in odd_rows:
        ids = [*library[BYTES].encode(text, add_special_tokens=False).ids, 2]
        wanted.append((doc, len(ids), crc(ids)))
    assert sorted(found, key=lambda r: (r[0] or -1, *r[1:])) == sorted(wanted, key=lambda r: (r[0] or -1, *r[1:]))
    names = set()
    for name in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for group in range(meta.num_row_groups):
            column = meta.row_group(group).column(meta.num_columns - 1)
            assert column.has_offset_index
            names |= set(column.encodings)
    assert any(("DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in n for n in names)


def test_metadata_reads_no_ids(spark, odd, tmp_path):
    token_files.write_tokens(odd, str(tmp_path / "t"))
    plan = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 7").select("n_tokens")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in text.split("ReadSchema:")[1].split("\n")[0] and "PushedFilters: [IsNotNull(doc_id)" in text


def test_token_files_of_nothing(odd):
    assert token_files.token_table(odd.where("false")).collect() == []


def test_unknown_encoding(odd, tmp_path):
    with pytest.raises(ValueError):
        token_files.write_tokens(odd, str(tmp_path), encoding="plain")
