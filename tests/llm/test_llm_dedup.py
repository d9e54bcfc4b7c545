"""Exact and near duplicates, components and line chunks against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from logtide.llm import components, exact_dedup, line_chunks, simhash
from logtide.llm.queries import LLM_QUERIES
from logtide.plans.common import materialize

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_exact_groups(request, table, equal):
    docs = request.getfixturevalue(table)
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    wanted = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        wanted += [(i, keep, len(ids), i == keep, digest) for i in ids]
    equal(exact_dedup.exact_groups(docs).collect(), wanted)


def test_exact_groups_split_by_salt(make):
    docs = make(["the same"] * 300 + ["other  one", "other\tone"])
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, salts=7).collect()}
    assert found == {(i, 0, 300, i == 0) for i in range(300)} | {(300, 300, 2, True), (301, 300, 2, False)}
    assert exact_dedup.exact_groups(docs.where("false")).collect() == []


def plain_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, bits):
    """Smallest index reachable over links of at most ``bits`` differing bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_near_duplicates(request, table, equal):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    values = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(values, 2)
    least = {}
    for (doc, _), r in zip(rows, root):
        known = least.get(r)
        least[r] = doc if known is None else known if doc is None else min(doc, known)
    wanted = [(doc, f"{v:016x}", least[r]) for (doc, _), v, r in zip(rows, values, root)]
    equal(simhash.near_duplicates(docs).collect(), wanted)
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def fingerprints_around(seed, centres, each):
    rng, out = random.Random(seed), set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("bits, segments, paired", [(2, 5, 32), (2, 5, 0), (2, 3, 2), (2, 7, 4), (1, 4, 0), (1, 4, 9), (0, 2, 9)])
def test_links_join_what_is_near(spark, bits, segments, paired):
    """Pairs, shared values and both at once give the classes of all pairs."""
    values = fingerprints_around(bits + segments, 5, 40) + fingerprints_around(9, 60, 1)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = materialize(spark.createDataFrame([(v,) for v in signed], "fp long"), "fps")
    links = simhash.fingerprint_links(distinct, bits, segments, paired)
    for a, b in links.collect():
        assert a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits
    found = {r.node: r.component for r in components.components(links).collect()}
    classes, wanted = defaultdict(set), defaultdict(set)
    for v in signed:
        classes[found.get(v, v)].add(v)
    for v, r in zip(signed, plain_components(values, bits)):
        wanted[r].add(v)
    assert set(map(frozenset, classes.values())) == set(map(frozenset, wanted.values()))


def test_pigeonring_never_loses_a_pair():
    """Some chain passes for every way to differ in two bits."""
    for segments in (3, 4, 5, 6, 7, 8):
        width = simhash._exact_length(2, segments)
        for i in range(64):
            for j in range(i + 1):
                differing = 1 << i | 1 << j
                assert any(
                    all(
                        (differing & simhash._mask(s, n, segments)).bit_count() <= (0 if n <= width else n * 2 // segments)
                        for n in range(1, segments + 1)
                    )
                    for s in range(segments)
                )


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(200, 203), (201, 203), (202, 203)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    wanted = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 180)} | {201: 200, 202: 200, 203: 200}
    assert {r.node: r.component for r in found} == wanted and len(found) == len(wanted)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group(make):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (3, "A b c d e"), (None, "a  b c d e"), (3, "quite another text"), (8, ""), (9, None)]
    docs = make(rows, clash=True)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "A b c d e"), (3, "quite another text"), (8, "")]
    assert {r.kept for r in kept.collect()} == {"own kept"}


# --- line chunks --------------------------------------------------------------


def test_chunks_restore_the_text_and_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(300)]
    text = "\n".join(lines)
    found = line_chunks.chunks(text)
    assert "\n".join(c for c, _ in found) == text
    assert sum(n for _, n in found) == 300 and len(found) > 30
    moved = line_chunks.chunks("\n".join(["in front", *lines[:150], "amid", "", *lines[150:]]))
    assert len({c for c, _ in found} & {c for c, _ in moved}) > 0.8 * len(found)
    for odd in ("", "\n", "\n\na\n\n", "a"):
        assert "\n".join(c for c, _ in line_chunks.chunks(odd)) == odd


def plain_line_dedup(rows):
    first = {}
    for doc, text in rows:
        for c, n in line_chunks.chunks(text or ""):
            if n >= 2 and doc is not None:
                first[c] = min(doc, first.get(c, doc))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        kept, seen = [], set()
        for c, n in line_chunks.chunks(text):
            if n < 2 or not (c in seen or (doc is not None and first[c] < doc)):
                kept.append(c)
                if n >= 2:
                    seen.add(c)
        out.append((doc, "\n".join(kept)))
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_line_dedup(request, table, equal):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = line_chunks.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    equal(left.select("doc_id", "text").collect(), plain_line_dedup(rows))
    assert line_chunks.drop_repeated_lines(docs.where("false")).count() == 0


def test_shared_passage_goes(make):
    rng = random.Random(2)
    passage = [f"shared line {i} with words" for i in range(30)]
    texts = ["\n".join([*(f"own {rng.random()}" for _ in range(5)), *passage, *(f"end {rng.random()}" for _ in range(5))]) for _ in range(40)]
    docs = make(texts + [texts[0], "\n".join([*passage, *passage])])
    rows = {r.doc_id: r for r in line_chunks.drop_repeated_lines(docs, report=True).collect()}
    assert rows[0].text == texts[0] and rows[0].n_removed == 0
    for i in range(1, 40):
        assert rows[i].text.count("shared line") < 15
        assert [x for x in texts[i].split("\n") if x.startswith("own")] == [x for x in rows[i].text.split("\n") if x.startswith("own")]
    assert rows[41].text.count("shared line") < 30
    counted = Counter(r.n_chunks > 0 for r in rows.values())
    assert counted == {True: 42}


def plain_shared_lines(rows, n=2):
    """The first document of each n lines in a row that hold a word, then the lines left of every text."""
    filled = lambda text: [i for i, x in enumerate(text.split("\n")) if x.strip()]
    first = {}
    for doc, text in rows:
        at, lines = filled(text or ""), (text or "").split("\n")
        for i in range(len(at) - n + 1):
            if doc is not None:
                window = tuple(lines[j] for j in at[i : i + n])
                first[window] = min(doc, first.get(window, doc))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        at, lines, gone, seen = filled(text), text.split("\n"), set(), {}
        for i in range(len(at) - n + 1):
            window = tuple(lines[j] for j in at[i : i + n])
            if seen.setdefault(window, i) + n <= i or (doc is not None and first[window] < doc):
                gone |= {j for j in at[i : i + n]}
        owner = lambda j: max([i for i in at if i <= j], default=at[0] if at else -1)
        out.append((doc, "\n".join(x for j, x in enumerate(lines) if not gone or owner(j) not in gone)))
    return out


@pytest.mark.parametrize("table", ["odd", "documents", "lines"])
def test_shared_lines(request, make, table, equal):
    if table == "lines":
        rng = random.Random(9)
        texts = ["\n".join(rng.choices(["a", "b b", "c", "d", "", " ", "e e", "f"], k=rng.randint(1, 9))) for _ in range(120)]
        docs = make([(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(90, None)], clash=True)
    else:
        docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = line_chunks.drop_shared_lines(docs)
    assert left.columns == docs.columns
    equal(left.select("doc_id", "text").collect(), plain_shared_lines(rows))
    assert line_chunks.drop_shared_lines(docs.where("false")).count() == 0


def test_short_passages_go_whole(spark, make, tmp_path):
    texts, lengths = [], list(range(2, 11)) * 2
    for i, n in enumerate(lengths):
        shared = [f"shared {i} line {k}" for k in range(n)]
        texts += ["\n".join([f"own {i} {j} a", *shared, f"own {i} {j} b", f"own {i} {j} c"]) for j in range(2)]
    make(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in LLM_QUERIES["op8_line_chunks"](spark, str(tmp_path)).collect()}
    for i, n in enumerate(lengths):
        assert rows[2 * i].text == texts[2 * i] and rows[2 * i].n_lines_removed == 0
        assert rows[2 * i + 1].text == f"own {i} 1 a\nown {i} 1 b\nown {i} 1 c"
        assert rows[2 * i + 1].n_lines_removed == n


def test_spans_hold_each_window_once_and_are_cut_by_content():
    rng = random.Random(6)
    lines = [f"line {rng.random()}" for _ in range(300)]
    found = line_chunks.spans(lines)
    assert [i for a, b in found for i in range(a, b + 1)] == list(range(299))
    assert 40 < len(found) < 200
    texts = lambda rows: {"\n".join(rows[a : b + 2]) for a, b in line_chunks.spans(rows)}
    assert len(texts(lines) & texts(["in front", *lines[:150], "amid", *lines[150:]])) > 0.9 * len(found)
    assert [line_chunks.spans(rows) for rows in ([], ["a"], ["a", "b"])] == [[], [], [(0, 0)]]


def test_shared_lines_go_by_rolling_chunks(make):
    """Chunks that an earlier document holds go whole, and only lines of the chunks that stay are compared."""
    rng = random.Random(7)
    text = "\n".join(f"line {rng.random()}" for _ in range(40))
    docs = make([text, "own\n" + text, text])
    lost = line_chunks._lost_chunks(docs, 2, line_chunks._shared_chunks)
    counts = {r.doc_id: len(r.digests) for r in lost.collect()}
    n = len(line_chunks.spans(text.split("\n")))
    assert counts[2] == n and n - 2 <= counts[1] <= n
    kept = Counter(r.doc_id for r in line_chunks.kept_windows(docs, lost).collect())
    assert kept[0] == 39 and 2 not in kept and 0 < kept[1] < 20
    rows = {r.doc_id: r for r in line_chunks.drop_shared_lines(docs, report=True).collect()}
    assert (rows[1].text, rows[2].text) == ("own", "")
    assert (rows[2].n_chunks, rows[2].n_removed, rows[2].n_lines_removed) == (n, n, 40)
