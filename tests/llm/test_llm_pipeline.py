"""The queries' registration, their SQL, and the pipeline against its stages done plainly."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from logtide.llm import pseudonyms

from logtide.llm.queries import LLM_ORACLES, LLM_QUERIES
from logtide.llm.texts import tokenizer_path
from test_llm_dedup import plain_components, plain_fingerprint, plain_shared_lines
from test_llm_rules import plain_quality
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert set(LLM_ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cursor = connection.execute(LLM_ORACLES[name])
    found = [c[0] for c in cursor.description]
    df = LLM_QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(found)
    wanted = sorted(tuple(str(r[found.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == wanted


def corpus():
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(3000)) for _ in range(n))
    shared = [words(12) for _ in range(12)]
    rows = []
    for i in range(80):
        lines = [words(15) for _ in range(8)]
        if i % 3 == 0:
            lines[4:4] = shared
        lines.append("All rights  reserved here" if i % 2 else "all rights reserved HERE")
        if i % 7 == 0:
            lines.append(f"write to x{i}@mail.example.com or +1 (234) 555-{i:04d}")
        rows.append((i, "\n".join(lines), f"s{i % 2}"))
    rows += [(100 + i, rows[5 * i][1], "s1") for i in range(10)]
    rows += [(200 + i, rows[4 * i + 1][1].replace("a", "A"), "s0") for i in range(10)]
    return rows + [(300, "short", "s0"), (301, None, None), (302, "", "s1"), (None, words(60), None), (7, rows[7][1], "s1")]


def test_pipeline_equals_plain_stages(spark, make, tmp_path):
    rows = corpus()
    make(rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(doc, text or "", source) for doc, text, source in rows]
    docs = [(w[0], left, None) for w, left in plain_quality(docs, 20, 0.05) if w[7]]
    docs = plain_shared_lines([(d, t) for d, t, _ in docs])
    groups = defaultdict(list)
    for (doc, text), root in zip(docs, plain_components([plain_fingerprint(t) for _, t in docs], 2)):
        groups[root].append((doc is None, doc or 0, text))
    rewrite = pseudonyms.Pseudonymiser(pseudonyms.DEMO_KEY)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    wanted = []
    for group in groups.values():
        missing, doc, text = min(group)
        ids = [*tokenizer.encode(rewrite(text)[0], add_special_tokens=False).ids, 0]
        wanted += [(None if missing else doc, p, len(ids[a : a + 2048])) for p, a in enumerate(range(0, len(ids), 2048))]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.length) for r in found), key=key) == sorted(wanted, key=key)
    assert len(wanted) < len(rows)


def test_stages_return_the_columns_of_documents(spark, make):
    for docs in (make(corpus(), clash=True), make([], clash=True)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
            lengths = out.selectExpr("sum(cast(n_chars != length(text) as int)) as n").first().n
            assert not lengths or name == "near_dedup"


def test_empty_pipeline(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
