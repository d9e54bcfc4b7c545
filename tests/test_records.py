import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logtide.functions.text import clean_line
from logtide.operators import records
from logtide.plans import common

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)


def make_files(seed):
    """Files with leading lines, long runs of continuations, or no time at all."""
    rng = random.Random(seed)
    files = {}
    for f in range(6):
        share = [0.0, 0.02, 0.1, 0.5, 1.0, 0.3][f]
        lines = []
        for i in range(rng.randint(40, 120)):
            stamped = rng.random() < share
            text = f"word{i} caused by x{rng.randint(0, 9)}"
            lines.append(f"2024-01-02 03:{i % 60:02d}:05 {text}" if stamped else f"  {text}")
        files[f"f{f}.log"] = lines
    return files


def expected(files):
    """The fold, one file after the other."""
    folded, untimed = {}, {}
    for name, lines in files.items():
        flags = [line.startswith("2024") for line in lines]
        clean = [" ".join(("x" + line).split())[1:] if not line.startswith(" ") else " " + line.strip() for line in lines]
        if not any(flags):
            untimed.update({(name, i): t for i, t in enumerate(clean)})
            continue
        head = -1
        for i, (flag, text) in enumerate(zip(flags, clean)):
            if flag:
                head = i
            folded.setdefault((name, head), []).append(text)
    return {k: "\n".join(v) for k, v in folded.items()}, untimed


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_fold_does_not_depend_on_chunks(spark, bits):
    files = make_files(3)
    rows = [(n, 0, i, t) for n, lines in files.items() for i, t in enumerate(lines)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "file_name string, block_start long, line_seq long, value string")
    timed, untimed = records.segment_records(records.parse_lines(lines, AS_OF), bits)
    got = {(r.file_name, r.record_id.line_seq): r for r in timed.collect()}
    folded, alone = expected(files)
    assert {k: r.text for k, r in got.items()} == folded
    assert {(r.file_name, r.record_id.line_seq): r.text for r in untimed.collect()} == alone
    for (name, head), r in got.items():
        assert (r.epoch is None) == (head == -1)
        assert r.token_count == sum(len(t.split(" ")) for t in r.text.split("\n"))
        assert len(r.clean_text.split("\n")) == len(r.text.split("\n"))


def test_blocks_of_one_file_meet(spark):
    rows = [
        ("a", 0, 5, "2024-01-02 03:00:00 one"), ("a", 0, 6, "x"),
        ("a", 900, 2, "y"), ("a", 900, 3, "z"), ("a", 1800, 1, "2024-01-02 03:00:01 two"),
    ]
    lines = spark.createDataFrame(rows, "file_name string, block_start long, line_seq long, value string")
    timed, untimed = records.segment_records(records.parse_lines(lines, AS_OF), cut=False)
    assert sorted(r.text for r in timed.collect()) == [
        "2024-01-02 03:00:00 one\nx\ny\nz", "2024-01-02 03:00:01 two"
    ]
    assert untimed.count() == 0


def test_json_lines(spark):
    values = [
        '{"a_time": 1706745600123, "msg": " hello  w\\u00f6rld "}', '{"a": {"time": "2024-01-02 03:04:05"}, "msg": "x"}',
        '{"msg": "no time"}', "{}", "[1]", "{broken", "plain", '  {"a": {"time": "soon"}, "msg": "y"}', '{"a_time": 0, "msg": "zero"}',
    ]
    lines = spark.createDataFrame(
        [("f", 0, i, v) for i, v in enumerate(values)], "file_name string, block_start long, line_seq long, value string"
    )
    text, objects = records.split_json_lines(lines)
    assert sorted(r.line_seq for r in text.collect()) == [3, 4, 5, 6]
    kept, refused = records.json_records(objects, ["a_time"], ["msg"], AS_OF)
    got = {r.line_seq: (r.epoch, r.text) for r in kept.collect()}
    assert got == {0: (1706745600.123, "hello wrld"), 1: (1704164645.0, "x")}
    assert sorted(r.line_seq for r in refused.collect()) == [2, 7, 8]
    # Without configured fields every object is refused.
    assert records.json_records(objects, [], [], AS_OF)[0].count() == 0


def test_flatten_json_any_depth(spark):
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}, "l": [1, {"x": 2}], "s": "t", "n": null}'
    df = spark.createDataFrame([(deep,), (None,)], "v string")
    got = [r.m for r in df.select(records.flatten_json(F.col("v")).alias("m")).collect()]
    assert got == [{"a_b_c_d_e_f_g": "1", "l": '[1, {"x": 2}]', "s": "t", "n": "null"}, None]


def stats_frame(spark, counts):
    return spark.createDataFrame(
        [(i, float(i), "w" * 400, c) for i, c in enumerate(counts)],
        "record_id int, epoch double, text string, token_count long",
    )


def test_truncation_counts_characters(spark):
    counts = [10] * 30 + [100]
    out = records.truncate_long(stats_frame(spark, counts))
    mean = sum(counts) / 31
    sd = (sum((c - mean) ** 2 for c in counts) / 30) ** 0.5
    bound = int(mean + 2 * sd)
    assert {len(r.truncated_log) for r in out.where("token_count = 100").collect()} == {bound}
    assert out.where("length(truncated_log) = 400").count() == 30
    assert records.truncation_count(out).first()[0] == 1
    # No deviation, no truncation; one row has none either.
    for same in ([5, 5, 5], [5]):
        rows = records.truncate_long(stats_frame(spark, same)).collect()
        assert all(r.truncated_log == r.text and r.z_score == 0 for r in rows)


def test_time_range(spark):
    df = spark.createDataFrame([(float(d * 86400),) for d in range(40)], "epoch double")
    for name, days in (("1-day", 2), ("1-week", 8), ("1-month", 31), ("all-data", 40)):
        assert records.time_range_filter(df, name).count() == days
    with pytest.raises(ValueError):
        records.time_range_filter(df, "fortnight")


def test_untimed_only_input(spark):
    rows = [("a", 0, i, f"plain text {i}") for i in range(5)]
    lines = spark.createDataFrame(rows, "file_name string, block_start long, line_seq long, value string")
    timed, untimed = records.segment_records(records.parse_lines(lines, AS_OF))
    built = records.build_records(timed, untimed, as_of=AS_OF).collect()
    assert len(built) == 5 and {r.epoch for r in built} == {AS_OF.timestamp()}


def test_clean_line(spark):
    df = spark.createDataFrame([("a\té  b\x0bc\nd",)], "t string")
    assert df.select(clean_line(F.col("t"))).first()[0] == "a b c\nd"


def test_json_keys_with_many_underscores(spark):
    """A key of 14 parts that lie flat, in some objects, or nowhere."""
    key = "_".join("abcdefghijklmn")
    values = [
        '{"a_b": {"c_d_e": {"f_g_h_i_j_k_l_m_n": "deep"}}, "t": 1700000000}', f'{{"{key}": "flat", "t": 1700000001}}',
        '{"a": {"b": "short"}, "t": 1700000002}', f'{{"{key}": "no time"}}',
    ]
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(values)], "file_name string, block_start long, line_seq long, value string")
    kept, discarded = records.json_records(lines, ["t"], [key], datetime(2024, 2, 1, tzinfo=timezone.utc))
    assert {(r.line_seq, r.text, r.epoch) for r in kept.collect()} == {(0, "deep", 1700000000.0), (1, "flat", 1700000001.0)}
    assert {r.line_seq for r in discarded.collect()} == {2, 3}


def test_patterns_ordered_by_hits_give_the_same_records(spark):
    from logtide.plans.analysis import preprocess

    lines = [f"{i % 12 + 1:02d}/{i % 28 + 1:02d}/23 10:{i % 60:02d}:01 word{i} done" if i % 3 else f"2023-05-{i % 28 + 1:02d} 10:{i % 60:02d}:01,5 odd{i}" for i in range(90)]
    df = spark.createDataFrame([("a.log", 0, i, t) for i, t in enumerate(lines)], "file_name string, block_start long, line_seq long, value string")
    shown = lambda order: sorted((r.text, r.epoch) for r in preprocess(df, AS_OF, order=order)[0].collect())
    assert len(shown("hits")) == 90 and shown("hits") == shown(None)


def test_interval_start_as_text(spark):
    df = spark.createDataFrame([(float(i * 3600),) for i in range(50)], "epoch double")
    for start in ("1970-01-01T05:00:00", "1970-01-01 06:00:00+01:00", 5 * 3600.0):
        assert sorted(r.epoch // 3600 for r in records.interval_filter(df, start, 7200).collect()) == [5, 6, 7]


@pytest.mark.parametrize("bits", [0, 16])
def test_folded_rows_hold_each_text_once(spark, bits):
    """Texts for the classifier are made where they are read, and lines without time are not there twice."""
    lines = [("a.log", i, v) for i, v in enumerate(["above all", "2024-01-01 10:00:00 one", "  more", "more 12"])]
    lines += [("b.txt", i, v) for i, v in enumerate(["plain 1 line", None, "wwwOther"])]
    df = spark.createDataFrame(lines, "file_name string, line_seq long, value string").withColumn("block_start", F.lit(0).cast("long"))
    parsed = records.parse_lines(df, AS_OF)
    folded = records.fold_chunks(parsed, bits)
    assert not {"text", "clean_text"} & set(folded.columns)
    assert folded.where("(texts IS NULL) = (lines IS NULL)").count() == 0
    with common.passing_tables(spark):
        timed, untimed = records.segment_records(parsed, bits)
        built = {r.text: r for r in timed.unionByName(untimed).collect()}
    assert set(built) == {"above all", "2024-01-01 10:00:00 one\n more\nmore 12", "plain 1 line", None, "wwwOther"}
    shown = lambda r: (r.clean_text, r.digit_count, r.char_count, r.token_count)
    assert shown(built["2024-01-01 10:00:00 one\n more\nmore 12"]) == ("one\nmore\nmore", 2, 13, 7)
    assert shown(built["above all"]) == ("above all", 0, 9, 2)
    assert shown(built["plain 1 line"]) == ("plain line", 1, 11, 3)
    assert shown(built[None])[:3] == (None, None, None)


def test_passing_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    names = lambda: sorted(name.split("-")[0] for name in os.listdir(tmp_path))
    with common.passing_tables(spark) as outer:
        with common.passing_tables(spark):
            common.materialize(spark.range(3), "inner")
            longer = common.materialize(spark.range(4), "longer", outer)
            kept = common.materialize(spark.range(5), "kept", keep=True)
        assert names() == ["kept", "longer"] and longer.count() == 4
    plain = common.materialize(spark.range(6), "plain")
    assert names() == ["kept", "plain"]
    assert kept.count() == 5 and plain.count() == 6
