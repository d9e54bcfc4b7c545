import glob
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from logtide.sources import archives, lines as ln, matcher, reports, sinks


def write(folder, name, text, mode="w"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as out:
        out.write(text)
    return path


def test_read_lines_in_order_across_splits(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000))
    write(tmp_path, "d/a.log", text)
    write(tmp_path, "d/b.log", b"caf\xc3\xa9 \xff end\r\n\r\nlast", "wb")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = ln.read_log_lines(spark, [str(tmp_path / "d"), str(tmp_path / "d")])
        rows = df.where(F.col("file_name").endswith("a.log")).orderBy("block_start", "line_seq").collect()
        assert len({r.block_start for r in rows}) > 1
        assert [r.value for r in rows] == text.splitlines()
        stats = {os.path.basename(r.file_name): (r.num_lines, r.num_blank) for r in ln.file_stats(df).collect()}
        assert stats == {"a.log": (3000, 0), "b.log": (3, 1)}
        total = ln.input_stats(spark, [str(tmp_path / "d")]).first()
        assert total.total_size_bytes == len(text) + 19 and total.num_log_lines_total == 3003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_select_files(spark, tmp_path):
    names = ["a.log", "a.log1", "a.log.-1", "a.log.2", "b.txt", "c.csv", "log", "x/y.log", "a.log.gz"]
    for name in names:
        write(tmp_path, name, "x\n")
    files = ln.list_files(spark, [str(tmp_path)])
    chosen = {r.name for r in ln.select_files(files).where("processed").collect()}
    assert chosen == {"a.log", "a.log1", "a.log.-1", "a.log.2", "y.log"}
    assert ln.select_files(files, txt_files=True, log_files=False).where("processed").count() == 1
    assert ln.select_files(files, all_files=True).where("processed").count() == len(names)
    named = files.select("name", ln.named_file_selected(F.col("name")).alias("ok"))
    assert {r.name for r in named.where("NOT ok").collect()} == {"c.csv"}


def tar_bytes(members, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    plain = {"d/a.log": b"one\ntwo\n", "d/b.txt": b"three\n", "d/c.bin": b"\x00"}
    inner = zip_bytes({"deep/e.log": b"inner\n", "deep/f.dat": b"no\n"})
    bundle = {"sosreport-x/var/log/m.log": b"m1\n", "sosreport-x/etc/z.log": b"z\n", "sosreport-x/sos_commands/q.log": b"q\n"}
    write(tmp_path, "p.zip", zip_bytes({**plain, "nested.zip": inner}), "wb")
    write(tmp_path, "q.tar", tar_bytes(plain, "w"), "wb")
    write(tmp_path, "r.tar.gz", tar_bytes({**plain, "n.tgz": tar_bytes({"g.log": b"in tgz\n"}, "w:gz")}, "w:gz"), "wb")
    write(tmp_path, "s.tgz", tar_bytes(bundle, "w:gz"), "wb")
    write(tmp_path, "other.log", "not an archive\n")
    got = {}
    for r in archives.read_archives(spark, [str(tmp_path)]).collect():
        name = r.file_name.split(str(tmp_path) + "/")[-1]
        got.setdefault(name, {})[r.line_seq] = r.value
    got = {k: [v[i] for i in sorted(v)] for k, v in got.items()}
    assert got == {
        "p.zip/d/a.log": ["one", "two"], "p.zip/nested.zip/deep/e.log": ["inner"],
        "q.tar/d/a.log": ["one", "two"],
        "r.tar.gz/d/a.log": ["one", "two"], "r.tar.gz/n.tgz/g.log": ["in tgz"],
        "s.tgz/sosreport-x/var/log/m.log": ["m1"],
    }
    both = archives.read_archives(spark, [str(tmp_path)], txt_files=True)
    assert both.where(F.col("file_name").endswith("b.txt")).count() == 3


def test_unquoted_csv_round_trip(spark, tmp_path):
    rows = [(1, "a,b", 1.5), (2, "back\\slash, and\nnew\r\nline", None), (3, "\\n is two characters", 0.0)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    sinks.write_unquoted_csv(df, str(tmp_path / "c"))
    back = matcher.read_unquoted_csv(spark, str(tmp_path / "c"), "id long, text string, x double")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_matcher_files(spark, tmp_path):
    write(tmp_path, "m/1.json", json.dumps({"a": 1, "b": 2}))
    write(tmp_path, "m/2.json", json.dumps({"b": 2, "c, d": 3}, indent=2))
    ids = matcher.read_matcher_files(spark, str(tmp_path / "m"), "test_ids")
    assert sorted(tuple(r) for r in ids.collect()) == [("a", 1), ("b", 2), ("c, d", 3)]
    rows = spark.createDataFrame(
        [(1, "a", 5.0), (2, "b", 3.0), (3, "a", 1.0), (4, "z", 0.0), (5, "b", None)], "row_id long, truncated_text string, epoch double"
    )
    train = ids.selectExpr("truncated_text", "test_ids * 10 AS train_ids").unionByName(
        spark.createDataFrame([("a", 11)], "truncated_text string, train_ids long")
    )
    got = [(r.row_id, r.test_ids, r.train_ids) for r in matcher.matched_rows(rows, ids, train).collect()]
    assert sorted(got) == [(1, 1, 10), (1, 1, 11), (2, 2, 20), (3, 1, 10), (3, 1, 11)]
    assert [g[0] for g in got] == [3, 3, 2, 1, 1]


def test_chunks_are_bounded_and_whole(spark):
    df = spark.range(2000).selectExpr("id", "repeat('x', CAST(id % 90 AS int)) AS t")
    sizes = sinks.chunk_sizes(sinks.chunk_by_bytes(df, ["id"], 2000)).collect()
    assert sum(r.rows for r in sizes) == 2000
    assert all(r.bytes <= 2000 for r in sizes) and len(sizes) > 50
    again = sinks.chunk_sizes(sinks.chunk_by_bytes(df.repartition(3), ["id"], 2000)).collect()
    assert sorted(sizes) == sorted(again)


def test_chunk_folders_hold_their_file_alone(spark, tmp_path, monkeypatch):
    """No checksum beside it: Hadoop's file system, which writes one, starts processes for each file."""
    rows = [(i, f"{i // 7}-0-{i % 3}", None if i == 50 else f"é {i} \\ \"" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, part string, text string").repartition(4)
    line = F.to_json(F.struct("id", "text"))
    wanted = sorted((i, p, t) for i, p, t in rows)
    for at in ("own", "other"):
        path = str(tmp_path / at)
        if at == "other":
            monkeypatch.setattr(sinks, "_local_folder", lambda spark, path: None)
        sinks.write_chunk_folders(df, path, line, ["id"], "json")
        back = spark.read.schema("id long, text string, part string").json(path).select("id", "part", "text")
        assert sorted(tuple(r) for r in back.collect()) == wanted
        for part in {p for _, p, _ in rows}:
            names = os.listdir(f"{path}/part={part}")
            assert names == ["part-0.json"] if at == "own" else len(names) == 2
            with open(next(f"{path}/part={part}/{n}" for n in names if not n.startswith("."))) as file:
                assert [json.loads(x)["id"] for x in file] == sorted(i for i, p, _ in rows if p == part)
    monkeypatch.undo()
    sinks.write_chunk_folders(df.where("false"), str(tmp_path / "none"), line, ["id"], "json")
    assert spark.read.schema("id long, text string, part string").json(str(tmp_path / "none")).count() == 0


def test_which_folders_are_the_machines(spark):
    assert sinks._local_folder(spark, "file:///a/b c") == sinks._local_folder(spark, "/a/b c") == "/a/b c"
    assert sinks._local_folder(spark, "file:/a") == "/a"
    assert sinks._local_folder(spark, "hdfs://host/a") is sinks._local_folder(spark, "viewfs:/a") is None


def test_store_sink(spark, tmp_path):
    entries = spark.createDataFrame(
        [(i, i * 40000, f"f{i % 2}") for i in range(30)], "entry_id long, timestamp long, file_source string"
    )
    empty = spark.createDataFrame([(1,)], "template_id long")
    sinks.write_store(empty, empty, entries, str(tmp_path / "s"))
    back = sinks.read_entries(spark, str(tmp_path / "s"))
    assert back.count() == 30
    day = back.where("day = DATE '1970-01-03'")
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().toString()
    assert day.count() == sum(2 * 86400 <= i * 40000 < 3 * 86400 for i in range(30))


def test_metrics(spark):
    a = spark.createDataFrame([(10, 2.5)], "num_log_lines_total long, preprocessing_time_ms double")
    b = spark.createDataFrame([(1.5,)], "preprocessing_time_ms double")
    merged = sinks.merge_metrics(sinks.as_metrics(a), sinks.as_metrics(b))
    assert {r.name: r.value for r in merged.collect()} == {"num_log_lines_total": 10.0, "preprocessing_time_ms": 4.0}


def test_debug_sink(spark, tmp_path):
    df = spark.createDataFrame([("t", "v", 1, "x")], "text string, value string, template_id long, truncated_log string")
    records = df.select("text", F.lit(1).alias("record_id"))
    sinks.write_debug(str(tmp_path / "d"), df, df, records, df)
    assert spark.read.json(str(tmp_path / "d/matcher_output")).first().truncated_log == "x"


def test_report_needs_its_manifest(spark, tmp_path):
    rows = [(i, json.dumps({"id": i, "text": "x" * (i * 37 % 400)})) for i in range(200)] + [(200, "y" * 5000)]
    df = spark.createDataFrame(rows, "id long, document string").repartition(5)
    folder = str(tmp_path / "report")
    reports.write_report(df, folder, ["id"], 2048)
    back = reports.read_report(spark, folder).collect()
    assert sorted(r.value for r in back) == sorted(t for _, t in rows)
    sizes, at = {}, {}
    for r in back:
        sizes[r.part] = sizes.get(r.part, 0) + len(r.value) + 1
        at.setdefault(r.part, []).append(r.value)
    assert all(n <= 2048 or len(at[p]) == 1 for p, n in sizes.items()) and len(sizes) > 20
    assert [v for p in sorted(at) for v in at[p]] == [t for _, t in sorted(rows)]
    files = sorted(glob.glob(f"{folder}/documents/part=*/*.txt"))
    assert len(files) == len(sizes)  # a chunk is one file
    with open(files[3], "a") as file:
        file.write("one more\n")
    for name in glob.glob(f"{folder}/documents/part=*/.*.crc"):
        os.remove(name)
    with pytest.raises(ValueError, match="differs from its manifest"):
        reports.read_report(spark, folder)
    empty = str(tmp_path / "empty")
    reports.write_report(df.where("false"), empty, ["id"])
    assert reports.read_report(spark, empty).count() == 0


def test_run_metrics_are_taken_while_writing(spark, tmp_path):
    run = sinks.RunMetrics()
    for i in range(2):
        with run.stage("write"):
            df = run.observed(spark.range(50 * (i + 1)), rows=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
            df.write.parquet(str(tmp_path / f"t{i}"))
    found = {r.name: r.value for r in run.rows(spark).collect()}
    assert found.keys() == {"rows", "odd", "write_time_ms"}
    assert (found["rows"], found["odd"]) == (150, 75) and found["write_time_ms"] > 0


def test_rows_of_one_row_group_are_spread(spark, tmp_path, monkeypatch):
    """A file that gives more splits than there are cores, with all rows in one of them."""
    from logtide.sources import tables

    monkeypatch.setattr(tables, "PART_ROWS", 1000)
    spark.range(20000).withColumn("pad", F.sha2(F.col("id").cast("string"), 512)).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = tables.table(spark, str(tmp_path), "events")
        assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        spread = tables.spread_table(spark, str(tmp_path), "events")
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 20 and max(sizes) < 2000 and sum(sizes) == 20000
        spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
        assert tables.spread_table(spark, str(tmp_path), "none").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
