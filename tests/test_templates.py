import os
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import classify, tags, templates
from logtide.plans import common
from logtide.plans.common import dense_id, join_by_key
from logtide.registry import queries


def with_ids(spark, lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_seq long, truncated_log string")
    return df.repartition(4).select(
        F.struct(
            F.lit(0).alias("section"), F.lit("a.log").alias("file_name"),
            F.lit(0).cast("long").alias("block_start"), "line_seq",
        ).alias("record_id"),
        "truncated_log",
    )


def one_by_one(shapes, similarity=0.4):
    """Shapes in order of appearance, compared with the templates of their leaf."""
    leaves, home = {}, {}
    for shape in shapes:
        words = shape.split()
        lead = words[0] if words and not any(c.isdigit() for c in words[0]) else "<*>"
        clusters = leaves.setdefault((len(words), lead), [])
        best, rank = None, None
        for cluster in clusters:
            equal = sum(a == b != "<*>" for a, b in zip(cluster, words))
            this = (equal, sum(w == "<*>" for w in cluster))
            if rank is None or this > rank:
                best, rank = cluster, this
        if not words and clusters:
            home[shape] = clusters[0]
        elif best is not None and rank[0] / len(words) >= similarity:
            best[:] = [a if a == b else "<*>" for a, b in zip(best, words)]
            home[shape] = best
        else:
            clusters.append(words)
            home[shape] = words
    return {shape: " ".join(cluster) for shape, cluster in home.items()}


def sample_lines(n, seed):
    rng = random.Random(seed)
    kinds = ["open file {} by {}", "close file {} now", "user {} logged in from {}", "disk {} is {} full of {}", "{}", ""]
    words = ["alpha", "beta", "gamma", "delta", "x1", "y2"]
    return [_fill(rng, kinds, words) for _ in range(n)]


def _fill(rng, kinds, words):
    kind = rng.choice(kinds)
    return kind.format(*[rng.choice(words) for _ in range(kind.count("{}"))])


def test_equals_one_by_one_learning(spark):
    lines = sample_lines(600, 5)
    records = with_ids(spark, lines)
    templated, table = templates.mine_templates(records)
    wanted = one_by_one(list(dict.fromkeys(lines)))
    rows = templated.collect()
    assert len(rows) == len(lines)
    assert {r.truncated_log: r.template for r in rows} == wanted
    # Ids follow first appearance, sizes count the lines.
    order = list(dict.fromkeys(wanted[t] for t in lines))
    got = {r.template: r for r in table.collect()}
    assert [got[t].template_id for t in order] == list(range(1, len(order) + 1))
    assert sum(r.occurrences for r in got.values()) == len(lines)
    listed = templates.extract_templates(table).collect()
    assert [r.occurrences for r in listed] == sorted((r.occurrences for r in listed), reverse=True)


def test_large_leaf_has_one_rule(spark):
    """More than 20,000 shapes in one leaf: pairs that belong together, and one template that takes many."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    pairs = [(word(), word(), word()) for _ in range(300)]
    lines = [f"start {a} {b} {c} {word()} end{word()}" for a, b, c in pairs for _ in (0, 1)]
    lines += [f"start red task of {word()} {word()}" for _ in range(20_500)]
    templated, table = templates.mine_templates(with_ids(spark, lines))
    found = {r.template: r.occurrences for r in table.collect()}
    assert found == {f"start {a} {b} {c} <*> <*>": 2 for a, b, c in pairs} | {"start red task of <*> <*>": 20_500}
    assert templated.count() == len(lines)


def mixed_shapes(n, seed):
    """Lines of a few leaves: families that share rare tokens, tokens that all share, digits first, two tokens."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    out = []
    for i in range(n):
        family = rng.randrange(60)
        out.append(rng.choice([
            f"job f{family}a of f{family}b {word()} {word()} at {word()}",
            f"job {word()} of {word()} {word()} {word()} at {word()}",
            f"x{rng.randrange(30)} {word()} f{family} {word()}",
            f"ping {word()}", f"x{rng.randrange(400)}",
        ]))
    return out


@pytest.mark.parametrize("similarity", [0.3, 0.4, 0.7])
def test_split_leaves_equal_one_task(spark, similarity):
    lines = mixed_shapes(1500, 3)
    shapes = templates.distinct_shapes(with_ids(spark, lines))
    whole, all_templates = templates.mine_shapes(shapes, similarity)
    split, some_templates = templates.mine_shapes(shapes, similarity, split=20)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(whole.select("key", "template")) == same(split.select("key", "template"))
    assert same(all_templates) == same(some_templates)
    assert len({r.template for r in whole.collect()}) > 20


def test_a_leaf_of_100000_shapes_is_spread(spark):
    """Families that share tokens with none but their own: the leaf is learned in many parts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(14))
    families = [(word(), word()) for _ in range(400)]
    lines = [f"start {a} {b} {word()} {word()} done{word()}" for a, b in families for _ in range(250)]
    shapes = templates.distinct_shapes(with_ids(spark, lines))
    assert shapes.select("length", "lead").distinct().count() == 1
    parts = templates.leaf_parts(shapes, 0.4).groupBy("part").count().collect()
    assert len(parts) == 400 and {r["count"] for r in parts} == {250}
    assigned, table = templates.mine_shapes(shapes)
    assert {r.template: r.occurrences for r in table.collect()} == {f"start {a} {b} <*> <*> <*>": 250 for a, b in families}
    assert assigned.count() == 100_000


def _tables(path):
    return sorted(name.rsplit("-", 1)[0] for name in os.listdir(path) if not name.startswith("."))


@pytest.mark.parametrize("split", [5, 10_000])
def test_mining_leaves_its_results_alone(spark, tmp_path, monkeypatch, split):
    """What is written on the way is deleted; texts of templates are kept once, shapes have numbers."""
    records = with_ids(spark, mixed_shapes(400, 4))
    shapes = templates.distinct_shapes(records)

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assigned, table = templates.mine_shapes(shapes, split=split)
    assert assigned.count() == shapes.count() and table.count() == table.distinct().count()
    assert _tables(tmp_path) == ["assigned", "templates"]
    assert "template" not in spark.read.parquet(str(next(tmp_path.glob("assigned-*")))).columns


def test_mined_query_deletes_its_cut_points(spark, tmp_path, monkeypatch):
    rows = [(i, f"a{i % 7} start\nunit {i} down\n\nred  _ end", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.sql(
        "SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts, 'error' AS event_type,"
        " id % 9 AS user_id, 1.5D AS value, '{}' AS props FROM range(50)"
    ).write.parquet(f"{tmp_path}/in/events.parquet")
    (tmp_path / "kept").mkdir()
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/kept")
    found = queries.QUERIES["mine_templates"](spark, f"{tmp_path}/in").collect()
    assert len(found) == 50 + 4 * 40
    assert _tables(tmp_path / "kept") == ["assigned", "records", "templates"]
    written = spark.read.parquet(str(next((tmp_path / "kept").glob("records-*"))))
    assert [c for c, kind in written.dtypes if kind == "string" and c not in ("file_name", "shape_key")] == ["truncated_log", "shape"]
    # A shape is written where it is not the text itself.
    assert {r.shape for r in written.where("file_name = 's.txt'").collect()} == {None, "unit <:NUM:> down", "red end"}


def test_ids_of_templates_with_the_same_first_record(spark):
    """Records may come twice, with other texts: the smaller template goes first."""
    twice = with_ids(spark, ["b one", "a two", "c"])
    same = twice.withColumn("record_id", F.col("record_id").withField("line_seq", F.lit(3).cast("long")))
    records = same.where("truncated_log <> 'c'").unionByName(twice.where("truncated_log = 'c'"))
    _, table = templates.mine_templates(records)
    assert {r.template: r.template_id for r in table.collect()} == {"c": 1, "a two": 2, "b one": 3}


def test_large_leaf_is_learned_by_its_rare_tokens():
    """12,000 shapes that share a frame and differ in the rest: only templates with enough rare tokens are compared."""
    rng = random.Random(4)
    frame = ["start", "the", "of", "the", "and"]
    lines = list(dict.fromkeys(
        " ".join([*frame, *(f"w{rng.randrange(3000)}" for _ in range(8))]) for _ in range(12_000)
    ))
    leaf = templates.LeafTemplates(0.7)
    touched = 0

    class Counted(set):
        def __iter__(self):
            nonlocal touched
            touched += len(self)
            return super().__iter__()

    for line in lines:
        words = line.split(" ")
        leaf.learn(words)
        for place in (0, 1):  # the sets of the frame are only looked up
            held = leaf.holders and leaf.holders[place].get(words[place])
            if type(held) is set:
                leaf.holders[place][words[place]] = Counted(held)
    assert len(leaf.templates) > 11_000 and touched == 0


def test_a_single_template_needs_no_index():
    leaf = templates.LeafTemplates(0.4)
    assert leaf.learn(["a", "b", "c"]) == 0 and not leaf.holders
    assert leaf.learn(["a", "b", "d"]) == 0 and leaf.templates == [["a", "b", "<*>"]]
    assert leaf.learn(["x", "y", "d"]) == 1


def test_connected(spark):
    from logtide.plans.groups import connected

    links = [(i + 1, i) for i in range(300) if i % 50 != 49] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: i - i % 50 for i in range(300)} | {1000: 1000, 1001: 1000}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_learning_equals_one_by_one_at_any_similarity(similarity):
    lines = list(dict.fromkeys(sample_lines(800, 7)))
    wanted = one_by_one(lines, similarity)
    leaves, chosen = {}, {}
    for line in lines:
        words = line.split(" ")
        lead = words[0] if not any(c.isdigit() for c in words[0]) else "<*>"
        leaf = leaves.setdefault((len(words) if line else 0, lead), templates.LeafTemplates(similarity))
        chosen[line] = leaf, leaf.learn(words) if line else 0 if leaf.templates else leaf.add(words)
    assert {line: " ".join(leaf.templates[i]) for line, (leaf, i) in chosen.items()} == wanted


def test_match_templates(spark):
    table = spark.createDataFrame(
        [(1, "open file <*> by <*>"), (2, "open file big by root"), (3, "<*> <*> x <*>"), (4, "")],
        "template_id long, template string",
    )
    lines = ["open file a by b", "open file big by root", "p q x r", "p1 q x r", "none of these", ""]
    records = with_ids(spark, lines).withColumnRenamed("truncated_log", "text")
    got = {r.text: r.template_id for r in templates.match_templates(records, table).collect()}
    assert got == {
        "open file a by b": 1, "open file big by root": 2, "p q x r": None, "p1 q x r": 3, "none of these": None, "": 4,
    }


def plain_match(line, known, similarity):
    """Every template of the leaf compared with the line; known has (id, template)."""
    words = line.split(" ")
    lead = lambda t: "<*>" if t[0] == "<*>" or any(c.isdigit() for c in t[0]) else t[0]
    best = None
    for number, template in known:
        other = template.split(" ")
        if len(other) != len(words) or lead(other) != lead(words) or (line == "") != (template == ""):
            continue
        equal, wild = sum(a == b != "<*>" for a, b in zip(words, other)), other.count("<*>")
        if not line or equal / len(words) >= similarity or equal + wild >= len(words):
            best = max(best or (-1, 0, 0), (equal, wild, -number))
    return -best[2] if best else None


@pytest.mark.parametrize("similarity", [0.3, 0.4, 0.8])
def test_match_equals_comparison_with_all(spark, similarity):
    rng = random.Random(6)
    known = dict.fromkeys(
        " ".join(w if rng.random() < 0.6 else "<*>" for w in t.split(" ")) for t in mixed_shapes(300, 5)
    )
    known = list(enumerate([*known, "", "<*> <*>", "ping <*>", "job <*> of <*> <*> <*> at <*>"], 1))
    table = spark.createDataFrame(known, "template_id long, template string")
    lines = [*dict.fromkeys(mixed_shapes(400, 6)), ""]
    records = with_ids(spark, lines).withColumnRenamed("truncated_log", "text")
    got = {r.text: r.template_id for r in templates.match_templates(records, table, similarity=similarity).collect()}
    assert got == {line: plain_match(line, known, similarity) for line in lines}


def test_match_with_10000_templates_in_a_leaf(spark):
    """Templates are found by their rare tokens: pairs compared grow with the shapes, not with their product."""
    known = [(i, f"start unit u{i}x on <*> now") for i in range(1, 10_001)]
    table = spark.createDataFrame(known, "template_id long, template string")
    lines = [f"start unit u{i}x on host{chr(97 + i % 20)} now" for i in range(1, 10_001, 5)]
    records = with_ids(spark, lines).withColumnRenamed("truncated_log", "text")
    found = templates.match_templates(records, table, similarity=0.8)
    assert sorted(r.template_id for r in found.collect()) == list(range(1, 10_001, 5))


def test_exact_templates(spark):
    records = with_ids(spark, ["a_b 12", "a b 7", "c"])
    got = {r.template: r.occurrences for r in templates.exact_templates(records).collect()}
    assert got == {"a b <:NUM:>": 2, "c": 1}


def test_join_by_key(spark):
    rows = spark.range(20000).selectExpr("id", "if(id % 3 = 0, 0, id % 5000) AS k")
    table = rows.groupBy("k").count().where("k <> 7").selectExpr("k", "count AS n", "k * 10 AS v")
    out = join_by_key(rows, table, ["k"], "n")
    assert out.columns == ["id", "k", "v"] and out.count() == 20000
    assert out.where("k <> 7 AND (v IS NULL OR v <> k * 10)").count() == 0
    assert out.where("k = 7 AND v IS NOT NULL").count() == 0
    inner = join_by_key(rows, table, ["k"], "n", "inner")
    assert inner.count() == rows.where("k <> 7").count()


def test_many_equally_hot_keys_are_split(spark, tmp_path):
    """1,001 keys of the same weight: each is joined in several tasks, without a broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.shuffle.partitions": "301",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 1_001 * 2000, 1, 16).selectExpr("id % 1001 AS k", "id", "uuid() AS text")
        table = spark.range(1001).selectExpr("id AS k", "2000L AS n", "id + 1 AS v")
        out = join_by_key(rows, table, ["k"], "n")
        out.write.parquet(str(tmp_path / "joined"))  # a file per task
        written = spark.read.parquet(str(tmp_path / "joined")).groupBy("k").agg(
            F.countDistinct("_metadata.file_name").alias("tasks"), F.count_if(F.expr("v <> k + 1")).alias("wrong"),
            F.count("v").alias("n"),
        )
        found = written.agg(F.min("tasks").alias("least"), F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).first()
        assert found.least > 1 and not found.wrong and found.n == 1_001 * 2000
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dense_id(spark):
    df = spark.range(5000).selectExpr("pmod(hash(id), 100000) AS x", "id")
    got = dense_id(df, [F.col("x"), F.col("id")], "pos").orderBy("x", "id").select("pos").collect()
    assert [r.pos for r in got] == list(range(5000))


def test_component_of_first_record(spark):
    lines = ["[error] a", "[auth] a", "quiet"]
    df = with_ids(spark, lines).withColumnRenamed("truncated_log", "text").withColumn(
        "template_id", F.when(F.col("text") == "quiet", 2).otherwise(1)
    )
    config = {"tags": [{"name": "E", "keywords": ["error"]}, {"name": "A", "keywords": ["auth"]}], "default_tag": "O"}
    got = {r.text: r.component for r in tags.tag_components(df, config).collect()}
    assert got == {"[error] a": "E", "[auth] a": "E", "quiet": "O"}


@pytest.mark.parametrize("top,faults", [("latency", ["io", "network"]), ("error", ["device"])])
def test_fault_threshold(spark, top, faults):
    scored = [("io", 0.4), ("network", 0.3), ("device", 0.1)] if top == "latency" else [("device", 0.2), ("io", 0.1)]
    df = spark.createDataFrame([(scored,)], "s array<struct<label:string,score:double>>")
    assert df.select(classify.fault_labels(F.col("s"))).first()[0] == faults


def test_classifier_contract(spark):
    reps = spark.createDataFrame(
        [(1, "a", 3, "slow disk"), (2, "a", 1, "all fine")], "template_id long, file_name string, n long, rep_text string"
    )
    calls = []

    def factory():
        def predict(texts):
            calls.append(len(texts))
            return [[("error", 0.9)] if "slow" in t else [("information", 0.8)] for t in texts]
        return predict

    def faults():
        return lambda texts: [[("device", 0.9), ("io", 0.3)] for _ in texts]

    out = classify.label_representatives(
        reps,
        lambda df: classify.CLASSIFIERS["callable"](df, factory, batch_size=1),
        lambda df: classify.classify_callable(df, faults),
    )
    got = {r.template_id: (r.golden_signal, r.fault_categories) for r in out.collect()}
    assert got == {1: ("error", ["device", "io"]), 2: ("information", ["other"])}
