"""First records of groups: against sorted rows, and the plans that find them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import classify, store, templates, windows
from logtide.plans import places
from logtide.registry.queries import labelled_events

DATA = "/root/testdata/sf0.001"
ID = "section int, file_name string, block_start long, line_seq long"


@pytest.fixture(scope="module")
def rows():
    """(record_id, group, text): two sections, files out of order, blocks, leading lines, a null group."""
    rng = random.Random(5)
    made = {
        (rng.randrange(3), f"f{rng.randrange(9)}", rng.choice([-1, 0, 1 << 27, 10**16]), rng.randrange(-1, 1 << 62))
        for _ in range(3000)
    }
    return [(i, rng.choice([None, *range(40)]), f"text {i}") for i in sorted(made)]


@pytest.mark.parametrize("few", [0, places.FEW])
@pytest.mark.parametrize("keys", [["g"], ["g", "file_name"]])
def test_first_records_equal_sorted_rows(spark, rows, few, keys):
    df = spark.createDataFrame(rows, f"record_id struct<{ID}>, g int, text string").repartition(5)
    df = df.withColumn("file_name", F.col("record_id.file_name"))
    wanted, counts = {}, {}
    for record_id, group, text in rows:
        key = (group, record_id[1])[: len(keys)]
        wanted.setdefault(key, text)
        counts[key] = counts.get(key, 0) + 1
    found = places.first_records(df, keys, ["text", "record_id"], few=few).collect()
    assert {tuple(r[k] for k in keys): (r.text, r.n) for r in found} == {k: (wanted[k], counts[k]) for k in wanted}
    assert len(found) == len(wanted)
    assert places.first_records(df.where("false"), keys, ["text"], few=few).count() == 0


def test_place_beyond_its_room_is_refused(spark):
    df = spark.createDataFrame([((0, "a", 10**17, 0),)], f"record_id struct<{ID}>")
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        df.select(places.place_in_file()).collect()


def test_bitmap_keeps_what_is_there_and_drops_most_others(spark):
    rows = spark.range(50_000).withColumn("t", F.col("id").cast("string"))
    table = rows.where("id % 100 = 3")
    kept = {r.id for r in places.likely_in(rows, table, ["id", "t"]).collect()}
    assert {r.id for r in table.collect()} <= kept
    assert len(kept) < 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_no_records_are_sorted_for_their_first(spark):
    """Records meet hash aggregates alone; texts come by a join."""
    labelled = labelled_events(spark, DATA)
    reps = classify.representatives(labelled)
    shapes = templates.distinct_shapes(labelled, "text")
    reduced = windows.window_templates(labelled, "golden_signal")
    table = store.template_table(
        labelled, classify.label_representatives(reps).select("template_id", "file_name", "n", "golden_signal", "fault_categories")
    )
    for df in (reps, shapes, reduced):
        assert "SortAggregate" not in plan_of(df)
    # Where text is aggregated, two rows a template are left.
    assert plan_of(table).count("Scan parquet") >= 2
    narrow = windows.windows_of_templates(reduced)
    assert "SortAggregate" not in plan_of(narrow)
