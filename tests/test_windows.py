import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import causality, explore, store, summary, timeline, windows


def first_superset(sets):
    """sets: list of frozensets in order of time -> index of the root of each."""
    distinct = list(dict.fromkeys(sets))
    order = sorted(range(len(distinct)), key=lambda i: (-len(distinct[i]), i))
    roots = {}
    for s in distinct:
        roots[s] = next(distinct[i] for i in order if s <= distinct[i])
    return [sets.index(roots[s]) for s in sets]


@pytest.mark.parametrize("shard", [3, 5000])
def test_merge_against_every_pair(spark, monkeypatch, shard):
    monkeypatch.setattr(windows, "SHARD", shard)
    rng = random.Random(11)
    sets = [frozenset(rng.sample(range(8), rng.randint(1, 5))) for _ in range(150)]
    rows = [(w, float(w * 30), 2, False, sorted(s), sorted(s)) for w, s in enumerate(sets)]
    rows.append((999, 99999.0, 1, True, [1], []))
    df = spark.createDataFrame(
        rows, "win long, epoch double, n long, all_info boolean, tids array<long>, error_tids array<long>"
    )
    merged, placed = windows.merge_windows(df)
    roots = first_superset(sets)
    assert {r.win: r.root_id for r in placed.collect()} == dict(enumerate(roots))
    for r in merged.collect():
        members = [w for w, root in enumerate(roots) if root == r.root_id]
        assert (r.start_epoch, r.end_epoch) == (members[0] * 30, members[-1] * 30 + 30)
        assert r.num_windows == len(members) and r.n == 2 * len(members)
        assert set(r.error_tids) == set().union(*(sets[w] for w in members))
    newest = windows.anomalies(merged).collect()
    assert [r.start_epoch for r in newest] == sorted((r.start_epoch for r in newest), reverse=True)


def labelled(spark, rows):
    df = spark.createDataFrame(rows, "line_seq long, file_name string, epoch double, template_id long, golden_signal string")
    return df.select(
        F.struct(F.lit(0).alias("section"), "file_name", F.lit(0).cast("long").alias("block_start"), "line_seq").alias("record_id"),
        "*", F.concat(F.lit("text "), F.col("line_seq").cast("string")).alias("text"),
        F.array(F.lit("io")).alias("fault_categories"),
    )


def random_rows(n, seed, files=3, span=900.0):
    rng = random.Random(seed)
    signals = ["information", "error", "latency"]
    return [
        (i, f"f{rng.randrange(files)}", rng.uniform(0, span), (t := rng.randrange(6)), signals[t % 3]) for i in range(n)
    ]


def test_windows_keep_first_epoch_and_order(spark):
    rows = [(5, "a", 12.0, 1, "error"), (2, "a", 20.0, 2, "Info"), (9, "A", 29.0, 3, "information"), (1, "b", 31.0, 2, "info")]
    got = {r.win: r for r in windows.tumbling_windows(labelled(spark, rows)).collect()}
    # The first record is the first by file and line, not by time.
    assert got[0].epoch == 29.0 and got[0].n == 3 and not got[0].all_info
    assert got[0].error_tids == [1] and got[0].tids == [1, 2, 3]
    assert got[1].all_info and got[1].error_tids == []


def test_documents_hold_every_item_in_order(spark):
    rows = labelled(spark, random_rows(500, 4))
    merged, placed = windows.merge_windows(windows.tumbling_windows(rows))
    items = windows.anomaly_items(rows, placed, merged)
    documents = windows.anomaly_documents(items, limit=600).collect()
    assert all(sum(len(t.encode()) for t in d.logs) <= 600 for d in documents)
    assert len(documents) > len({d.root_id for d in documents})
    assert sum(len(d.logs) for d in documents) == items.count()
    by_root = {}
    for d in sorted(documents, key=lambda d: (d.root_id, d.chunk)):
        by_root.setdefault(d.root_id, []).extend(d.logs)
    ordered = {}
    for r in items.orderBy("root_id", "win", "record_id").collect():
        ordered.setdefault(r.root_id, []).append(r.text_output)
    assert by_root == ordered


def viewer(items, unique, coloured):
    shown, seen = [], set()
    for tid, signal, line in items:
        is_signal = signal in windows.COLOURED
        if (coloured and not is_signal) or (unique and tid in seen):
            continue
        shown.append(line)
        if is_signal:
            seen.add(tid)
    return shown[:5]


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("coloured", [True, False])
def test_preview_as_in_the_viewer(spark, unique, coloured):
    rng = random.Random(8)
    rows = [(i, "f", rng.uniform(0, 90), rng.randrange(4), rng.choice(["information", "error"])) for i in range(80)]
    items = windows.window_items(labelled(spark, rows))
    got = {}
    for r in windows.window_preview(items, unique, coloured).orderBy("win", "record_id").collect():
        got.setdefault(r.win, []).append(r.record_id.line_seq)
    wanted = {}
    for win in range(3):
        inside = [(t, s, i) for i, _, e, t, s in rows if e // 30 == win]
        wanted[win] = viewer(inside, unique, coloured)
    assert got == wanted


@pytest.mark.parametrize("span,size", [(0, 30), (3000, 30), (3001, 60), (86400, 900), (8640000, 86400), (8640001, 90000), (90000000, 900000), (90000001, 903600)])
def test_bin_sizes(spark, span, size):
    df = spark.createDataFrame([(float(span),)], "s double")
    assert df.select(timeline.bin_seconds(F.col("s"))).first()[0] == size


def test_timeline_totals(spark):
    rows = random_rows(400, 6, span=40000.0)
    found = timeline.signal_timeline(labelled(spark, rows)).collect()
    assert sum(r["count"] for r in found) == 400
    for name in ("f0", "f1", "f2"):
        mine = [r for r in found if r.file_name == name]
        assert len(mine) == len({r.signal for r in mine}) * (max(r.bin_idx for r in mine) + 1)
    evolution = timeline.temporal_evolution(labelled(spark, rows)).collect()
    assert sum(r.error + r.latency for r in evolution) == sum(r[4] != "information" for r in rows)
    assert sorted(r.bin_idx for r in evolution) == list(range(len(evolution)))
    few = timeline.temporal_evolution(labelled(spark, [rows[0], rows[-1]])).collect()
    assert len(few) <= 32 and all(r.start_epoch is not None for r in few)


def test_summary_and_cards(spark):
    rows = labelled(spark, random_rows(300, 9))
    found = summary.template_summary(rows)
    assert found.agg(F.sum("d_tid_count")).first()[0] == 300
    assert abs(found.agg(F.sum("coverage")).first()[0] - 100) < 0.01
    listed = found.collect()
    info = [r.gs == "information" for r in listed]
    assert info == sorted(info)
    cards = summary.stat_cards(found).first()
    assert cards.total == len(listed) and cards.errors == sum(r.gs == "error" for r in listed)


def test_store_counts_all_files(spark):
    rows = labelled(spark, random_rows(200, 3, files=4)).withColumn("template", F.lit("a <*> <*>")).withColumn(
        "variables", F.array(F.lit("x"))
    )
    reps = rows.groupBy("template_id", "file_name").agg(
        F.min("golden_signal").alias("golden_signal"), F.first("fault_categories").alias("fault_categories")
    )
    whole = {r.template_id: r for r in store.template_table(rows, reps).collect()}
    files = {}
    for r in store.template_files(rows).collect():
        files.setdefault(r.template_id, {})[r.file_source] = r.n
    maps, pieces = {}, store.template_file_maps(store.template_files(rows), per_map=2).collect()
    assert all(len(r.file_sources) <= 2 for r in pieces) and len(pieces) > len(files)
    for r in pieces:
        maps.setdefault(r.template_id, {}).update(r.file_sources)
    assert maps == files and {t: r.file_count for t, r in whole.items()} == {t: len(f) for t, f in files.items()}
    assert all(r.var_count == 2 and r.occurrence_count == sum(files[t].values()) for t, r in whole.items())
    with pytest.raises(ValueError):
        store.template_table(rows.drop("variables"), reps)


def test_pages_cover_everything_once(spark):
    entries = spark.createDataFrame(
        [(i, i // 4, f"f{i % 3}") for i in range(57)], "entry_id long, timestamp long, file_source string"
    )
    for newest in (True, False):
        seen, after = [], None
        while True:
            rows = explore.page(entries, 10, after, newest).collect()
            if not rows:
                break
            seen += [r.entry_id for r in rows]
            after = (rows[-1].timestamp, rows[-1].file_source, rows[-1].entry_id)
        wanted = sorted(range(57), key=lambda i: ((-1 if newest else 1) * (i // 4), f"f{i % 3}", i))
        assert seen == wanted
    counts = {(r.facet, r.value): r.n for r in explore.facets(entries, ["file_source"]).collect()}
    assert counts == {("file_source", f"f{i}"): 19 for i in range(3)}


# --- causality ----------------------------------------------------------------------


def test_chi2_survival_against_integration():
    import math

    import numpy as np

    for df in range(1, 6):
        for x in (0.1, 1.0, 4.2, 11.0):
            # Midpoints of t = u^2, which is smooth at zero for one degree too.
            u = (np.arange(400000) + 0.5) * math.sqrt(x) / 400000
            density = u ** (df - 1) * np.exp(-u * u / 2) * 2 / (2 ** (df / 2) * math.gamma(df / 2))
            below = density.sum() * math.sqrt(x) / 400000
            assert causality.chi2_survival(x, df) == pytest.approx(1 - below, abs=1e-7)


def test_granger_finds_the_leader(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    lead = rng.normal(size=400)
    follow = np.concatenate([[0, 0], lead[:-2]]) + rng.normal(scale=0.3, size=400)
    noise = rng.normal(size=400)
    rows = [(1, 0.0, follow.tolist()), (2, 1.0, lead.tolist()), (3, 2.0, noise.tolist())]
    df = spark.createDataFrame(rows, "template_id long, since double, diffs array<double>")
    best = causality.granger_pairs(df, top_k=1).first()
    assert (best.first_id, best.second_id) == (1, 2) and best.min_p < 1e-10
    # The grid of blocks finds the same pairs as one block.
    one = {(r.first_id, r.second_id): r.min_p for r in causality.granger_pairs(df, None).collect()}
    cut = {(r.first_id, r.second_id): r.min_p for r in causality.granger_pairs(df, None, block=1).collect()}
    assert one.keys() == cut.keys() and all(one[k] == pytest.approx(cut[k]) for k in one)
    two_way = causality.granger_pairs(df, None, both_ways=True)
    assert two_way.count() >= len(one)


def test_granger_statistic_by_hand():
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=60), rng.normal(size=60)
    target = x[1:]
    alone = np.column_stack([x[:-1], np.ones(59)])
    joint = np.column_stack([x[:-1], y[:-1], np.ones(59)])
    ssr = [((target - m @ np.linalg.inv(m.T @ m) @ m.T @ target) ** 2).sum() for m in (alone, joint)]
    chi2 = 59 * (ssr[0] - ssr[1]) / ssr[1]
    assert causality.granger_p_values(x, y)[0] == pytest.approx(causality.chi2_survival(chi2, 1))
    assert causality.granger_p_values(np.ones(60), y) is None
    assert causality.granger_p_values(x[:10], y[:10]) is None


def test_containing_sets(spark, monkeypatch):
    monkeypatch.setattr(windows, "SHARD", 7)
    rng = random.Random(12)
    sets = list({frozenset(rng.sample(range(14), rng.randint(1, 6))) for _ in range(160)} | {frozenset(range(14))})
    rows = [(i, (-len(s), i), sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "set_id long, rank struct<s:int,w:long>, tids array<long>")
    found = windows.containing_sets(df)
    assert {r.set_id: r.root_id for r in found.collect()} == {
        i: min((-len(b), j) for j, b in enumerate(sets) if s <= b)[1] for i, s in enumerate(sets)
    }
    # Sets are ids in every exchange.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "tids" in line and "Scan" not in line]


def test_granger_grid_equals_single_fits():
    """Moments of all pairs at once against a fit for each pair and lag, dependent and constant series included."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.diff(rng.poisson(0.8, (9, 301)), axis=1).astype(float)
    y = np.diff(rng.poisson(0.1, (8, 301)), axis=1).astype(float)
    y[0], y[1], y[2], y[3] = x[0], 0.0, 0.0, 2 * x[1]
    y[2, 150], y[4, 1:] = 1.0, x[3, :-1]
    found, good = causality.granger_grid(x, y)
    for i in range(len(x)):
        for j in range(len(y)):
            one = causality.granger_p_values(x[i], y[j])
            assert good[i, j] == (one is not None)
            if one is not None:
                assert found[i, j].tolist() == pytest.approx(one, abs=1e-7)
    wanted = np.zeros((9, 8), bool)
    wanted[2, 6] = True
    assert np.array_equal(causality.granger_grid(x, y, wanted)[1], wanted)
    assert not causality.granger_grid(x[:, :16], y[:, :16])[1].any()


def test_series_count_each_window(spark):
    rng = random.Random(4)
    rows = [(i, "f", rng.uniform(0, 5000), i % 2, "error") for i in range(300)] + [(300, "f", 0.0, 5, "error"), (301, "f", 5000.0, 5, "error")]
    found = {r.template_id: r["values"] for r in causality.template_series(labelled(spark, rows)).collect()}
    width, stride = 25.0, 5
    starts = [k * stride for k in range(1000) if k * stride + width <= 5000.0]
    for t in (0, 1):
        times = [e for _, _, e, tid, _ in rows if tid == t]
        assert found[t] == [sum(s <= e < s + width for e in times) for s in starts]
    assert 5 not in found  # too few distinct counts


def test_set_blocks_find_the_first_that_holds():
    """Members in many sets are bits and others places; both against every pair."""
    import numpy as np

    rng = random.Random(14)
    for n, members in ((1, 3), (70, 6), (400, 9), (400, 300)):
        sets = [sorted(rng.sample(range(members), rng.randint(1, min(members, 5)))) for _ in range(n)]
        block = windows.SetBlock([np.array(s) for s in sets])
        assert n < 400 or members < 300 or len(block.bits) < len(block.lists)
        for asking in [*sets, [members], [0, members], []]:
            wanted = next((i for i, s in enumerate(sets) if asking and set(asking) <= set(s)), None)
            assert block.first_with(asking) == wanted


def test_windows_that_share_one_template(spark):
    """None holds another; windows without a time or a template with an id have no root."""
    rows = [(w, float(w * 30), 1, False, [0, w], [0, w]) for w in range(1, 300)] + [(None, None, 1, False, [5], [5])]
    rows.append((400, 12000.0, 1, False, [], []))
    df = spark.createDataFrame(
        rows, "win long, epoch double, n long, all_info boolean, tids array<long>, error_tids array<long>"
    )
    _, placed = windows.merge_windows(df)
    assert {r.win: r.root_id for r in placed.collect()} == {w: w for w in range(1, 300)}
