"""Tumbling windows, merging of windows whose error templates contain one another.

Windows are one row each with bounded columns; the records of a window stay
rows (``window_items``), because one window may hold any share of the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.functions.text import annotated_line, duration_label, preview, strip_tags
from logtide.functions.timestamps import epoch_to_utc_string
from logtide.operators.classify import first_fault, is_info
from logtide.plans.common import join_by_key, materialize, running_sums
from logtide.plans.places import place_in_file, place_order
from logtide.sources.sinks import CHUNK_BYTES, chunk_by_bytes

# Window length, and the signals a viewer shows in colour.
WINDOW_SECONDS = 30
COLOURED = ["latency", "error", "availability", "saturation", "traffic"]
SHARD = 20_000  # sets of a block at most; one of many members counts as several
MEMBERS = 128  # members that a set has for each time it counts once more


def window_items(labelled: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Labelled records with the number of their window."""
    return labelled.withColumn("win", F.floor(F.col("epoch") / seconds))


def window_templates(records: DataFrame, *keys: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Records reduced to one row per window, template, file and further keys."""
    placed = window_items(records, seconds).select(
        "win", "template_id", F.col("record_id.file_name").alias("file_name"), *keys, "epoch",
        place_in_file().alias("place"),
    )
    found = placed.groupBy("win", "template_id", "file_name", *keys).agg(
        F.min("place").alias("place"), F.min_by("epoch", "place").alias("epoch"), F.count(F.lit(1)).alias("n")
    )
    first = F.struct(place_order("file_name", "place").alias("place"), "epoch").alias("first")
    return found.select("win", "template_id", "file_name", *keys, first, "n")


def windows_of_templates(reduced: DataFrame) -> DataFrame:
    """Windows from labelled rows of ``window_templates``."""
    info = is_info(F.col("golden_signal"))
    error = F.when(~info, F.col("template_id"))
    return reduced.groupBy("win").agg(
        F.min("first").alias("first"),
        F.sum("n").alias("n"),
        F.every(info).alias("all_info"),
        F.sort_array(F.collect_set("template_id")).alias("tids"),
        F.sort_array(F.collect_set(error)).alias("error_tids"),
    ).select("win", F.col("first.epoch").alias("epoch"), "n", "all_info", "tids", "error_tids")


def tumbling_windows(labelled: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per window: first epoch, records, all_info, distinct error templates."""
    return windows_of_templates(window_templates(labelled, "golden_signal", seconds=seconds))


def normal_windows(windows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Windows with information only, times as text."""
    return windows.where("all_info").select(
        "win", epoch_to_utc_string(F.col("epoch")).alias("start_ts"),
        epoch_to_utc_string(F.col("epoch") + seconds).alias("end_ts"), "n", "tids",
    )


def normal_window_lines(labelled: DataFrame, windows: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The records of the windows with information only, as rows, with the window's times."""
    spans = normal_windows(windows, seconds).select("win", "start_ts", "end_ts")
    return join_by_key(window_items(labelled, seconds), spans, ["win"], how="inner")


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.agg(
        F.count_if("all_info").alias("normal_windows"),
        F.count_if(~F.col("all_info")).alias("anomalous_windows"),
    )


class SetBlock:
    """Sets in order of rank, and for each member which of them have it: bits if many do, places if few."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        sizes = np.array([len(s) for s in sets])
        members = np.concatenate(sets) if self.n else np.empty(0, np.int64)
        places = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        order = np.argsort(members, kind="stable")
        self.tids, starts = np.unique(members[order], return_index=True)
        self.lists = np.split(places[order], starts[1:])
        self.at = {tid: i for i, tid in enumerate(self.tids.tolist())}
        self.bits: dict[int, np.ndarray] = {}
        for i, held in enumerate(self.lists):
            # 64 places take as much room as all bits do.
            if len(held) * 64 >= self.n:
                flags = np.zeros(-(-self.n // 64) * 64, np.bool_)
                flags[held] = True
                self.bits[i] = np.packbits(flags, bitorder="little").view(np.uint64)

    def first_with(self, tids: list[int]) -> int | None:
        """The place of the first set that has all the members."""
        held = [self.at.get(t) for t in tids]
        if not held or None in held:
            return None
        held.sort(key=lambda i: len(self.lists[i]))
        rarest = held[0]
        if rarest in self.bits:
            left = self.bits[rarest].copy()
            for k, i in enumerate(held[1:], 1):
                np.bitwise_and(left, self.bits[i], out=left)
                if k % 8 == 0 and not left.any():
                    return None
            words = np.flatnonzero(left)
            if not len(words):
                return None
            word = int(left[words[0]])
            return int(words[0]) * 64 + (word & -word).bit_length() - 1
        found = self.lists[rarest]
        for i in held[1:]:
            if i in self.bits:
                word = self.bits[i][found >> 6]
                found = found[(word >> (found & 63).astype(np.uint64)) & np.uint64(1) == 1]
            else:
                found = np.intersect1d(found, self.lists[i], assume_unique=True)
            if not len(found):
                return None
        return int(found[0])


def _first_holders(key: tuple, asking: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each asking set the first set of a block that holds it, if any does."""
    asked = asked.sort_values("place")
    block = SetBlock(list(asked["tids"]))
    found = [block.first_with(t.tolist()) for t in asking["tids"]]
    rows = [(s, i) for s, i in zip(asking["set_id"], found) if i is not None]
    at = [i for _, i in rows]
    return pd.DataFrame({
        "set_id": pd.Series([s for s, _ in rows], dtype="int64"),
        "place": asked["place"].iloc[at].to_numpy(dtype="int64"), "root_id": asked["set_id"].iloc[at].to_numpy(dtype="int64"),
    })


def containing_sets(sets: DataFrame) -> DataFrame:
    """For distinct sets (set_id, rank, tids): the first set by rank that holds it.

    ``rank`` puts larger sets first, so a set is held only by itself and sets before it. Blocks
    of sets in a row, cut by their members, ask themselves and the blocks before them; a block
    is asked by intersecting the bits of a set's members, rarest first, so that no pairs of sets
    are made. A set without members or id has none that holds it.
    """
    placed = materialize(running_sums(
        sets.where((F.size("tids") > 0) & F.col("set_id").isNotNull()).select("set_id", "rank", "tids"), [F.col("rank")],
        {"place": F.lit(1).cast("long"), "weight": F.floor(F.size("tids") / MEMBERS) + 1},
    ).select("set_id", "place", "tids", F.floor(F.col("weight") / SHARD).cast("int").alias("block")), "ranked-sets")
    last = placed.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    asking = placed.select("set_id", "tids", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), "block")).alias("b"))
    asked = placed.select(
        "set_id", "place", "tids", F.explode(F.sequence("block", F.lit(last))).alias("a"), F.col("block").alias("b")
    )
    held = asking.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInPandas(
        _first_holders, "set_id long, place long, root_id long"
    )
    # Both results of merge_windows ask for the holders; the sets themselves move once.
    return materialize(held, "set-holders").groupBy("set_id").agg(F.min_by("root_id", "place").alias("root_id"))


def merge_windows(windows: DataFrame, seconds: int = WINDOW_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(merged anomalies, win -> root) of the windows that are not all information.

    A window joins the first window, by size of its error set and then by time,
    whose error set contains its own.
    """
    anomalous = windows.where("NOT all_info").withColumn(
        "set_key", F.md5(F.array_join("error_tids", " "))
    )
    sets = anomalous.groupBy("set_key").agg(
        F.min("win").alias("set_id"), F.any_value("error_tids").alias("tids")
    ).withColumn("rank", F.struct((-F.size("tids")).alias("s"), F.col("set_id").alias("w")))
    roots = containing_sets(sets.select("set_id", "rank", "tids"))
    keyed = sets.select("set_key", "set_id").join(roots, "set_id").select("set_key", "root_id")
    placed = anomalous.join(keyed, "set_key")
    merged = placed.groupBy("root_id").agg(
        F.min("epoch").alias("start_epoch"),
        (F.max("epoch") + seconds).alias("end_epoch"),
        F.count(F.lit(1)).alias("num_windows"),
        F.sum("n").alias("n"),
        # The root's set holds all others, so it is the longest.
        F.max_by("error_tids", F.struct(F.size("error_tids"), -F.col("win"))).alias("error_tids"),
    )
    return merged, placed.select("win", "root_id", "n")


def anomalies(merged: DataFrame) -> DataFrame:
    """Report rows, newest first."""
    return merged.select(
        "root_id", "start_epoch", "end_epoch",
        epoch_to_utc_string(F.col("start_epoch")).alias("start_ts"),
        epoch_to_utc_string(F.col("end_epoch")).alias("end_ts"),
        "num_windows", "n", "error_tids", F.lit("Anomaly").alias("list_result"),
    ).orderBy(F.desc("start_epoch"), F.desc("end_epoch"), F.desc("root_id"))


def anomaly_items(labelled: DataFrame, placed: DataFrame, merged: DataFrame) -> DataFrame:
    """The records of merged anomalies, one row each, with the report line."""
    # The two small tables meet first, the records once.
    spans = placed.select("win", "root_id").join(merged.select("root_id", "start_epoch", "end_epoch"), "root_id")
    items = join_by_key(window_items(labelled), spans, ["win"], how="inner")
    return items.withColumn(
        "text_output",
        annotated_line(F.col("text"), first_fault(F.col("fault_categories")), F.col("golden_signal")),
    )


def anomaly_documents(items: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Report documents: the items of an anomaly in time order, in pieces of at most
    ``limit`` bytes of report lines."""
    order = ["start_epoch", "root_id", "win", "record_id"]
    chunked = chunk_by_bytes(items, order, limit, F.octet_length("text_output"))
    item = F.struct(
        "win", "record_id", strip_tags(F.col("text_output")).alias("log"),
        "file_name", "golden_signal", "template_id",
    )
    pieces = chunked.groupBy("root_id", "chunk").agg(
        F.first("start_epoch").alias("start_epoch"), F.first("end_epoch").alias("end_epoch"),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    return pieces.select(
        "root_id", "chunk",
        duration_label(
            epoch_to_utc_string(F.col("start_epoch")), epoch_to_utc_string(F.col("end_epoch"))
        ).alias("duration"),
        F.col("items.log").alias("logs"), F.col("items.file_name").alias("files"),
        F.col("items.golden_signal").alias("gs"), F.col("items.template_id").alias("templateIds"),
    )


def window_preview(
    items: DataFrame, unique: bool = True, coloured: bool = True, count: int | None = 5
) -> DataFrame:
    """First entries per window: coloured signals only, one per template, or both.

    With ``unique`` but not ``coloured``, only coloured entries use up their
    template, as in the viewer.
    """
    signal = F.col("golden_signal").isin(*COLOURED)
    chosen = items.where(signal) if coloured else items
    columns = ["win", "template_id", "record_id", "file_name", "golden_signal", "text"]
    chosen = chosen.select(*columns, signal.alias("coloured"))
    if unique:
        once = chosen.groupBy("win", "template_id").agg(
            F.min_by(F.struct(*columns, "coloured"), "record_id").alias("f"),
            F.min(F.when(F.col("coloured"), F.col("record_id"))).alias("since"),
        )
        if coloured:
            chosen = once.select("f.*")
        else:
            weights = items.groupBy("win", "template_id").agg(F.count(F.lit(1)).alias("n")).join(
                once.select("win", "template_id", "since"), ["win", "template_id"]
            )
            chosen = join_by_key(chosen, weights, ["win", "template_id"], "n")
            chosen = chosen.where("since IS NULL OR record_id <= since").drop("since")
    if count is not None:
        place = F.row_number().over(Window.partitionBy("win").orderBy("record_id"))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= count).drop("place")
    return chosen.drop("coloured").withColumn("text", preview(F.col("text")))
