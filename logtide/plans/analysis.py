"""The whole analysis: lines in, labelled records and report tables out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from logtide.functions import timestamps
from logtide.operators import classify, records, store, summary, tags, templates, timeline, windows
from logtide.plans.common import materialize


@dataclass
class Analysis:
    """Tables of one run. ``templated`` is written once; the rest is planned on use."""

    templated: DataFrame
    templates: DataFrame
    discarded: DataFrame
    tag_config: dict | None = None
    signal_classifier: Callable[[DataFrame], DataFrame] | None = None
    fault_classifier: Callable[[DataFrame], DataFrame] | None = None

    @cached_property
    def representatives(self) -> DataFrame:
        return materialize(classify.representatives(self.templated), "representatives")

    @cached_property
    def components(self) -> DataFrame | None:
        if not self.tag_config:
            return None
        return tags.components_of_representatives(self.representatives, self.tag_config)

    def tagged(self) -> DataFrame:
        """Records with their component."""
        return tags.tag_components(self.templated, self.tag_config or {}, self.components)

    @cached_property
    def signals(self) -> DataFrame:
        labelled = classify.label_representatives(
            self.representatives, self.signal_classifier, self.fault_classifier
        )
        return materialize(labelled, "signals")

    @cached_property
    def labelled(self) -> DataFrame:
        return materialize(classify.spread_signals(self.templated, self.signals), "labelled")

    @cached_property
    def windows(self) -> DataFrame:
        # Labels join the reduced rows, not the records.
        reduced = windows.window_templates(self.templated)
        labelled = classify.spread_signals(reduced, self.signals)
        return materialize(windows.windows_of_templates(labelled), "windows")

    def summary(self) -> DataFrame:
        return summary.summary_of_representatives(self.signals)

    def result(self) -> DataFrame:
        return summary.analysis_result(self.representatives, self.signals)

    def timeline(self) -> DataFrame:
        return timeline.signal_timeline(self.labelled)

    def anomalies(self) -> DataFrame:
        merged, _ = windows.merge_windows(self.windows)
        return windows.anomalies(merged)

    def anomaly_items(self) -> DataFrame:
        merged, placed = windows.merge_windows(self.windows)
        return windows.anomaly_items(self.labelled, placed, merged)

    def template_table(self) -> DataFrame:
        return store.template_table(self.templated, self.signals, components=self.components)

    def entries(self, dense: bool = False) -> DataFrame:
        return store.log_entries(self.templated, dense)


def preprocess(
    lines: DataFrame,
    as_of: datetime,
    time_range: str = "all-data",
    json_time: Sequence[str] = (),
    json_message: Sequence[str] = (),
    order: Sequence[int] | str | None = None,
    chunk_bits: int = records.CHUNK_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(log records, discarded JSON lines) from physical lines.

    ``order`` is that of the timestamp patterns: indexes, or "hits" for those most frequent in the
    lines first, which takes a pass over the lines to count them.
    """
    text, json_text = records.split_json_lines(lines)
    if order == "hits":
        order = timestamps.order_by_hits(timestamps.pattern_hits(text))
    kept, discarded = records.json_records(json_text, json_time, json_message, as_of)
    timed, untimed = records.segment_records(
        records.parse_lines(text, as_of, order), chunk_bits
    )
    # Figures of the whole corpus and the records themselves both read what JSON lines gave.
    has_json = json_time and json_message
    built = records.build_records(
        timed, untimed, materialize(kept, "json-records") if has_json else None, time_range, as_of
    )
    return built, discarded


def analyze(
    lines: DataFrame,
    as_of: datetime,
    tag_config: dict | None = None,
    signal_classifier: Callable[[DataFrame], DataFrame] | None = None,
    fault_classifier: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> Analysis:
    """Preprocess and mine templates; tags and labels follow on use."""
    built, discarded = preprocess(lines, as_of, **options)
    templated, mined = templates.mine_templates(
        materialize(templates.with_shape_key(built), "records")
    )
    return Analysis(
        materialize(templated, "templated"), mined, discarded, tag_config,
        signal_classifier, fault_classifier,
    )
