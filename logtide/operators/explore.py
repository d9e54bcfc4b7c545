"""Questions over the stored entries: search, facets, drill-down, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.plans.common import join_by_key


def with_templates(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Entries with the labels of their template."""
    labels = templates.select(
        "template_id", F.col("occurrence_count").alias("n"), "golden_signal", "fault_category", "component"
    )
    return join_by_key(entries, labels, ["template_id"], "n")


def search_entries(
    entries: DataFrame,
    text: str = "",
    signals: list[str] | None = None,
    sources: list[str] | None = None,
    template_id: int | None = None,
    variable: str | None = None,
) -> DataFrame:
    """Entries that satisfy every filter given; text search ignores case."""
    if template_id is not None:
        entries = entries.where(F.col("template_id") == template_id)
    if sources:
        entries = entries.where(F.col("file_source").isin(*sources))
    if signals:
        entries = entries.where(F.lower("golden_signal").isin(*[s.lower() for s in signals]))
    if text:
        entries = entries.where(F.contains(F.lower("original_text"), F.lit(text.lower())))
    if variable is not None:
        entries = entries.where(F.array_contains("variables", variable))
    return entries


def facet(entries: DataFrame, column: str) -> DataFrame:
    """Entries per value of a column: the counts on the filter chips."""
    return entries.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(column).alias("facet"), F.col("value").cast("string").alias("value"), "n"
    )


def facets(entries: DataFrame, columns: list[str]) -> DataFrame:
    """All facets in one pass over the entries."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return entries.select(F.explode(pairs).alias("p")).groupBy(
        F.col("p.facet").alias("facet"), F.col("p.value").alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))


def search_templates(templates: DataFrame, text: str = "", signals: list[str] | None = None) -> DataFrame:
    """Templates that contain the text, most frequent first."""
    if text:
        templates = templates.where(F.contains(F.lower("template"), F.lit(text.lower())))
    if signals:
        templates = templates.where(F.lower("golden_signal").isin(*[s.lower() for s in signals]))
    return templates.orderBy(F.desc("occurrence_count"), "template_id")


def _after(columns: list[tuple[str, bool]], values: tuple) -> Column:
    """Rows behind a key in an order of (column, descending) pairs."""
    behind, equal = F.lit(False), F.lit(True)
    for (name, descending), value in zip(columns, values):
        column = F.col(name)
        further = column < F.lit(value) if descending else column > F.lit(value)
        behind = behind | (equal & further)
        equal = equal & (column == F.lit(value))
    return behind


def page(
    entries: DataFrame, size: int, after: tuple | None = None, newest_first: bool = True
) -> DataFrame:
    """One page by time, then file and entry; ``after`` is the key (timestamp,
    file_source, entry_id) of the last row of the page before."""
    columns = [("timestamp", newest_first), ("file_source", False), ("entry_id", False)]
    if after is not None:
        entries = entries.where(_after(columns, after))
    order = [F.desc(c) if descending else F.asc(c) for c, descending in columns]
    return entries.orderBy(*order).limit(size)
