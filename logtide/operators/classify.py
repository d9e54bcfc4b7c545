"""Golden signals and fault categories of representative lines, and votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logtide.functions.bind import bind
from logtide.plans.common import join_by_key
from logtide.plans.places import first_records

# The labels, in the classifier's order, and how they are used.
SIGNALS = ["information", "error", "availability", "latency", "saturation", "traffic"]
FAULTS = ["io", "authentication", "network", "application", "device"]
INFO_LABELS = ["info", "information"]
FAULT_THRESHOLD = 0.2
DEFAULT_SIGNAL, DEFAULT_FAULT = "info", "other"

# Words of the rule classifier, matched as parts of the cleaned text.
SIGNAL_WORDS = {
    "information": ["info", "started", "completed", "success", "loaded"],
    "error": ["error", "fail", "exception", "fatal", "invalid", "denied"],
    "availability": ["unavailable", "unreachable", "refused", "shutdown", "offline"],
    "latency": ["slow", "latency", "timeout", "timed out", "delay"],
    "saturation": ["exhausted", "full", "overload", "out of memory", "capacity"],
    "traffic": ["request", "throughput", "packets", "connections", "bandwidth"],
}
FAULT_WORDS = {
    "io": ["disk", "file", "read", "write", "storage"],
    "authentication": ["login", "password", "user", "auth", "session"],
    "network": ["connection", "socket", "port", "network", "packet"],
    "application": ["exception", "frame", "request", "service", "module"],
    "device": ["device", "cpu", "memory", "kernel", "driver"],
}

SCORED = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)
# One predictor per Python worker: texts in, one list of (label, score) per text.
Predictor = Callable[[list[str]], list[list[tuple[str, float]]]]


def is_info(signal: Column) -> Column:
    return F.lower(signal).isin(*INFO_LABELS)


def rule_scores(text: Column, words: dict[str, list[str]]) -> Column:
    """Scored labels, best first: share of all word hits; no hit gives the first label."""
    def counted(t: Column) -> Column:
        return F.sort_array(F.array(*[
            F.struct(
                F.size(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(t, w))).alias("n"),
                F.lit(-i).alias("rank"), F.lit(label).alias("label"),
            )
            for i, (label, terms) in enumerate(words.items())
        ]), asc=False)

    def scored(ranked: Column) -> Column:
        total = F.aggregate(ranked, F.lit(0), lambda acc, x: acc + x["n"])
        return bind(total, lambda n: F.transform(
            ranked,
            lambda x: F.struct(
                x["label"].alias("label"), (x["n"] / F.greatest(n, F.lit(1))).alias("score")
            ),
        ))

    return bind(text, lambda t: bind(counted(t), scored))


def classify_rules(
    df: DataFrame, words: dict[str, list[str]], text: str = "rep_text", out: str = "scored"
) -> DataFrame:
    """Column-expression classifier, for runs without a model."""
    return df.withColumn(out, rule_scores(F.col(text), words))


def classify_callable(
    df: DataFrame, factory: Callable[[], Predictor], text: str = "rep_text",
    out: str = "scored", batch_size: int = 64,
) -> DataFrame:
    """Classifier supplied by the caller: ``factory()`` runs once per task and its
    predictor gets batches of texts."""
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, SCORED)])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for pdf in batches:
            texts = pdf[text].tolist()
            scored = []
            for i in range(0, len(texts), batch_size):
                scored += predictor(texts[i:i + batch_size])
            pdf[out] = [[{"label": l, "score": float(s)} for l, s in row] for row in scored]
            yield pdf

    return df.mapInPandas(predict, schema)


# Classifiers by name: each takes (df, words or factory, text column, out column).
CLASSIFIERS = {"rules": classify_rules, "callable": classify_callable}


def representatives(templated: DataFrame) -> DataFrame:
    """First record per template and file, with the pair's record count."""
    first = first_records(templated, ["template_id", "file_name"], ["text", "ts_text", "record_id", "clean_text"])
    blank = F.trim("clean_text") == ""
    return first.select(
        "template_id", "file_name", "n", "text", "ts_text", "record_id",
        F.when(blank, "empty log").otherwise(F.col("clean_text")).alias("rep_text"),
    )


def top_label(scored: Column) -> Column:
    return F.element_at(scored, 1)["label"]


def fault_labels(scored: Column, threshold: float = FAULT_THRESHOLD) -> Column:
    """Labels above the threshold, else the best one."""
    high = F.transform(F.filter(scored, lambda s: s["score"] > threshold), lambda s: s["label"])
    return F.when(F.size(high) > 0, high).otherwise(F.array(top_label(scored)))


def first_fault(faults: Column) -> Column:
    return F.coalesce(F.get(faults, 0), F.lit(DEFAULT_FAULT))


def label_representatives(
    reps: DataFrame,
    signal_classifier: Callable[[DataFrame], DataFrame] | None = None,
    fault_classifier: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Signal and fault categories per template and file.

    The classifiers add a ``scored`` column to the representatives. Fault
    categories are asked for only where the signal is not information.
    """
    signal_classifier = signal_classifier or (lambda df: classify_rules(df, SIGNAL_WORDS))
    signals = signal_classifier(reps)
    signals = signals.select(
        *reps.columns, top_label(F.col("scored")).alias("golden_signal"),
        F.element_at("scored", 1)["score"].alias("score"),
    )
    if fault_classifier is None:
        faults = fault_labels(rule_scores(F.col("rep_text"), FAULT_WORDS))
        return signals.withColumn(
            "fault_categories",
            F.when(is_info(F.col("golden_signal")), F.array(F.lit(DEFAULT_FAULT))).otherwise(faults),
        )
    info = is_info(F.col("golden_signal"))
    asked = fault_classifier(signals.where(~info)).withColumn(
        "fault_categories", fault_labels(F.col("scored"))
    ).drop("scored")
    plain = signals.where(info).withColumn("fault_categories", F.array(F.lit(DEFAULT_FAULT)))
    return plain.unionByName(asked)


def spread_signals(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels of (template, file) on every record, with defaults."""
    table = labelled.select("template_id", "file_name", "n", "golden_signal", "fault_categories")
    joined = join_by_key(records, table, ["template_id", "file_name"], "n")
    signal = F.coalesce("golden_signal", F.lit(DEFAULT_SIGNAL))
    return joined.withColumn("golden_signal", signal).withColumn(
        "fault_categories", F.coalesce("fault_categories", F.array(F.lit(DEFAULT_FAULT)))
    ).withColumn("error_tid", F.when(~is_info(signal), F.col("template_id")))


def non_info(records: DataFrame) -> DataFrame:
    return records.where(~is_info(F.col("golden_signal")))


def weighted_vote(scores: DataFrame, key: str, label: str = "label", score: str = "score") -> DataFrame:
    """Label with the highest mean score per key; ties by count, then by name."""
    per_label = scores.groupBy(key, label).agg(
        F.avg(score).alias("mean"), F.count(F.lit(1)).alias("votes")
    )
    best = F.struct((-F.col("mean")).alias("m"), (-F.col("votes")).alias("v"), F.col(label).alias("l"))
    return per_label.groupBy(key).agg(F.min(best).alias("b")).select(
        key, F.col("b.l").alias(label), (-F.col("b.m")).alias("mean_score"), (-F.col("b.v")).alias("votes")
    )


def vote_signal(labelled: DataFrame) -> DataFrame:
    """Most frequent signal over a template's files, ties to the first file's; the
    fault category is the first file's."""
    votes = labelled.groupBy("template_id", "golden_signal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("file_name").alias("since"),
        F.min_by(first_fault(F.col("fault_categories")), "file_name").alias("fault"),
    )
    name = F.col("golden_signal").alias("g")
    rank = F.struct((-F.col("votes")).alias("v"), F.col("since").alias("s"), name)
    return votes.groupBy("template_id").agg(
        F.min_by("golden_signal", rank).alias("golden_signal"),
        F.min_by("fault", F.struct("since", name)).alias("fault_category"),
    )


def signal_distribution(labelled: DataFrame) -> DataFrame:
    """Records per signal."""
    return labelled.groupBy("golden_signal").agg(F.sum("n").alias("occurrences"))
