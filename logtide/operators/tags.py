"""Component tags: one decision per template, spread over its records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.functions.tokens import bracket_tokens, match_tag
from logtide.plans.common import join_by_key
from logtide.plans.places import first_records


def load_tags(spark: SparkSession, path: str) -> dict:
    """Tag rules from a JSON file of any store that Spark reads, missing keys filled in."""
    config = json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])
    tags = [
        {"name": t["name"], "keywords": t.get("keywords", []), "patterns": t.get("patterns", [])}
        for t in config.get("tags", [])
    ]
    return {"tags": tags, "default_tag": config.get("default_tag", "Other")}


def _component(first: DataFrame, config: dict) -> DataFrame:
    tokens = first.withColumn("tokens", bracket_tokens(F.col("text")))
    tag = match_tag(
        F.col("tokens"), F.col("text"), config.get("tags", []), config.get("default_tag", "Other")
    )
    return tokens.select("template_id", "n", tag.alias("component"))


def template_components(templated: DataFrame, config: dict) -> DataFrame:
    """Component per template, read off the template's first record."""
    return _component(
        first_records(templated, ["template_id"], ["text"]), config
    )


def components_of_representatives(reps: DataFrame, config: dict) -> DataFrame:
    """The same from representatives, without reading the records again."""
    return _component(
        reps.groupBy("template_id").agg(
            F.min_by("text", "record_id").alias("text"), F.sum("n").alias("n")
        ),
        config,
    )


def distinct_components(components: DataFrame) -> DataFrame:
    """Templates and records per component, from the rows of ``template_components``."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("templates"), F.sum("n").alias("records"))


def tag_components(
    templated: DataFrame, config: dict, components: DataFrame | None = None
) -> DataFrame:
    """Records with the component of their template."""
    if components is None:
        components = template_components(templated, config)
    return join_by_key(templated, components, ["template_id"], "n")


def distinct_tokens(records: DataFrame) -> DataFrame:
    """Every bracket token found in the records, once."""
    return records.select(F.explode(bracket_tokens(F.col("text"))).alias("token")).distinct()
