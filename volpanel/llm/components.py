"""Connected components of a table of links, by smallest label with pointer jumping.

Labels and links only ever meet in joins; neighbours are combined by a map-side minimum, so a hub is one row per
task. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.tables import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node."""
    both = stage(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct(),
        "links",
    )
    labels = stage(
        both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")), "labels"
    )
    while True:
        seen = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v")
        nearest = seen.groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(nearest, "u").select("u", "label", F.least("label", "near").alias("low"))
        lower = stage(lower, "labels")
        jump = lower.select(F.col("u").alias("at"), F.col("low").alias("next"))
        jumped = lower.join(jump, F.col("low") == F.col("at")).select("u", F.col("next").alias("label"), F.col("label").alias("old"))
        labels = stage(jumped, "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = labels.select("u", "label")
