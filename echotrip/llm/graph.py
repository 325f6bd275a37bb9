"""Connected components of a link table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.session import stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component_id): the smallest id that can be reached, for every id in a link.

    Each round maps every vertex to the smallest neighbour of its smallest neighbour and renames the
    links by that map, so paths shrink geometrically. Nothing is collected but a row count; hubs only
    meet map-side minima and joins that can be split. Rounds are cut in the shared folder.
    No links give an empty table; self-links and repeated links are harmless; null ids are ignored.
    """
    both = links.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null")
    edges = stage(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    label = stage(
        edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component_id", F.col("id")),
        "labels",
    )
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(sides.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "parent")
        jump = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        step = stage(parent.join(jump, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "step")
        left = step.select("a", F.col("p").alias("pa"))
        right = step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        renamed = edges.join(left, "a", "left").join(right, "b", "left")
        renamed = renamed.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        edges = stage(renamed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        moved = step.select(F.col("a").alias("component_id"), F.col("p").alias("moved"))
        label = stage(
            label.join(moved, "component_id", "left").select("id", F.coalesce("moved", "component_id").alias("component_id")),
            "labels",
        )
    return label
