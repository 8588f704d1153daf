"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (u, v): label is the least node of
    the component.

    Nodes get ranks by a hash. In each round a node hooks onto its neighbour of the
    least rank, or stays if its own is less, and the edges are drawn anew between
    what the nodes hooked onto, until none is left; as ranks are in no order along a
    path, a round leaves a fraction of the nodes. Sums are pre-aggregated, so a node
    with very many neighbours costs one row a task."""
    named = edges.where("u <> v").select("u", "v")
    ends = named.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
    both = cut(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = None
    while labels is None or not both.isEmpty():
        hook = cut(both.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("up")), "hooks")
        onto = lambda name: hook.select(F.col("u").alias(name), F.col("up").alias(f"{name}_up"))  # noqa: B023, E731
        rest = cut(both.join(onto("u"), "u").join(onto("v"), "v").select(F.col("u_up").alias("u"), F.col("v_up").alias("v")).where("u <> v").distinct(), "edges")
        if labels is None:
            new = hook.select(F.col("u").alias("rank"), F.col("up").alias("label"))
        else:
            new = cut(labels.join(onto("label"), "label", "left").select("rank", F.coalesce("label_up", "label").alias("label")), "labels")
            spent(labels, hook)
        spent(both)
        both, labels = rest, new
    nodes = named.select(F.col("u").alias("node")).unionByName(named.select(F.col("v").alias("node"))).distinct()
    member = nodes.withColumn("rank", F.xxhash64("node")).join(labels, "rank").select("node", "label")
    least = member.groupBy("label").agg(F.min("node").alias("least"))
    return cut(member.join(least, "label").select("node", F.col("least").alias("label")), "components")
