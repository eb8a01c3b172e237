"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import staged_path, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links; root is the same for all
    nodes of a component and one of them.

    Each round hooks every node to its smallest neighbour or itself, follows two
    hooks, and replaces the links by links between the hooks' ends. The nodes
    that stay are at most half of those with links, so rounds are logarithmic.
    Neighbours are reduced with a map-side ``min``, and nodes are joined on their
    own ids, so a hub is one aggregated row. Every round is written to the shared
    folder and the one before is deleted."""
    spark = links.sparkSession
    read = lambda path, schema: spark.read.schema(schema).parquet(path)
    edge = "a long, b long"
    now = staged_path(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[str] = []
    while not read(now, edge).isEmpty():
        e = read(now, edge)
        both = e.union(e.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        first = staged_path(parent)
        p = read(first, "node long, p long")
        twice = p.alias("x").join(p.alias("y"), F.col("x.p") == F.col("y.node")).select("x.node", F.col("y.p").alias("p"))
        hook = staged_path(twice)
        unstage(spark, first)
        h = read(hook, "node long, p long")
        moved = (e.join(h.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
                 .join(h.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
                 .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        after = staged_path(moved)
        unstage(spark, now)
        hooks.append(hook)
        now = after
    unstage(spark, now)
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    # A node's hook in one round is a node of the next, until it has no links left.
    out = read(hooks[-1], "node long, p long").select("node", F.col("p").alias("root"))
    for hook in reversed(hooks[:-1]):
        h = read(hook, "node long, p long")
        later = out.select(F.col("node").alias("p"), "root")
        out = h.join(later, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    return out
