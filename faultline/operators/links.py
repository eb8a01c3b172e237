"""Link graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_hop(edges: DataFrame, nodes: DataFrame, second_hop_filter=None) -> DataFrame:
    """J6 + U1: for every source page, its own links (hop 1) and the links of
    the landed pages it points to (hop 2), distinct, with the smallest hop.

    ``edges`` is (src, dst) by URL; ``nodes`` is (page_id, url) with ``url``
    unique, so the hop-2 join is many-to-one on the middle page.
    ``second_hop_filter`` is an optional predicate on the hop-2 ``dst`` (the
    original followed only issue and security links from PR pages).
    Returns (page_id, dst, hop).
    """
    e1 = edges.select(F.col("src"), F.col("dst").alias("mid"))
    e2 = edges.select(F.col("src").alias("mid"), F.col("dst"))
    hop2 = e1.join(e2, "mid", "inner").select("src", "dst")
    if second_hop_filter is not None:
        hop2 = hop2.where(second_hop_filter(F.col("dst")))
    hop2 = hop2.where(F.col("dst") != F.col("src"))
    both = (edges.select("src", "dst", F.lit(1).alias("hop"))
                 .unionByName(hop2.withColumn("hop", F.lit(2))))
    best = both.groupBy("src", "dst").agg(F.min("hop").alias("hop"))
    return (best.join(nodes.select("page_id", F.col("url").alias("src")), "src", "inner")
                .select("page_id", "dst", "hop"))
