"""Connected components of links that live in a table, by rounds of large and small stars.

Each round joins every node to the smallest neighbour seen; the number of rounds grows with the logarithm of the longest
chain. Links are written each round, so lineage stays short; nothing is collected but two figures that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest node of the component. Links to oneself are ignored."""
    spark = links.sparkSession
    edges, path = _written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links")
    figures = (F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")))
    before = edges.agg(*figures).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least, p1 = _written(both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select("node", F.least("node", "m").alias("m")), "links")
        # Large star: every neighbour above a node links to the node's smallest.
        large, p2 = _written(edges.join(least.hint("merge"), F.col("lo") == F.col("node")).select("hi", F.col("m").alias("lo")).distinct(), "links")
        least, p3 = _written(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "links")
        # Small star: a node and its neighbours below link to the smallest of them.
        below = large.join(least.hint("merge"), F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
        after, p4 = _written(below.unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))).distinct(), "links")
        now = after.agg(*figures).first()
        for p in (path, p1, p2, p3):
            drop_path(spark, p)
        edges, path = after, p4
        if now == before:
            break
        before = now
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


