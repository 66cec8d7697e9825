"""Connected components of a table of links, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.common import settle


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), both longs; root is the smallest node reachable.

    Every round points each node and its neighbours at the smallest neighbour
    (large star), then each node's smaller neighbours at their smallest (small
    star), until each node hangs from its root: a logarithmic number of rounds. A
    node's neighbours meet only in a minimum, never in one task, and rounds are written
    to the shared folder. Links with a null end and loops are left out.
    """
    edges = settle(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The repartition lets a node with very many neighbours be split by the join below.
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).repartition(_tasks(links))
        large = settle(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct(), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).repartition(_tasks(links))
        small = settle(
            large.join(least, "a").select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            )).alias("e")).select("e.*").where("a <> b").distinct(), "small_star")
        before, mark, edges = mark, _checksum(small), small
        if mark == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
