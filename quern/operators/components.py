"""Connected components and ranks, distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of a graph of ``(u, v)`` links over comparable nodes; root is the smallest node.

    In each round every node points to its smallest neighbour, if that is smaller, and then to
    where that one points. Nodes that point to one node are drawn together into it, links inside
    are dropped, and the next round sees only what is left: components that are done, and most
    nodes of the others, take no further part. At the end the pointers are followed back from the last
    round to the first. All steps are combining aggregations and equi-joins; a node with very many
    links is one row for each task after the partial aggregation, and what is joined to it is
    split by adaptive execution.
    """
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    edges = cut(both.where("a <> b").distinct())
    drawn: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        least = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        up = least.select(F.col("node").alias("to"), F.col("to").alias("up"))
        pointer = cut(least.join(up, "to").select("node", F.col("up").alias("to")))
        drawn.append(pointer)
        # a node that others point to stays linked to where it points itself
        kept = pointer.join(pointer.where("to <> node").select(F.col("to").alias("node")).distinct(), "node", "left_semi")
        ends = lambda c: pointer.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        moved = edges.where("a < b").join(ends("a"), "a").join(ends("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        one_way = moved.unionByName(kept.select(F.col("node").alias("a"), F.col("to").alias("b"))).where("a <> b")
        edges = cut(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not drawn:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = drawn.pop().withColumnRenamed("to", "root")
    while drawn:
        later = found.select(F.col("node").alias("to"), F.col("root").alias("last"))
        found = drawn.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("root"))
    return found


def group_by_shared_keys(keys: DataFrame) -> DataFrame:
    """``(rec, root)`` from ``(rec, key)``: records that share a key, directly or through others.

    Each key links its records to its smallest one: as many links as rows, never all pairs.
    """
    keys = cut(keys.distinct())
    least = keys.groupBy("key").agg(F.min("rec").alias("v"), F.count("*").alias("n")).where("n > 1")
    links = keys.join(least.hint("merge"), "key").select(F.col("rec").alias("u"), "v").where("u <> v").distinct()
    found = components(links)
    alone = keys.select("rec").distinct().join(found, F.col("rec") == F.col("node"), "left_anti")
    return found.select(F.col("node").alias("rec"), "root").unionByName(alone.select("rec", F.col("rec").alias("root")))


def rank_by_hash(df: DataFrame, partition: list[str], digest: Column, tie: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank by a hex digest within each partition.

    The first three digits make 4,096 even ranges; counts of the ranges, a table of fixed size
    for each partition, give the rank before each range, so no task sorts a whole partition.
    """
    d = df.withColumn("__digest", digest).withColumn("__range", F.substring("__digest", 1, 3))
    keys = [*partition, "__range"]
    counts = d.groupBy(*keys).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*partition).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*keys).orderBy("__digest", *tie)
    on = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(keys)]
    joined = d.join(before, on)
    return joined.withColumn(name, (F.col("__before") + F.row_number().over(inner)).cast("bigint")).drop("__digest", "__range", "__before", *[f"__b{i}" for i in range(len(keys))])
