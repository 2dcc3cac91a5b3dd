"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than u is hung on the smallest of u and its neighbours."""
    sym = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour not larger than u, and u itself, is hung on the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u")
    return (hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(hung.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node it can reach.

    ``edges`` has long columns u, v. Each round is written to the shared folder, so lineage
    stays short and a lost executor costs one round. Null ends and loops are ignored.
    """
    e = materialize(edges.select("u", "v").where("u <> v").distinct(), "cc")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(max_rounds):
        # a forest of stars has every v a root: no v occurs as a u, and every u has one v
        e = materialize(_small_star(_large_star(e)), "cc")
        deep = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        many = e.groupBy("u").count().where("count > 1")
        if deep.select("u").unionAll(many.select("u")).isEmpty():
            break
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots.select("node", F.col("node").alias("label")))
