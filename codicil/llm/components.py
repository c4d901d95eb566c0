"""Connected components of a table of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import drop_staged, stage, staged_paths


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of ``u`` and all its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``links`` (a, b): the least vertex that links reach.

    Each round links the larger neighbours of a vertex to its least one, then the
    smaller ones; the forest flattens to stars in few rounds. Rounds are written
    tables, so a lost executor costs one round at most, and go when the next one is
    written. Hot vertices meet only partial minima and joins that can be split.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    spark, known = links.sparkSession, None
    with staged_paths() as before:
        now = stage(now, "links")
    while True:
        with staged_paths() as made:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = stage(large.where("u <> v").distinct(), "links")
            small = _least_neighbour(large)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                small.select("u", F.col("m").alias("v"))
            )
            now = stage(small.where("u <> v").distinct(), "links")
        drop_staged(spark, before)
        seen = tuple(
            now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        )
        if seen[:2] == known:
            break
        known, before = seen[:2], made
    roots = now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    out = stage(now.unionByName(roots).select(F.col("u").alias("v"), F.col("v").alias("comp")), "components")
    drop_staged(spark, made)
    return out
