"""Chat formatting: logged snapshots that a longer conversation continues are dropped, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import stage

_WIDE = "decimal(38,0)"


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns with ``place`` from 1 and ``h1``, ``h2``: rolling hashes of the conversation up to that turn.

    Each is a running sum of 64-bit hashes of (place, role, text), kept exactly.
    """
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    order = Window.partitionBy("conv").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    df = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), content[0].alias("role"), content[1].alias("text")
    ).withColumn("place", F.row_number().over(order))
    for name, seed in (("h1", 1), ("h2", 2)):
        one = F.xxhash64(F.lit(seed), "place", F.length("role"), "role", "text").cast(_WIDE)
        df = df.withColumn(name, F.sum(one).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(_WIDE))
    return df


def chat_format(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", part_turns: int = 1000
) -> DataFrame:
    """One row per part of each maximal conversation: id, ``part``, ``n_turns``, ``rendered``.

    A conversation goes if its turns are the first turns of a longer one, or all
    the turns of an equal one with a smaller id. Rolling prefix hashes find this by
    anti joins: the last hash of a conversation against the inner hashes of all.
    Only hashes meet; each distinct prefix is carried once, so a first turn that a
    third of all rows share is one row.

    Turns are ordered by (turn, role, text), nulls first. A null role or text
    counts as empty; a null id is a conversation of its own. Repeated rows are
    repeated turns. Parts hold at most ``part_turns`` turns, so a very long
    conversation is never gathered into one row. An empty table gives no rows.
    """
    df = stage(turn_prefixes(turns, conv, turn), "turn-prefixes")
    ends = df.groupBy("conv").agg(F.max_by(F.struct("h1", "h2", "place"), "place").alias("end"))
    ends = stage(ends.select("conv", "end.h1", "end.h2", F.col("end.place").alias("n")), "conversation-ends")
    first = ends.groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = (
        df.join(ends.select("conv", F.col("n").alias("last")), df["conv"].eqNullSafe(ends["conv"]))
        .where("place < last")
        .select("h1", "h2", F.col("place").alias("n"))
        .distinct()
    )
    kept = first.join(inner, ["h1", "h2", "n"], "left_anti").select(F.col("conv").alias("kept"), "n", "copies")
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return (
        df.join(kept, df["conv"].eqNullSafe(kept["kept"]))
        .withColumn("part", F.floor((F.col("place") - 1) / part_turns).cast("int"))
        .groupBy("conv", "part")
        .agg(
            F.max("n").cast("bigint").alias("n_turns"),
            F.max("copies").alias("copies"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda s: s["said"]), ""
            ).alias("rendered"),
        )
        .withColumnRenamed("conv", conv)
    )
