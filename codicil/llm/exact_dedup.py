"""Exact de-duplication by a distributed content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import drop_staged, stage, staged_paths
from codicil.llm.words import BLANKS, text_of


def normalized(text: Column) -> Column:
    """Runs of blanks become one space; null counts as empty."""
    return F.regexp_replace(text_of(text), BLANKS, " ")


def any_order(row: Column) -> Column:
    """Order of whole rows that reruns repeat: a digest of all their columns."""
    return F.sha2(F.to_json(row), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    lead_chars: int = 32,
    hot_share: int = 4096,
) -> DataFrame:
    """Group of equal normalised texts per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Sampled splitters deal the normalised texts out by range of their first
    ``lead_chars`` characters and a fingerprint, so the samples stay small however
    long the texts are; each task sorts its range externally by these and the whole
    text, so equal texts are neighbours and are compared in full. A run of equal
    neighbours gives its least id and its length.

    A fingerprint that more than one of ``hot_share`` rows hold is dealt over
    ``salts`` sub-ranges by a hash of the id, so a text that a third of all rows
    hold is sorted by many tasks. There are fewer than ``hot_share`` of these, which
    bounds their broadcast, and only the runs of such texts, one a sub-range, meet
    again. All other groups are whole where the sort leaves them.

    Null or empty texts form one group. Of equal ids with equal texts exactly one
    row is kept; a null id is kept only in a group without other ids. An empty
    table gives no rows. Columns besides id and text are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("content"))
    rows = rows.withColumn("print", F.xxhash64("content"))
    held = stage(rows.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "content-prints")
    total = held.agg(F.sum("n")).first()[0] or 0
    hot = held.where(F.col("n") * hot_share > total).select("print", F.lit(salts).alias("parts"))
    rows = rows.join(F.broadcast(hot), "print", "left").select(
        "id",
        "content",
        F.left("content", F.lit(lead_chars)).alias("lead"),
        "print",
        F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"),
        F.col("parts").isNotNull().alias("hot"),
    )
    order = ["lead", "print", "salt", "content", F.col("id").asc_nulls_last()]
    ranged = rows.repartitionByRange("lead", "print", "salt").sortWithinPartitions(*order)
    run = Window.partitionBy("lead", "print", "salt", "content").orderBy(F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = ranged.select(
        "id",
        F.row_number().over(run).alias("turn"),
        F.first("id").over(whole).alias("least"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sha2(F.col("content"), 256).alias("text_sha256"),
        "hot",
    )
    placed = stage(placed, "content-sort")
    heads = placed.where("hot AND turn = 1").groupBy("text_sha256")
    heads = heads.agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    spread = placed.where("hot").drop("least", "n").join(F.broadcast(heads), "text_sha256")
    return placed.where("NOT hot").unionByName(spread).select(
        F.col("id").alias(id_col),
        F.col("least").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("least")) & (F.col("turn") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever these are called.

    Of rows with the kept id and text the one first by a digest of all columns
    stays, so reruns agree. An empty table gives no rows.
    """
    with staged_paths() as made:
        grouped = exact_dedup(docs, id_col, text_col)
        found = grouped.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"), "kept")
    kept = found.groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = stage(kept.where("kept").select(F.col("id").alias("kept_id"), F.col("digest").alias("kept_digest"), "n"), "exact-kept")
    drop_staged(docs.sparkSession, made)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalized(F.col(text_col)), 256).alias("digest")
    )
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    alone = rows.where("n = 1").select("row")
    several = rows.where("n > 1").groupBy("id", "digest").agg(F.min_by("row", any_order(F.col("row"))).alias("row"))
    return alone.unionByName(several.select("row")).select("row.*")
