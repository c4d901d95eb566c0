"""Interaction of document filters under every order of application."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import stage
from codicil.llm.words import BLANKS, text_of

FILTERS = "ABCDE"
#: Texts held by more than this share of all rows are dealt over ``SALTS`` tasks; there can be no more of them than this.
HOT_SHARE, SALTS = 4096, 32


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _own_failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Rows with the bits of the filters that a text fails by itself; no shuffle."""
    text = F.col("body")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_of(F.col(text_col)).alias("body"),
    ).withColumn("words", F.array_remove(F.split(text, BLANKS), ""))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    n = F.size("words")
    fails: dict[str, Column] = {
        "A": n < 200,
        "B": F.size(F.array_distinct("words")).cast("bigint") * 100 < n.cast("bigint") * 50,
        "C": capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * 2,
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }
    bits = sum([F.when(c, F.lit(_bit(f))).otherwise(0) for f, c in fails.items()], F.lit(0))
    return rows.select("id", "part", bits.alias("bits"), F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("digest"))


def repeats(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and digests of the rows whose text a smaller id holds as well.

    A left semi join on hash, exact text and smaller id. Only texts whose hash
    occurs with two ids are read again; of the holders of a text the smallest id
    is enough to answer for all, and partial minima form before the shuffle.
    """
    hashes = rows.where("id IS NOT NULL").groupBy("hash").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")
    )
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    several = stage(
        hashes.where("least < most").join(total).select("hash", (F.col("n") * HOT_SHARE > F.col("total")).alias("hot")), "audit-hashes"
    )
    texts = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("body")).where("id IS NOT NULL")
    texts = texts.withColumn("hash", F.xxhash64("body"))
    hot = F.broadcast(several.where("hot").select("hash"))
    spread = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    common = texts.join(hot, "hash", "left_semi").withColumn("salt", spread)
    rare = texts.join(hot, "hash", "left_anti").join(several.where("NOT hot").select("hash"), "hash", "left_semi")
    later = common.unionByName(rare.withColumn("salt", F.lit(0)))
    least = lambda df: df.groupBy("hash", "body").agg(F.min("id").alias("id"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    earlier = least(common).withColumn("salt", every).unionByName(least(rare).withColumn("salt", F.lit(0)))
    a, b = later.alias("a"), earlier.alias("b")
    same = (
        (F.col("a.hash") == F.col("b.hash"))
        & (F.col("a.salt") == F.col("b.salt"))
        & (F.col("a.body") == F.col("b.body"))
        & (F.col("b.id") < F.col("a.id"))
    )
    return a.join(b, same, "left_semi").select("id", F.sha2("body", 256).alias("digest"))


def _combinations(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str
) -> DataFrame:
    """Number of rows per part, combination of failed filters and label."""
    rows = stage(_own_failures(docs, id_col, text_col, part_col), "audit-rows")
    known = rows.where("id IS NOT NULL").groupBy("id", "digest", "part").agg(
        F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n")
    )
    marks = repeats(rows, docs, id_col, text_col).distinct().select(
        "id", "digest", F.lit(None).cast("string").alias("part"), F.lit(_bit("E")).alias("bits"), F.lit(0).cast("bigint").alias("n")
    )
    held = F.filter(F.collect_list(F.struct("part", "n")), lambda x: x["n"] > 0)
    known = known.unionByName(marks).groupBy("id", "digest").agg(F.bit_or("bits").alias("mask"), held.alias("held"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    judged = (
        labels.select(F.col(id_col).alias("id"), "quality", "toxic")
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
        .where("good = 1 OR toxic = 1")
    )
    known = (
        known.join(judged, "id", "left")
        .select("mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.inline("held"))
    )
    nameless = rows.where("id IS NULL").select(
        F.col("bits").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "part", F.lit(1).cast("bigint").alias("n")
    )
    return (
        known.unionByName(nameless)
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """What each of five filters removes, per part, order of application and step.

    Filters: A under 200 words, B fewer than half of the words distinct, C more
    than 2 % capitals, D a character of ``#$%&*|``, E a text that a smaller id
    holds anywhere in the table. Per part (null: empty string) come all 120 orders
    with five steps each, zeros included.

    A null text counts as empty. A null id is neither smaller than another nor
    labelled, so E never fails it. Repeated rows count each; equal ids do not make
    one another a repeat. An id labelled several times is good or toxic if any of
    its labels says so. Parts without rows, and an empty table, give no rows.
    Columns besides id, text and part are not looked at.
    """
    combos = stage(_combinations(docs, labels, id_col, text_col, part_col), "audit-combinations")
    orders = F.lit(["".join(p) for p in itertools.permutations(FILTERS)])
    steps = combos.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    steps = steps.withColumns(
        {
            "bit": sum([F.when(at == F.col("step"), F.lit(_bit(f))).otherwise(0) for f, at in place.items()], F.lit(0)),
            "earlier": sum([F.when(at < F.col("step"), F.lit(_bit(f))).otherwise(0) for f, at in place.items()], F.lit(0)),
        }
    )
    mask, bit, earlier, n = F.col("mask"), F.col("bit"), F.col("earlier"), F.col("n")
    fails, passed = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) == 0
    total = lambda c, of=n: F.sum(F.when(c, of).otherwise(F.lit(0))).cast("bigint")
    # Of 120 orders, a document failing m filters falls to each of them in 120 / m.
    fair = n * (F.lit(120) / F.bit_count("mask")).cast("bigint")
    return (
        steps.groupBy("part", "filter_order", "step")
        .agg(
            total(passed & ~fails).alias("kept"),
            total(passed & fails).alias("removed"),
            total(fails & ~passed).alias("redundant"),
            total(mask == bit).alias("unique_fails"),
            total(passed & fails, F.col("good")).alias("good_lost"),
            total(passed & fails, F.col("toxic")).alias("toxic_lost"),
            total(fails, fair).alias("shapley"),
        )
    )
