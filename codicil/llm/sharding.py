"""Contiguous sharding of atomic groups with the smallest possible largest shard."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import stage
from codicil.llm.words import text_of

#: Groups with more than this share of all rows are met by broadcast; there can be no more of them than this.
HOT_SHARE = 4096


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def _in_order(first: str = "first") -> list[Column]:
    return [F.col(first).asc_nulls_last(), F.col("digest").asc()]


def _line_of_groups(rows: DataFrame) -> DataFrame:
    """Groups of equal texts in order of their least id, each with the bytes up to its end.

    Range partitions keep the order; sums run inside a partition, and only one
    total per partition meets in one place.
    """
    groups = rows.groupBy("digest").agg(
        F.min("id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )
    ordered = groups.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    ordered = stage(ordered.withColumn("block", F.spark_partition_id()), "shard-groups")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ordered.groupBy("block").agg(F.sum("bytes").alias("held"))
    blocks = blocks.select("block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("block").orderBy(*_in_order()).rowsBetween(Window.unboundedPreceding, 0)
    line = ordered.join(F.broadcast(blocks), "block").withColumn("end", F.col("offset") + F.sum("bytes").over(inside))
    return stage(line.select("digest", "bytes", "rows", "end"), "shard-line")


class _Line:
    """Borders of groups on the line of bytes; each question reads only the borders near what is asked."""

    def __init__(self, line: DataFrame) -> None:
        self._line = line
        total, largest, rows = line.agg(F.max("end"), F.max("bytes"), F.sum("rows")).first()
        self.total, self.largest, self.rows = total or 0, largest or 0, rows or 0

    def _near(self, first: int, last: int) -> DataFrame:
        return self._line.where((F.col("end") >= first) & (F.col("end") <= last))

    def at_or_before(self, places: list[int]) -> list[int]:
        """Last border at or before each place; the line begins at 0."""
        wanted = sorted(set(places))
        bucket = F.size(F.filter(F.lit(wanted), lambda p: p < F.col("end")))
        near = self._near(wanted[0] - self.largest, wanted[-1])
        found = dict(near.groupBy(bucket.alias("bucket")).agg(F.max("end")).collect())
        borders = list(itertools.accumulate((found.get(i, 0) for i in range(len(wanted))), max))
        return [borders[wanted.index(p)] for p in places]

    def around(self, place: int) -> tuple[int, int]:
        """Last border at or before a place and first border at or after it."""
        end = F.col("end")
        near = self._near(place - self.largest, place + self.largest)
        before, after = near.agg(F.max(F.when(end <= place, end)), F.min(F.when(end >= place, end))).first()
        return (0 if place <= 0 else before or 0), (0 if place <= 0 else after or self.total)


def _feasible(line: _Line, capacities: list[int], shards: int) -> list[bool]:
    """Greedy check of several capacities at once: does each fill the line in ``shards`` cuts?"""
    at = [0] * len(capacities)
    for _ in range(shards - 1):
        places = [min(a + c, line.total) for a, c in zip(at, capacities)]
        if min(places) >= line.total:
            break
        at = line.at_or_before(places)
    return [a + c >= line.total for a, c in zip(at, capacities)]


def smallest_capacity(line: _Line, shards: int, tried: int = 31) -> int:
    """Smallest feasible capacity by bisection; ``tried`` capacities a round settle five halvings."""
    fair = -(-line.total // shards)
    low, high = max(fair, line.largest), fair + line.largest - 1
    while low < high:
        step = max(1, (high - low) // (tried + 1))
        capacities = sorted({low, *range(low + step - 1, high, step)})[: tried + 1]
        for capacity, fits in zip(capacities, _feasible(line, capacities, shards)):
            if fits:
                high = capacity
                break
            low = capacity + 1
    return max(low, line.largest)


def cuts(line: _Line, shards: int) -> list[int]:
    """Borders between the shards: no shard above the smallest capacity, each cut nearest to an even share of the rest.

    A cut never lies so early that the rest would not fit the shards that follow,
    and leaves no shard empty while groups remain.
    """
    capacity = smallest_capacity(line, shards)
    earliest = [line.total]
    for _ in range(shards - 1):
        earliest.append(line.around(earliest[-1] - capacity)[1])
    earliest.reverse()
    out, at = [], 0
    for i in range(1, shards):
        even = at + -(-(line.total - at) // (shards - i + 1))
        place = min(max(even, earliest[i - 1]), at + capacity, line.total)
        before, after = line.around(place)
        at = after if after <= at + capacity and (before == at or after - place < place - before) else before
        out.append(at)
    return out


def _shards_of(docs: DataFrame, shards: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Slim rows of the table, and the shard of each group of equal texts."""
    text = text_of(F.col(text_col))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).cast("bigint").alias("crc"),
            _digest(F.col(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    line = _line_of_groups(rows)
    asked = _Line(line)
    begin = F.col("end") - F.col("bytes")
    shard = sum([(begin >= c).cast("int") for c in cuts(asked, shards)], F.lit(0)) if asked.rows else F.lit(0)
    return rows, line.select("digest", shard.alias("shard"), (F.col("rows") * HOT_SHARE > asked.rows).alias("hot"))


def _join_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the shard of their group; the few groups with much of the table are not shuffled."""
    hot = groups.where("hot").select("digest", F.col("shard").alias("hot_shard"))
    met = rows.join(F.broadcast(hot), "digest", "left")
    near = met.where("hot_shard IS NOT NULL").withColumnRenamed("hot_shard", "shard")
    rest = met.where("hot_shard IS NULL").drop("hot_shard").join(groups.where("NOT hot").select("digest", "shard"), "digest")
    return near.unionByName(rest)


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each row under the law ``bytes``: id, size, ``text_crc32``, law, shard, slot, ``grown_shard``.

    Rows of equal texts form one group, which no cut divides. Groups stand in
    order of their least id (ties by digest); contiguous runs of them go to the
    shards so that the largest shard is as small as it can be, which bisection
    finds with greedy checks, and the cuts lie as evenly as that allows. Only
    the last shards can be empty, in a table of few or of very unequal groups.

    Slots count the rows of a shard by id, then digest. A null text counts as
    empty, with size 1; null ids come last. Repeated rows take a slot each. An
    empty table gives no rows. Columns besides id and text are not looked at.
    """
    rows, groups = _shards_of(docs, shards, id_col, text_col)
    order = [F.col("shard"), F.col("id").asc_nulls_last(), F.col("digest"), F.col("row")]
    placed = _join_groups(rows, groups).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.drop("digest", "row").withColumn("at", F.monotonically_increasing_id()), "shard-slots")
    placed = placed.withColumn("block", F.shiftright("at", 33))
    runs = placed.groupBy("block", "shard").agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("block", "shard", "lead", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(runs), ["block", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.col("lead") + F.col("offset")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the rows with all their columns in one folder a shard, ``shard=N``, in the order of the slots.

    Extra columns ride in one struct, so that no name can clash.
    """
    _, groups = _shards_of(docs, shards, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("digest"))
    order = [F.col("shard"), F.col("id").asc_nulls_last(), F.col("digest")]
    placed = _join_groups(rows, groups).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("shard", "row").write.partitionBy("shard").parquet(path)
