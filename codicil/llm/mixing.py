"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import small_side, stage
from codicil.llm.words import text_of, word_count

#: Fixed values of the mix: weights by order of the source, share of all words, most repeats of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def targets(sizes: list[int], weights: list[float], total: float, repeats: int = REPEATS) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``repeats`` times its size and the excess is dealt again."""
    out = [0.0] * len(sizes)
    free, left = [i for i in range(len(sizes))], total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > repeats * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


class CellFlow:
    """A flow from patterns to sources on arrays, for any number of patterns: one entry per cell, sorted by pattern.

    Augmenting paths run from source to source: ``a`` gives way to ``b`` in every
    pattern where ``a`` holds flow and ``b`` has room, all patterns at once. Paths are
    shortest, so a price takes at most about sources ** 3 of them, whatever the patterns.
    """

    def __init__(self, pattern: np.ndarray, source: np.ndarray, room: np.ndarray, quotas: np.ndarray) -> None:
        self.pattern, self.room, self.quota = pattern, room.copy(), quotas.copy()
        self.flow = np.zeros(len(pattern), np.int64)
        order = np.argsort(source, kind="stable")
        ends = np.searchsorted(source[order], np.arange(len(quotas) + 1))
        #: Cells of each source, by pattern; no pattern twice.
        self.cells = [order[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
        self.spare = np.zeros(int(pattern.max(initial=-1)) + 1, np.int64)

    def _give(self, a: int) -> np.ndarray:
        """Words per pattern that may leave source ``a``, or be taken anew for -1."""
        if a < 0:
            return self.spare
        out = np.zeros(len(self.spare), np.int64)
        out[self.pattern[self.cells[a]]] = self.flow[self.cells[a]]
        return out

    def _path(self) -> list[int]:
        """Fewest sources from the spare words to a source below its quota."""
        before: dict[int, int] = {}
        queue = deque([-1])
        while queue:
            a = queue.popleft()
            give = self._give(a)
            for b, cells in enumerate(self.cells):
                if b not in before and b != a and ((give[self.pattern[cells]] > 0) & (self.room[cells] > 0)).any():
                    before[b] = a
                    if self.quota[b]:
                        path = [b]
                        while path[-1] >= 0:
                            path.append(before[path[-1]])
                        return path[::-1]
                    queue.append(b)
        return []

    def push(self) -> None:
        """Route as much of ``spare`` as fits."""
        while path := self._path():
            moves = []
            for a, b in zip(path, path[1:], strict=False):
                cells = self.cells[b]
                moves.append(np.minimum(self._give(a)[self.pattern[cells]], self.room[cells]))
            words = min(int(self.quota[path[-1]]), *(int(m.sum()) for m in moves))
            for a, b, move in zip(path, path[1:], moves, strict=False):
                cells = self.cells[b]
                move = np.clip(words - (np.cumsum(move) - move), 0, move)
                self.room[cells] -= move
                self.flow[cells] += move
                gone = np.zeros(len(self.spare), np.int64)
                gone[self.pattern[cells]] = move
                if a < 0:
                    self.spare -= gone
                else:
                    self.room[self.cells[a]] += gone[self.pattern[self.cells[a]]]
                    self.flow[self.cells[a]] -= gone[self.pattern[self.cells[a]]]
            self.quota[path[-1]] -= words


def route_cells(
    pattern: np.ndarray, source: np.ndarray, size: np.ndarray, unique: np.ndarray, quotas: np.ndarray, repeats: int = REPEATS
) -> np.ndarray:
    """Words taken per cell; ``pattern`` and ``source`` are numbers from 0.

    A cell gives the words of the rows of a source whose texts have that pattern, and
    the words of the pattern's texts counted once. A pattern's texts cost nothing the
    first time, 1 the second, 2 the third and so on: its capacity at each price is its
    once-counted words. Prices stand at the patterns alone, so routing all that fits at
    one price before opening the next is a least-cost flow. A cell takes ``repeats``
    times its words at most, a source its quota.
    """
    net = CellFlow(pattern, source, repeats * size, quotas)
    once = np.ones(len(net.spare), np.int64)
    np.maximum.at(once, pattern, unique)
    left = np.zeros(len(once), np.int64)
    np.add.at(left, pattern, repeats * size)
    while left.any() and net.quota.any():
        step = np.minimum(once, left)
        left -= step
        net.spare += step
        net.push()
    return net.flow


def _named(source: Column) -> Column:
    """Sortable name of a source, null last."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _flow(in_cell: DataFrame, names: list[str], quotas: dict[str, int], portion: int = 500_000) -> DataFrame:
    """Words taken per pattern and source, by ``route_cells``; patterns travel as 128-bit hashes."""
    spark = in_cell.sparkSession
    number = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, place int")
    hashes = [F.xxhash64("pattern").alias("p1"), F.xxhash64(F.lit(1), "pattern").alias("p2")]
    cells = in_cell.join(F.broadcast(number), "source").select(*hashes, "place", "size", "unique")
    found = {c: np.asarray(v) for c, v in zip(cells.columns, cells.toArrow().columns, strict=True)}
    order = np.lexsort((found["place"], found["p2"], found["p1"]))
    found = {c: v[order] for c, v in found.items()}
    p1, p2 = found["p1"], found["p2"]
    new = np.ones(len(p1), bool)
    new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    taken = route_cells(
        np.cumsum(new) - 1, found["place"], found["size"], found["unique"], np.array([quotas[s] for s in names], np.int64)
    )
    parts = []
    for lo in range(0, max(len(taken), 1), portion):
        at = slice(lo, lo + portion)
        part = pa.table({"p1": p1[at], "p2": p2[at], "place": found["place"][at], "flow": taken[at]})
        parts.append(stage(spark.createDataFrame(part, "p1 bigint, p2 bigint, place int, flow bigint"), "mix-flow"))
    flow = parts[0]
    for part in parts[1:]:
        flow = flow.unionByName(part)
    keyed = in_cell.select("pattern", "source", *hashes).join(F.broadcast(number), "source")
    return keyed.join(flow, ["p1", "p2", "place"]).select("pattern", "source", "flow")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    bucket_rows: int = 2_000,
) -> DataFrame:
    """Words taken of each row: id, ``size``, ``source_size``, ``target``, ``taken``.

    Sources overlap where they hold the same text; a text's membership pattern is
    the set of sources that hold it. Rows are aggregated by pattern and source;
    that table (one row per pattern and source) goes to the driver as a few numbers a
    cell, where ``route_cells`` fixes the words of each cell. Within a cell
    every row is taken whole as often as the cell allows, and the rows taken once
    more are the first by a seeded hash. That cut needs no global order: word sums
    per hash bucket find the bucket where it falls, and only that bucket's rows are
    put in order, of which the last taken is taken in part.

    Reruns agree. A null text has size 0 and takes 0; a null source is a source of
    its own; repeated rows are mixed one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_of(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        _named(F.col(source_col)).alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(seed), text).alias("t2"),
    )
    rows = stage(rows, "mix-rows")
    held = rows.groupBy("t1", "t2").agg(
        F.array_join(F.sort_array(F.collect_set("source")), "\n").alias("pattern"), F.max("size").alias("once")
    )
    cells = rows.groupBy("t1", "t2", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    shared = stage(cells.join(held, ["t1", "t2"]), "mix-texts")
    in_cell = stage(
        shared.groupBy("pattern", "source").agg(
            F.sum("size").alias("size"), F.sum("once").alias("unique"), F.sum("n").alias("n")
        ),
        "mix-cells",
    )
    per = in_cell.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sizes: dict[str, int] = {r["source"]: r["size"] for r in per}
    names = sorted(sizes, key=lambda s: s.encode("utf-8", "surrogatepass"))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    goal = dict(zip(names, targets([sizes[s] for s in names], weights, SHARE * sum(sizes.values())), strict=True))
    quotas = {s: min(round(t), REPEATS * sizes[s]) for s, t in goal.items()}
    flow = _flow(in_cell, names, quotas)
    size = F.greatest(F.col("size"), F.lit(1))
    small = spark.createDataFrame(
        [(s, sizes[s], goal[s]) for s in names], "source string, source_size bigint, target double"
    )
    plan = in_cell.join(flow, ["pattern", "source"]).join(F.broadcast(small), "source")
    plan = plan.select(
        "pattern",
        "source",
        F.expr("flow div greatest(size, 1)").alias("times"),
        (F.col("flow") % size).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("bigint").alias("buckets"),
        "source_size",
        "target",
    )
    plan = stage(plan, "mix-plan")
    own = stage(shared.select("t1", "t2", "source", "pattern"), "mix-membership")
    placed = rows.join(own, ["t1", "t2", "source"]).join(small_side(plan), ["pattern", "source"])
    dealt = F.xxhash64(F.lit(seed), "id", "t1")
    placed = placed.select(
        "id", "source", "pattern", "size", "times", "rest", "source_size", "target", dealt.alias("draw"),
        F.pmod(dealt, F.col("buckets")).alias("bucket"),
    )
    placed = stage(placed, "mix-placed")
    cell = Window.partitionBy("pattern", "source")
    sums = placed.where("rest > 0").groupBy("pattern", "source", "bucket", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(cell.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("before", upto - F.col("words")).withColumn("upto", upto)
    cut = stage(
        sums.where("before < rest AND upto >= rest").select("pattern", "source", F.col("bucket").alias("cut"), "before"),
        "mix-cuts",
    )
    placed = placed.join(small_side(cut), ["pattern", "source"], "left")
    in_cut = F.col("bucket").eqNullSafe(F.col("cut"))
    order = Window.partitionBy("pattern", "source").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(in_cut).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn(
        "more", F.greatest(F.least(F.col("rest") - F.col("ahead"), F.col("size")), F.lit(0).cast("bigint"))
    ).drop("ahead")
    others = placed.where(~in_cut).withColumn(
        "more", F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("bigint"))
    )
    return edge.unionByName(others).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("more")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    portion: int = 1_000,
) -> DataFrame:
    """The mix as rows of ``docs``: each as often as it is taken, a part taken as the text up to that many words.

    Rows are told apart by their id and a digest of all their columns. Rows equal in
    all columns are interchangeable: what the mix takes of them has three values at
    most (times, one time more, or a part), so their number by value says all, and a
    row repeated often is written ``portion`` copies a piece of work. Columns may have
    any names; a row without words is not taken; an empty table gives no rows.
    """
    row = F.struct("*")
    json = F.to_json(row)
    key = F.concat_ws(
        ":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(json), F.xxhash64(F.lit(1), json)
    )
    keyed = docs.select(row.alias("row"), key.alias("key"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    counts = mix(keyed, "key", "text", "source").groupBy("key", "taken").agg(F.count(F.lit(1)).alias("copies"))
    shares = counts.groupBy("key").agg(
        F.collect_list(F.struct("taken", "copies")).alias("shares"), F.sum("copies").alias("rows"), F.max("taken").alias("most")
    )
    shares = stage(shares.where("most > 0").drop("most"), "mix-taken")
    rows = keyed.drop("source").join(shares, "key")
    each = F.explode(F.filter("shares", lambda s: s["taken"] > 0))
    alone = rows.where("rows = 1").select("row", "text", each.alias("share"), F.lit(0).cast("bigint").alias("part"))
    several = rows.where("rows > 1").dropDuplicates(["key"]).select("key", "row", "text", each.alias("share"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(share.copies - 1) div {portion}"))
    several = several.withColumn("part", F.explode(parts)).repartition("key", "share", "part").drop("key")
    rows = alone.unionByName(several)
    number = F.least(F.lit(portion).cast("bigint"), F.col("share.copies") - F.col("part") * portion)
    rows = rows.select("row", "text", "share.taken", F.explode(F.sequence(F.lit(1).cast("bigint"), number)).alias("turn"))
    rows = rows.withColumn("words", word_count(text_of(F.col("text"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("words")).cast("int"))))
    last = F.col("taken") - (F.col("copy") - 1) * F.col("words")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, 1, F.greatest(last, F.lit(1)).cast("int")), "")
    text = F.when(last >= F.col("words"), F.col("text")).otherwise(first)
    return rows.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
