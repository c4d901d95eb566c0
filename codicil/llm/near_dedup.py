"""Near-duplicate documents: a size-aware heavy-light join of shingle sets under a Jaccard bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import drop_staged, small_side, stage, staged_paths
from codicil.llm.components import components
from codicil.llm.exact_dedup import any_order
from codicil.llm.passages import _portions
from codicil.llm.words import Rolling, Words, as_long, mixed, text_of

#: Fixed values of the join: words of a shingle, and the bound 100 * intersection >= 75 * union.
WIDTH, BOUND = 5, 75
SLOT_BITS = 19
RANGES = 512
STAR_ROUNDS = 3
#: Lists of more members are compared block by block in tasks, of so many members a block.
LONG_LIST, BLOCK = 64, 1024
SIZES = (2, 4, 6, 8, 12, 16, 24)


class Shingles:
    """Distinct shingles of a column of texts: ``row`` and ``hash`` ordered by both, and their number per row.

    A text of fewer words than a shingle has its whole sequence as the only one.
    """

    def __init__(self, column: pa.Array, rolling: Rolling) -> None:
        words = Words(column, rolling, fold=True)
        sums = rolling.sums(words.codes)
        n, text = len(words.codes), words.text
        start = np.flatnonzero(text[: max(0, n - WIDTH + 1)] == text[WIDTH - 1 :])
        end = start + WIDTH
        few = np.flatnonzero((words.counts > 0) & (words.counts < WIDTH))
        first = np.cumsum(words.counts) - words.counts
        start = np.concatenate((start, first[few]))
        end = np.concatenate((end, first[few] + words.counts[few]))
        row, found = text[start], rolling.spans(sums, start, end)
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
        self.row, self.hash = row[new], found[new]
        self.size = np.bincount(self.row, minlength=len(column))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys per set, sums of mixed members."""
        out = []
        for salt in (0x51ED270B, 0xB5297A4D):
            total = np.zeros(len(self.size) + 1, np.uint64)
            np.add.at(total, self.row, mixed(self.hash * np.uint64(2) + np.uint64(salt)))
            out.append(as_long(total[:-1]))
        return out[0], out[1]


def profiles(sets: Shingles) -> list[bytes]:
    """Members of each set per range of the hash space, at most 255 each, as bytes."""
    width = np.uint64((1 << 64) // RANGES)
    out, ends = [], np.cumsum(sets.size)
    for k, n in enumerate(sets.size.tolist()):
        at = (sets.hash[ends[k] - n : ends[k]] // width).astype(np.int64)
        out.append(np.minimum(np.bincount(at, minlength=RANGES), 255).astype(np.uint8).tobytes())
    return out


def slot(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_size(size, extra: int = 1):
    """Members of a set that must hold ``extra`` common ones with any similar set: size - ceil(bound * size) + extra."""
    return size + (-BOUND * size) // 100 + extra


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles per slot of the hash space, over all texts of the task."""
    rolling, total = Rolling(), np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for texts in _portions(pa.chunked_array([batch.column(0)])):
            total += np.bincount(slot(Shingles(texts, rolling).hash), minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["slot", "n"])


def _sets(hot) -> Callable:
    """Task: id, set size, both keys, and the set's first members in the order (slot is hot, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        late = np.zeros(1 << SLOT_BITS, bool)
        late[hot.value] = True
        for batch in batches:
            at = 0
            for texts in _portions(pa.chunked_array([batch.column(1)])):
                sets = Shingles(texts, rolling)
                order = np.lexsort((sets.hash, late[slot(sets.hash)], sets.row))
                members = as_long(sets.hash[order])
                first = np.cumsum(sets.size) - sets.size
                want = np.minimum(prefix_size(sets.size, 2), sets.size)
                place = np.arange(len(members)) - np.repeat(first, sets.size)
                members = members[place < np.repeat(want, sets.size)]
                offsets = np.concatenate(([0], np.cumsum(want))).astype(np.int32)
                one, two = sets.keys()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(sets.size, pa.int64()),
                        pa.array(one),
                        pa.array(two),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(members)),
                        pa.array(profiles(sets), pa.binary()),
                    ],
                    names=["id", "n", "v", "w", "prefix", "profile"],
                )
                at += len(texts)

    return run


def _postings(boundary: int) -> Callable:
    """Task: (key, v, n, kind, ahead) of each set. Kind 0: member of a heavy set, 1: of a light set that a heavy one
    may match, 2: subset of two members of a light set. ``ahead`` counts the members before the key's last one, its
    own not among them: where two sets meet in their first common key, none of these is common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, n = (batch.column(k).to_numpy() for k in (0, 1))
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            members = lists.values.to_numpy()
            held = np.diff(offsets)
            single = np.minimum(prefix_size(n, 1), held)
            single[4 * n < 3 * boundary] = 0
            row = np.repeat(np.arange(len(v)), held)
            place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], held)
            chosen = place < single[row]
            out = [
                (
                    members[offsets[0] : offsets[-1]][chosen],
                    row[chosen],
                    (n[row[chosen]] < boundary).astype(np.int32),
                    place[chosen].astype(np.int32),
                )
            ]
            for i in np.flatnonzero((n < boundary) & (n > 1)).tolist():
                own = members[offsets[i] : offsets[i + 1]].view(np.uint64)
                a, b = np.triu_indices(len(own), 1)
                keys = as_long(mixed(mixed(own[a]) + own[b]))
                out.append((keys, np.full(len(keys), i), np.full(len(keys), 2, np.int32), (b - 1).astype(np.int32)))
            key, row, kind, ahead = (np.concatenate([o[k] for o in out]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(v[row]), pa.array(n[row]), pa.array(kind.astype(np.int32)), pa.array(ahead)],
                names=["key", "v", "n", "kind", "ahead"],
            )

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, whose key another row has; nothing but the last row is held."""
    pending, alike = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([pending, batch] if pending is not None else [batch]).combine_chunks()
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate(([alike], same)) | np.concatenate((same, [False]))
        yield from table.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
        pending, alike = table.slice(len(key) - 1).to_batches()[0], bool(keep[-1])
    if pending is not None and alike:
        yield pending


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts' shingle sets reach the bound, both sets counted in full."""
    rolling = Rolling()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            left, right = Shingles(part.column(2), rolling), Shingles(part.column(3), rolling)
            row, found = np.concatenate((left.row, right.row)), np.concatenate((left.hash, right.hash))
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (found[1:] == found[:-1])], minlength=part.num_rows)
            either = left.size + right.size - both
            good = pa.array(100 * both >= BOUND * either)
            yield pa.RecordBatch.from_arrays([part.column(k).filter(good) for k in (0, 1)], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose profiles differ by no more than sets within the bound can: 7 * difference <= sum of sizes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            one, two = (
                np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16)
                for k in (3, 4)
            )
            apart = np.abs(one - two).sum(axis=1, dtype=np.int64)
            good = pa.array((100 + BOUND) * apart <= (100 - BOUND) * part.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(k).filter(good) for k in (0, 1)], names=["a", "b"])


def _block_pairs(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Close pairs across components between two blocks of one list, or within one; the other pairs leave no row."""
    same = key[1].as_py() == key[2].as_py()
    v, n, kind, ahead, comp, block = (
        rows.column(c).to_numpy() for c in ("v", "n", "kind", "ahead", "comp", "block")
    )
    shape = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16)
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(len(v)):
        other = slice(i + 1, None)
        sizes = n[i] + n[other]
        may = (
            (comp[other] != comp[i])
            & (same | (block[other] != block[i]))
            & (100 * np.minimum(n[i], n[other]) >= BOUND * np.maximum(n[i], n[other]))
            & ((100 + BOUND) * (ahead[i] + ahead[other]).astype(np.int64) <= (100 - BOUND) * sizes)
            & ~((kind[i] == 1) & (kind[other] == 1))
        )
        at = np.flatnonzero(may)
        if len(at):
            apart = np.abs(shape[i + 1 + at] - shape[i]).sum(axis=1, dtype=np.int64)
            at = at[(100 + BOUND) * apart <= (100 - BOUND) * sizes[at]] + i + 1
            one.append(np.minimum(v[at], v[i]))
            two.append(np.maximum(v[at], v[i]))
    return pa.table({"a": np.concatenate(one), "b": np.concatenate(two)})


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        for texts in _portions(pa.chunked_array([batch.column(0)])):
            yield pa.RecordBatch.from_arrays([pa.array(Shingles(texts, rolling).keys()[0]), texts], names=["v", "text"])


def boundary_by_cost(sets: DataFrame) -> int:
    """Size below which sets are light: the one with the least postings plus pairs met in lists.

    For every candidate the postings follow from the number of sets of each size;
    the pairs of light sets that one-member lists would make are counted over all
    small sets.
    """
    small = sets.where(f"n > 1 AND n < {SIZES[-1]}")
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    lists = small.select("n", F.explode(F.slice("prefix", 1, F.size("prefix") - 1)).alias("key")).groupBy("key")
    counts = lists.agg(*[F.count_if(F.col("n") < x).alias(f"c{x}") for x in SIZES])
    pairs = counts.agg(*[F.sum(F.col(f"c{x}") * (F.col(f"c{x}") - 1) / 2).alias(f"c{x}") for x in SIZES]).first()

    def cost(x: int) -> float:
        total = -(pairs[f"c{x}"] or 0)
        for n, count in sizes.items():
            if n < x:
                p = prefix_size(n, 2)
                total += count * (p * (p - 1) / 2 - (p - 1 if 4 * n < 3 * x else 0))
        return total

    return min(SIZES, key=lambda x: (cost(x), x))


def _may_match():
    """Sizes within the bound, not two light sets in a one-member list, and few enough members before the key.

    Members before the first common key belong to one set only, so there are at
    most as many as similar sets may differ by; a pair passes at that key at least.
    """
    n, m = F.col("n"), F.col("m")
    near = 100 * F.least(n, m) >= BOUND * F.greatest(n, m)
    alike = (100 + BOUND) * (F.col("ahead") + F.col("before")) <= (100 - BOUND) * (n + m)
    return near & alike & ~((F.col("kind") == 1) & (F.col("other") == 1))


def near_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between distinct sets ``v``, enough of them to join all that any links join.

    Sets below the boundary meet in lists of two-member subsets, the others in
    lists of single members, light ones of nearly that size included. A list is
    first a star: its members are checked against one of them, the same one in all
    lists that hold it. Lists whose members are then in several components are
    starred again, each around a member of its own, and at last all their pairs
    across components are checked, so no component lacks a link that some pair has.
    Lists of more than 64 members are then compared in blocks inside tasks, which
    give out close pairs only.
    A check compares counts per hash range first, which bound the difference of two
    sets from below, and then the sets of the texts themselves.
    """
    classes = sets.where("n > 1").groupBy("v", "w", "n").agg(F.any_value("prefix").alias("prefix"))
    classes = stage(classes.drop("w"), "near-classes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = classes.select("v", "n", "prefix").mapInArrow(
        _postings(boundary_by_cost(classes)), "key bigint, v bigint, n bigint, kind int, ahead int"
    )
    lists = postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared_keys, postings.schema)
    lists = stage(lists, "near-lists")
    members = lists.select("v").distinct()
    shapes = sets.where("n > 1").select("v", "profile", "id").join(members, "v", "left_semi").groupBy("v")
    shapes = stage(shapes.agg(F.any_value("profile").alias("profile"), F.min("id").alias("id")), "near-shapes")
    texts = None

    def texts_of(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
        if known is not None:
            wanted = wanted.join(known, "v", "left_anti")
        wanted = stage(wanted.join(shapes, "v").select("v", "id"), "near-wanted")
        ids = small_side(wanted.select(F.col("id").alias("want")).distinct())
        read = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
        read = read.join(ids, read["id"].eqNullSafe(F.col("want")), "left_semi").select("text")
        read = read.mapInArrow(_texts_of, "v bigint, text string").join(wanted.select("v"), "v", "left_semi")
        found = stage(read.groupBy("v").agg(F.min("text").alias("text")), "near-texts")
        return found if known is None else known.unionByName(found)

    def possible(pairs: DataFrame) -> DataFrame:
        left = pairs.join(shapes.select(F.col("v").alias("a"), F.col("profile").alias("left")), "a")
        both = left.join(shapes.select(F.col("v").alias("b"), F.col("profile").alias("right")), "b")
        return both.select("a", "b", "sizes", "left", "right").mapInArrow(_possible, "a bigint, b bigint")

    def blocked(rows: DataFrame) -> DataFrame:
        count = F.ceil(F.col("length") / BLOCK).cast("int")
        rows = rows.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("v"), F.col("count")).cast("int"))
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
        rows = rows.join(shapes.select("v", "profile"), "v")
        columns = ["key", "low", "high", "v", "n", "kind", "ahead", "comp", "block", "profile"]
        return rows.select(columns).groupBy("key", "low", "high").applyInArrow(_block_pairs, "a bigint, b bigint")

    def checked(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("left")), "a")
        both = left.join(texts.select(F.col("v").alias("b"), F.col("text").alias("right")), "b")
        return both.select("a", "b", "left", "right").mapInArrow(_linked, "a bigint, b bigint")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            F.least("v", "c").alias("a"), F.greatest("v", "c").alias("b"), (F.col("n") + F.col("m")).alias("sizes")
        ).distinct()

    links = tried = None
    for turn in range(STAR_ROUNDS + 1):
        opened: list[str] = []
        if links is None:
            open_lists = lists.withColumn("comp", F.col("v"))
        else:
            with staged_paths() as named_by:
                labels = components(links)
            named = lists.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
            spread = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            with staged_paths() as opened:
                open_lists = stage(named.join(spread.select("key"), "key"), "near-open")
            drop_staged(docs.sparkSession, named_by)
        if turn < STAR_ROUNDS:
            draw = [F.xxhash64("v")] if turn == 0 else [F.xxhash64(F.lit(turn), "key", "v")]
            centre = F.min(F.struct(*draw, "v", "n", "kind", "ahead", "comp"))
            centres = open_lists.groupBy("key").agg(centre.alias("s")).select(
                "key", F.col("s.v").alias("c"), F.col("s.n").alias("m"), F.col("s.kind").alias("other"),
                F.col("s.ahead").alias("before"), F.col("s.comp").alias("apart"),
            )
        else:
            lengths = open_lists.groupBy("key").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") > LONG_LIST)
            lengths = stage(lengths, "near-lengths")
            blocks = blocked(open_lists.join(lengths, "key"))
            open_lists = open_lists.join(lengths, "key", "left_anti")
            centres = open_lists.select(
                "key", F.col("v").alias("c"), F.col("n").alias("m"), F.col("kind").alias("other"),
                F.col("ahead").alias("before"), F.col("comp").alias("apart"),
            )
        met = open_lists.join(centres, "key").where((F.col("comp") != F.col("apart")) & _may_match())
        if turn == STAR_ROUNDS:
            met = met.where("v < c")
        pairs = ordered(met)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        with staged_paths() as made:
            close = possible(pairs)
            close = stage(close if turn < STAR_ROUNDS else close.union(blocks).distinct(), "near-possible")
        texts = texts_of(close, texts)
        found = stage(checked(close), "near-links")
        drop_staged(docs.sparkSession, made + opened)
        links = found if links is None else links.unionByName(found)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the least id that links reach.

    Two rows link if their sets of five-word shingles, A-Z read as a-z, have
    100 * intersection >= 75 * union. Equal sets are one class and never expand
    into pairs. Members are ordered by a hash, members of crowded hash slots last,
    so that passages which many texts share stay out of the compared prefixes; the
    order changes cost, not results.

    A text without words, null included, links with nothing and has its own id. A
    row with a null id links like any other, and has a null component only if no
    member of its component has an id. Equal rows are in one class. An empty table
    gives no rows. Sets are told apart by 64-bit hashes of shingles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    slots = rows.select("text").mapInArrow(_slot_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    slots = stage(slots, "near-slots")
    mean = (slots.agg(F.sum("n")).first()[0] or 0) / (1 << SLOT_BITS)
    crowded = slots.where(F.col("n") > mean + 6 * mean**0.5 + 32).select("slot")
    hot = spark.sparkContext.broadcast(np.array([r["slot"] for r in crowded.collect()], np.int64))
    sets = rows.mapInArrow(_sets(hot), f"id {kind}, n bigint, v bigint, w bigint, prefix array<bigint>, profile binary")
    sets = stage(sets, "near-sets")
    comps = components(near_links(docs, sets, id_col, text_col))
    classes = sets.where("n > 0").groupBy("v").agg(F.min("id").alias("least"))
    classes = classes.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    classes = stage(classes, "near-components")
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stage(classes.join(least, "comp").select("v", "component_id"), "near-named")
    return sets.select("id", "n", "v").join(named, "v", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stand for their component: one with the least id, and all rows without words.

    A null id stands only for a component without ids. Rows that share that id are
    told apart by hashes of their texts; of rows equal in both the one first by a
    digest of all columns stays. Columns may have any names. An empty table gives no rows.
    """
    text = text_of(F.col(text_col))
    row = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    keyed = docs.select(
        F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), *row).alias("__row"),
        F.col(text_col).alias("__text"),
    )
    with staged_paths() as made:
        found = stage(near_dedup(keyed, "__row", "__text"), "near-groups")
    kept = found.where(F.col("__row") == F.col("component_id")).groupBy("__row").agg(
        F.count(F.lit(1)).alias("__copies"), F.max("n_shingles").alias("__shingles")
    )
    kept = kept.select(
        F.col("__row.id").alias("kept_id"), F.col("__row.t1").alias("t1"), F.col("__row.t2").alias("t2"),
        ((F.col("__copies") > 1) & (F.col("__shingles") > 0)).alias("several"),
    )
    kept = stage(kept, "near-kept")
    drop_staged(docs.sparkSession, made)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *row)
    rows = rows.join(kept.withColumnRenamed("kept_id", "other"), ["t1", "t2"])
    rows = rows.where(F.col("id").eqNullSafe(F.col("other")))
    several = rows.where("several").groupBy("id", "t1", "t2").agg(F.min_by("row", any_order(F.col("row"))).alias("row"))
    return rows.where("NOT several").select("row").unionByName(several.select("row")).select("row.*")
