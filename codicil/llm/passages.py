"""Removal of passages that recur anywhere in the corpus, located by sharded word automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.words import Rolling, Words, as_long, leftmost_least, mixed, raw_texts, text_of

#: Words of the sampled phrase inside each window. A window names the least-hashed such phrase it holds.
PHRASE = 12


class Windows:
    """Windows of a column of texts, each with the phrase it names, a function of the window's words alone."""

    def __init__(self, column: pa.Array, width: int, rolling: tuple[Rolling, Rolling]) -> None:
        self.words, self.width, self.rolling = Words(column, rolling[0]), width, rolling
        codes, text = self.words.codes, self.words.text
        phrases = rolling[0].windows(rolling[0].sums(codes), PHRASE)
        least = leftmost_least(phrases, width - PHRASE + 1)
        self.sums = rolling[1].sums(codes)
        self.start = np.flatnonzero(text[: len(least)] == text[width - 1 :][: len(least)])
        self.at = least[self.start]
        self.phrase = as_long(phrases[self.at])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per run of windows with one phrase: the phrase, and a hash of all its words with the phrase's place."""
        if not len(self.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        new = np.concatenate(([True], self.at[1:] != self.at[:-1]))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(new)])) - 1
        begin, end = self.start[first], self.start[last]
        context = self.rolling[1].spans(self.sums, begin, end + self.width)
        shape = ((self.at[first] - begin) * 4096 + (end - begin)).astype(np.uint64)
        return self.phrase[first], as_long(mixed(context ^ (shape * np.uint64(0x9E3779B97F4A7C15))))

    def hashes(self, which: np.ndarray) -> np.ndarray:
        begin = self.start[which]
        return as_long(self.rolling[1].spans(self.sums, begin, begin + self.width))


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, and where each group of equal keys starts in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _portions(column: pa.ChunkedArray, size: int = 2_000_000) -> Iterator[pa.Array]:
    """Texts of about ``size`` bytes at a time."""
    for chunk in column.chunks:
        upto = np.cumsum(pc.binary_length(chunk).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
            yield chunk.slice(lo, hi - lo)
            lo = hi


def _phrases(width: int):
    """Task on a bucket: its phrases, their number of runs, and their least and greatest context."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        rolling = Rolling(0), Rolling(1)
        found = [Windows(texts, width, rolling).runs() for texts in _portions(docs.column("text"))]
        phrase = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
        context = np.concatenate([c for _, c in found]) if found else np.empty(0, np.int64)
        order, start = grouped([phrase])
        held = context[order]
        return pa.table(
            {
                "phrase": phrase[order][start],
                "bucket": np.full(len(start), key[0].as_py(), np.int32),
                "n": np.diff(np.append(start, len(order))).astype(np.int32),
                "low": np.minimum.reduceat(held, start) if len(start) else held,
                "high": np.maximum.reduceat(held, start) if len(start) else held,
            }
        )

    return run


def _long_column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _open_windows(width: int):
    """Task on a bucket: its windows whose phrase stands in several contexts, with their counts."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        opened = np.sort(_long_column(asked, "phrase")[_long_column(asked, "whole") == 0])
        phrase, window = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rolling = Rolling(0), Rolling(1)
        for texts in _portions(docs.column("text")) if len(opened) else ():
            windows = Windows(texts, width, rolling)
            which = np.flatnonzero(is_in(windows.phrase, opened))
            phrase.append(windows.phrase[which])
            window.append(windows.hashes(which))
        phrase, window = np.concatenate(phrase), np.concatenate(window)
        order, start = grouped([phrase, window])
        return pa.table(
            {
                "phrase": phrase[order][start],
                "window": window[order][start],
                "bucket": np.full(len(start), key[0].as_py(), np.int32),
                "n": np.diff(np.append(start, len(order))).astype(np.int32),
            }
        )

    return run


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def located(texts: list[np.ndarray], passages: set[bytes]) -> list[np.ndarray]:
    """Mark the words of each text that any passage covers: one automaton over word numbers, each text streamed once.

    Texts and passages are word numbers below 2**32, passages as their bytes.
    """
    marks = [np.zeros(len(t) + 1, np.int32) for t in texts]
    if passages:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in passages:
            automaton.add_word(tuple(np.frombuffer(p, np.int64).tolist()), len(p) // 8)
        automaton.make_automaton()
        for text, mark in zip(texts, marks, strict=True):
            for last, size in automaton.iter(tuple(text.tolist())):
                mark[last + 1 - size] += 1
                mark[last + 1] -= 1
    return [np.cumsum(m[:-1]) > 0 for m in marks]


def _removed(width: int, out_id: str, whole_text: bool):
    """Task on a bucket: compile its confirmed passages, locate every occurrence, and cut them out."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, known: pa.Table) -> pa.Table:
        kind = _long_column(known, "whole")
        phrase, window = _long_column(known, "phrase"), _long_column(known, "window")
        whole = np.sort(phrase[kind == 1])
        order = np.argsort(window[kind == 2], kind="stable")
        again, again_phrase = window[kind == 2][order], phrase[kind == 2][order]
        rolling, codes, counts, runs = (Rolling(0), Rolling(1)), [], [], []
        base = 0
        for texts in _portions(docs.column("text")):
            windows = Windows(texts, width, rolling)
            codes.append(windows.words.codes)
            counts.append(windows.words.counts)
            recurs = is_in(windows.phrase, whole)
            if len(again):
                own = windows.hashes(np.arange(len(recurs)))
                place = np.minimum(np.searchsorted(again, own), len(again) - 1)
                recurs |= (again[place] == own) & (again_phrase[place] == windows.phrase)
            begin = windows.start[recurs]
            if len(begin):
                text = windows.words.text[begin]
                new = np.concatenate(([True], (begin[1:] != begin[:-1] + 1) | (text[1:] != text[:-1])))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(begin)])) - 1
                runs += zip((begin[first] + base).tolist(), (begin[last] + width + base).tolist(), strict=True)
            base += len(windows.words.codes)
        codes = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        total = np.concatenate(counts) if counts else np.empty(0, np.int64)
        numbers = np.unique(codes, return_inverse=True)[1].astype(np.int64) if runs else np.zeros(len(codes), np.int64)
        texts = np.split(numbers, np.cumsum(total)[:-1]) if len(total) else []
        covered = located(texts, {numbers[a:b].tobytes() for a, b in runs})
        gone, kept = [], []
        for raw, cover in zip((r for c in docs.column("text").chunks for r in raw_texts(c)), covered, strict=True):
            n = int(cover.sum())
            words = raw.split()
            left = b" ".join(compress(words, (~cover).tolist()) if n else words)
            gone.append(n)
            kept.append(left.decode() if whole_text else hashlib.sha256(left).hexdigest())
        return pa.table(
            [docs.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=[out_id, "n_words", "n_removed", "kept_text" if whole_text else "kept_sha256"],
        )

    return run


def cut_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 35,
    bucket_chars: int = 6_000_000,
    digests: bool = False,
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and ``kept_text`` (or its SHA-256) without the words of recurring windows.

    A window is ``width`` consecutive words; it recurs if its words also start
    anywhere else. Rows are dealt to buckets of about ``bucket_chars`` characters.
    *Confirm:* each window names its least-hashed phrase of 12 words, so equal
    windows name equal phrases; phrases are counted over the corpus, one row a bucket.
    Where a recurring phrase has one context everywhere, all its windows recur; for
    the others the windows themselves are counted, by two independent hashes.
    *Compile:* a bucket's maximal runs of recurring windows are its passages and go
    into one automaton over words: the shards are the buckets, and a shard holds
    the passages its texts can contain, so no text meets every shard.
    *Locate:* all texts of the bucket stream through its automaton.

    Copies never make a group: a passage that a third of all rows hold is one row
    in each bucket. Null and empty texts have no words. Equal rows recur with each
    other. An empty table gives none. Columns besides id and text are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // bucket_chars))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))
    kind = rows.schema["id"].dataType.simpleString()

    phrases = (
        rows.groupBy("bucket")
        .applyInArrow(_phrases(width), "phrase bigint, bucket int, n int, low bigint, high bigint")
        .repartition(parts, "phrase")
    )
    same = Window.partitionBy("phrase")
    asked = (
        phrases.select(
            "bucket",
            "phrase",
            (F.min("low").over(same) == F.max("high").over(same)).cast("bigint").alias("whole"),
            F.sum("n").over(same).alias("total"),
        )
        .where("total > 1")
        .drop("total")
    )
    windows = (
        rows.groupBy("bucket")
        .cogroup(asked.groupBy("bucket"))
        .applyInArrow(_open_windows(width), "phrase bigint, window bigint, bucket int, n int")
        .repartition(parts, "phrase", "window")
    )
    same = Window.partitionBy("phrase", "window")
    recurring = windows.select("bucket", "phrase", "window", F.sum("n").over(same).alias("total")).where("total > 1")
    known = asked.where("whole = 1").select("bucket", "phrase", F.lit(0).cast("bigint").alias("window"), "whole")
    known = known.unionByName(
        recurring.select("bucket", "phrase", "window", F.lit(2).cast("bigint").alias("whole"))
    )
    return (
        rows.groupBy("bucket")
        .cogroup(known.groupBy("bucket"))
        .applyInArrow(
            _removed(width, id_col, not digests),
            f"`{id_col}` {kind}, n_words bigint, n_removed bigint, "
            + ("kept_sha256 string" if digests else "kept_text string"),
        )
    )
