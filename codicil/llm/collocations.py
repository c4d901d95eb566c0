"""Phrases whose words keep together, mined from sorted suffixes of pieces of text."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import stage
from codicil.llm.words import text_of

DEPTH = 5
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    _BREAKS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"." * len(_BREAKS) + b" abcdefghijklmnopqrstuvwxyz"
)
_BORDER, _NEXT = re.compile(rb"[ .]"), re.compile(rb"(?: *[^ ]+){0,%d}" % (DEPTH - 1))
_SLICE = 4 << 20
_SPLITTER_TEXTS = 4000
BLOCKS = "range int, lang string, suffixes binary, size bigint, counts binary"
PHRASES = "lang string, phrase string, n_words int, f bigint"


def _slices(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Runs of folded texts of about ``_SLICE`` bytes, joined by a break, each with the words that follow it.

    A text longer than that is cut between words; the words after a cut are read by
    suffixes that begin before it.
    """
    held, size = [], 0
    for text in texts:
        text = text.translate(_FOLD)
        if size + len(text) > _SLICE and held:
            yield b".".join(held), b""
            held, size = [], 0
        at = 0
        while len(text) - at > _SLICE and (cut := _BORDER.search(text, at + _SLICE // 2)):
            yield text[at : cut.start()], _NEXT.match(text, cut.start()).group()
            at = cut.start()
        held.append(text[at:])
        size += len(text) - at
    if held:
        yield b".".join(held), b""


class _Suffixes:
    """Distinct runs of up to five words from each word of a slice, in order of their words, with counts."""

    def __init__(self, blob: bytes, rest: bytes) -> None:
        words = blob.replace(b".", b" . ").split()
        own = len(words)
        words += rest.replace(b".", b" . ").split()[: DEPTH - 1]
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        number[b"."]
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        del number[b"."]
        self.words = sorted(number)
        rank = np.zeros(len(number) + 1, np.int64)
        rank[[number[w] for w in self.words]] = np.arange(1, len(number) + 1)
        codes = np.concatenate((rank[codes], np.zeros(DEPTH - 1, np.int64)))
        columns, alive = [], np.ones(own, bool)
        for k in range(DEPTH):
            alive = alive & (codes[k : k + own] > 0)
            columns.append(np.where(alive, codes[k : k + own], 0))
        begins = np.flatnonzero(columns[0])
        lead, middle, last = (columns[0] << 31 | columns[1])[begins], (columns[2] << 31 | columns[3])[begins], columns[4][begins]
        order = np.lexsort((last, middle, lead))
        keys = [k[order] for k in (lead, middle, last)]
        first = np.ones(len(order), bool)
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) if len(order) else first[1:]
        starts = np.flatnonzero(first)
        self.counts = np.diff(np.append(starts, len(order)))
        self.rows = np.column_stack([c[begins][order][starts] for c in columns]) if len(starts) else np.empty((0, DEPTH), np.int64)

    def places(self, splitters: list[tuple[bytes, ...]]) -> list[int]:
        """Where each splitter stands among the suffixes."""
        out = []
        for splitter in splitters:
            key = []
            for w in (*splitter, *[b""] * (DEPTH - len(splitter))):
                at = bisect_left(self.words, w) if w else -1
                key.append(0 if at < 0 else 2 * at + 2 if at < len(self.words) and self.words[at] == w else 2 * at + 1)
            out.append(bisect_left(range(len(self.rows)), tuple(key), key=lambda i: tuple((2 * self.rows[i]).tolist())))
        return out

    def texts(self, rows: np.ndarray) -> pa.Array:
        """Words of each row joined by blanks."""
        lengths = np.count_nonzero(rows, axis=1)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        values = pa.array(self.words, pa.binary()).take(pa.array(rows[rows > 0] - 1))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), b" ")


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, _Suffixes]]:
    langs = pc.dictionary_encode(batch.column(0))
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column(1).filter(pc.equal(langs.indices, code)).cast(pa.binary())
        for blob, rest in _slices(t.as_py() for t in texts):
            found = _Suffixes(blob, rest)
            if len(found.rows):
                yield lang, found


def _drawn(batches: Iterator[pa.RecordBatch], every: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, found in _by_lang(batch):
            texts = found.texts(found.rows[every // 2 :: every]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), texts], ["lang", "suffix"])


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked(table: pa.Table) -> tuple[list[str], np.ndarray, pa.Array, np.ndarray]:
    """Blocks of one range: languages, and language, suffix and count of each row."""
    langs = sorted(set(table["lang"].to_pylist()))
    owners, texts, counts = [], [], []
    for lang, text, size, n in zip(*(table[c].to_pylist() for c in ("lang", "suffixes", "size", "counts"))):
        lines = pa.array([pa.decompress(text, size, "zstd", asbytes=True)], pa.binary()).cast(pa.string())
        texts.append(pc.split_pattern(lines, "\n").flatten())
        owners.append(np.full(len(texts[-1]), langs.index(lang) + 1, np.int32))
        counts.append(np.frombuffer(pa.decompress(n, 8 * len(texts[-1]), "zstd", asbytes=True), "<i8"))
    return langs, np.concatenate(owners), pa.concat_arrays(texts), np.concatenate(counts)


def _routing(splitters: list[tuple[str, tuple[bytes, ...]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that sends the suffixes of a slice, in one packed block a range of words, to that range."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, found in _by_lang(batch):
                lo = bisect_left(splitters, lang, key=lambda s: s[0])
                own = list(itertools.takewhile(lambda s: s[0] == lang, itertools.islice(splitters, lo, None)))
                cuts = [0, *found.places([s[1] for s in own]), len(found.rows)]
                texts = found.texts(found.rows)
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), texts)
                blocks = [
                    (lo + i, lang, pa.compress(text, "zstd", asbytes=True), len(text), _packed(found.counts[cuts[i] : cuts[i + 1]]))
                    for i, text in enumerate(pc.binary_join(lists, b"\n").to_pylist())
                    if cuts[i] < cuts[i + 1]
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["range", "lang", "suffixes", "size", "counts"])

    return route


def frequent_prefixes(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Multikey three-way quicksort: every leading run of keys with its weight.

    ``columns[d]`` holds key ``d`` of each row, 0 past its end. A partition of equal
    keys is a leading run and its weight the count; partitions below ``least`` are
    abandoned, but for the runs of the least and the greatest row: those may go on
    in the neighbouring range and are given at any weight.
    """
    ends = []
    for pick in (np.min, np.max):
        rows, keys = np.arange(len(weights)), []
        for column in columns:
            keys.append(int(pick(column[rows])))
            rows = rows[column[rows] == keys[-1]]
        ends.append(keys)
    low, high = ends
    todo = [(np.arange(len(weights)), 0, (), True, True)]
    while todo:
        rows, depth, path, at_low, at_high = todo.pop()
        keys = columns[depth][rows]
        pivot = int(np.median(keys[[0, len(keys) // 2, -1]]))
        for part, below, above in (
            (rows[keys < pivot], at_low and low[depth] < pivot, at_high and high[depth] < pivot),
            (rows[keys > pivot], at_low and low[depth] > pivot, at_high and high[depth] > pivot),
        ):
            if len(part) and (below or above or weights[part].sum() >= least):
                todo.append((part, depth, path, below, above))
        if pivot == 0:
            continue
        part, below, above = rows[keys == pivot], at_low and low[depth] == pivot, at_high and high[depth] == pivot
        weight = int(weights[part].sum())
        if below or above or weight >= least:
            yield (*path, pivot), weight
            if depth + 1 < len(columns):
                todo.append((part, depth + 1, (*path, pivot), below, above))


def _counting(least: int) -> Callable[[pa.Table], pa.Table]:
    """Task that sorts the suffixes of one range; a row without phrase holds the words of a language."""

    def count(table: pa.Table) -> pa.Table:
        names, owners, suffixes, weights = _unpacked(table)
        lists = pc.split_pattern(suffixes, " ")
        codes = pc.dictionary_encode(lists.flatten())
        order = pc.sort_indices(codes.dictionary).to_numpy()
        words, rank = codes.dictionary.take(pa.array(order)).to_pylist(), np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        flat, offsets = rank[codes.indices.to_numpy()], lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        lengths = np.diff(offsets)
        columns = [owners]
        for k in range(DEPTH):
            column = np.zeros(len(lengths), np.int32)
            column[lengths > k] = flat[offsets[:-1][lengths > k] + k]
            columns.append(column)
        out: list[tuple] = []
        for path, weight in frequent_prefixes(columns, weights, least):
            phrase = " ".join(words[p - 1] for p in path[1:]) if len(path) > 1 else None
            out.append((names[path[0] - 1], phrase, len(path) - 1, weight))
        held = np.bincount(columns[0], weights=weights, minlength=len(names) + 1)
        out = [r for r in out if r[1] is not None] + [(lang, None, 0, int(h)) for lang, h in zip(names, held[1:])]
        lang, phrase, n_words, f = zip(*out)
        return pa.table(
            {"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()), "n_words": pa.array(n_words, pa.int32()), "f": pa.array(f, pa.int64())}
        )

    return count


def phrase_counts(
    docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", range_rows: int = 600_000
) -> DataFrame:
    """Runs of one to five words that occur ``least`` times or more in a language: lang, phrase, ``n_words``, f.

    A row with ``n_words`` 0 and no phrase holds all word occurrences of a language.

    Each word of a piece begins a suffix, cut after five words. A task counts the
    equal suffixes of its texts, and sampled splitters route them by their leading
    words to ranges of about ``range_rows`` suffixes, so that a frequent leading
    word is spread over as many ranges as it needs; splitters only set the size of
    ranges, never a result. Each range is sorted by multikey quicksort. Runs that
    touch the end of a range are summed across ranges.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(F.col(text_col)).alias("body")
    )
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    ranges = 1 + size // (6 * range_rows)
    sample = texts.sample(min(1.0, _SPLITTER_TEXTS / max(rows, 1)), seed=12) if ranges > 1 else texts.limit(0)
    drawn = sorted((r.lang, tuple(r.suffix.encode().split(b" "))) for r in sample.mapInArrow(_drawn, "lang string, suffix string").collect())
    splitters = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    routed = texts.mapInArrow(_routing(splitters), BLOCKS)
    counted = routed.groupBy("range").applyInArrow(_counting(least), PHRASES)
    found = counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").cast("bigint").alias("f"))
    return stage(found.where((F.col("f") >= least) | F.col("phrase").isNull()), "phrase-counts")


def collocations(
    docs: DataFrame,
    least: int = 100,
    most: int = 2000,
    covered: int = 100,
    text_col: str = "text",
    lang_col: str = "lang",
    range_rows: int = 600_000,
) -> DataFrame:
    """Best phrases of two to five words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two sides of its weakest cut, ``n``
    all words of the language; score is ``floor(1000 * a * n / (l * r))``. A phrase
    inside a longer frequent one with at least ``covered`` percent of its count is
    dropped. The first ``most`` of each language are returned, by score, count and phrase.

    Texts are folded at A-Z and cut at ``.,;:!?`` and line breaks into pieces; no
    phrase crosses a piece or a text. A null text has no words, a null language is
    ``und``. Repeated rows count each. An empty table gives no rows. Columns
    besides text and language are not looked at.
    """
    return ranked_phrases(phrase_counts(docs, least, text_col, lang_col, range_rows), most, covered)


def ranked_phrases(counts: DataFrame, most: int, covered: int) -> DataFrame:
    """``collocations`` of counted phrases; sums and products are decimals of 38 digits, so scores are exact."""
    phrases = counts.where("n_words > 0").select("lang", "phrase", "n_words", "f")
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    longer = phrases.where("n_words > 1").withColumn("words", F.split("phrase", " "))
    part = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"),
    )
    side = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    whole = "CAST({} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({whole.format('a')} * {whole.format('n')})) DIV ({whole.format('l')} * {whole.format('r')})")
    scored = (
        cut.join(side("first", "l"), ["lang", "first"])
        .join(side("rest", "r"), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best"))
        .select("lang", "phrase", "best.*")
    )
    inner = (
        longer.where("n_words > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
        .groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase"))
        .agg(F.max("f").alias("around"))
    )
    left = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * covered)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
