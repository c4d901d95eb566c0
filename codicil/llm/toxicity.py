"""Toxicity: a support vector machine on a gapped-subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import small_side, stage
from codicil.llm.words import Rolling, Words, raw_texts, text_of

#: Subsequences of four characters within a span of seven, each gap of one character weighing DECAY.
ORDER, SPAN, DECAY = 4, 7, 0.6
_CLASSES = 64
_LEAST = -2.0
_OFFSETS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
_WEIGHTS = np.array([DECAY ** (o[-1] - ORDER + 1) for o in _OFFSETS])
_ENTRIES = 200_000
_LONGEST = 40
#: Words of a text, and rows of a batch, that the gathering of neighbourhoods holds at a time.
_SPAN_WORDS = 50_000
#: Words whose kernel is computed at a time.
_PORTION = 1_024
STEMS = (4, 5, 6)


def _classes() -> np.ndarray:
    """Class of each code point: word mark 1, a-z 2 to 27, digits 28, others by code point."""
    points = np.arange(0x110000)
    table = 29 + points % 35
    table[ord("a") : ord("z") + 1] = np.arange(2, 28)
    table[ord("0") : ord("9") + 1] = 28
    table[ord("_")] = 1
    return table.astype(np.uint8)


_CLASS = _classes()


def char_codes(words: list[str]) -> np.ndarray:
    """Words with a mark at each end, one row each, padded with zeros."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("_" + "__".join(words) + "_").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(words)), sizes)
    out = np.zeros((len(words), int(sizes.max(initial=2))), np.int32)
    out[row, np.arange(len(points)) - np.repeat(ends - sizes, sizes)] = _CLASS[points]
    return out


def subsequences(codes: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, subsequence codes, presence) for every start and every pattern of gaps, one value a word."""
    wide = codes.shape[1]
    for offsets, weight in zip(_OFFSETS, _WEIGHTS, strict=True):
        for start in range(wide - offsets[-1]):
            cols = [codes[:, start + o] for o in offsets]
            key = cols[0]
            for c in cols[1:]:
                key = key * _CLASSES + c
            yield weight, key, cols[-1] > 0


def scale(lengths: np.ndarray) -> np.ndarray:
    """1 / norm of the subsequence weights of words so long, each occurrence by itself."""
    total = np.zeros(len(lengths))
    for offsets, weight in zip(_OFFSETS, _WEIGHTS, strict=True):
        total += weight * weight * np.maximum(lengths - offsets[-1], 0)
    return 1.0 / np.sqrt(np.maximum(total, 1e-9))


class LandmarkKernel:
    """Kernel of words against landmarks, each word scaled by its own number of subsequences.

    ``k(w, l) = g(w) g(l) sum over common subsequences of weight * weight``; scaling
    a kernel gives a kernel. Words that share nothing with any landmark have zeros.
    """

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        codes = char_codes(landmarks)
        features: dict[int, dict[int, float]] = {}
        for weight, keys, there in subsequences(codes):
            for at in np.flatnonzero(there):
                row = features.setdefault(int(keys[at]), {})
                row[at] = row.get(at, 0.0) + weight
        self.keys = np.array(sorted(features), np.int64)
        self.rows = np.zeros((len(features), len(landmarks)))
        for place, key in enumerate(self.keys.tolist()):
            for at, value in features[key].items():
                self.rows[place, at] = value
        self.rows *= scale((codes > 0).sum(axis=1))[None, :]

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.vstack([values for _, values in self.portions(words)])

    def portions(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, kernel) of some words at a time; of the table of subsequences only the pages in use take memory."""
        place = np.zeros(_CLASSES**ORDER, np.int32)
        place[self.keys] = np.arange(1, len(self.keys) + 1)
        for lo in range(0, len(words), _PORTION):
            codes = char_codes(words[lo : lo + _PORTION])
            out = np.zeros((len(codes), len(self.landmarks)))
            for weight, keys, there in subsequences(codes):
                found = place[keys]
                hit = np.flatnonzero((found > 0) & there)
                if len(hit):
                    out[hit] += weight * self.rows[found[hit] - 1]
            yield lo, out * scale((codes > 0).sum(axis=1))[:, None]


@dataclass
class WordModel:
    """A direction in the space of subsequences, spanned by the landmarks, and a calibration of texts.

    ``decide`` is the machine's decision for words; ``text_weights`` turn the three
    highest decisions of a text into a log-odds.
    """

    keys: np.ndarray
    values: np.ndarray
    bias: float
    text_weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def decide(self, words: list[str]) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(_CLASSES**ORDER, np.float32)
            self._table[self.keys] = self.values
        codes = char_codes(words)
        total = np.zeros(len(words))
        for weight, keys, there in subsequences(codes):
            total += weight * np.where(there, self._table[keys], 0.0)
        return total * scale((codes > 0).sum(axis=1)) + self.bias


def gram_of(words: list[str], block: int = 64) -> np.ndarray:
    """Kernel of words among themselves, some columns at a time: few words need few subsequences."""
    return np.hstack([LandmarkKernel(words[lo : lo + block])(words) for lo in range(0, len(words), block)])


def farthest(kernel_of, words: list[str], n: int) -> list[str]:
    """Landmarks chosen one after another, each least like those chosen before."""
    if len(words) <= n:
        return words
    gram = kernel_of(words)
    chosen = [0]
    near = gram[:, 0].copy()
    while len(chosen) < n:
        nxt = int(near.argmin())
        if nxt in chosen:
            break
        chosen.append(nxt)
        near = np.maximum(near, gram[:, nxt])
    return [words[i] for i in chosen]


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate ascent; ``cost`` bounds each row's multiplier."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    norm = (x1 * x1).sum(axis=1)
    alpha, w = np.zeros(len(x1)), np.zeros(x1.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x1)):
            step = (1.0 - y[i] * (x1[i] @ w)) / norm[i]
            new = min(max(alpha[i] + step, 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x1[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit_words(insults: list[str], plain: list[str], n_landmarks: int = 256) -> WordModel:
    """Fit on words: Nystroem features from landmarks among the insults and the plain words most like them."""
    if not insults:
        return WordModel(np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros(4))
    insults, plain = sorted(insults), sorted(plain)
    pool = insults[:: max(1, len(insults) // 600)]
    marks = farthest(gram_of, pool, n_landmarks // 2)
    likeness = np.zeros(len(plain))
    for lo, values in LandmarkKernel(marks).portions(plain):
        likeness[lo : lo + len(values)] = values.max(axis=1)
    hard = [plain[i] for i in np.argsort(-likeness, kind="stable")[:3000]]
    easy = plain[:: max(1, len(plain) // 1000)]
    kernel = LandmarkKernel(marks + hard[: n_landmarks // 2])
    gram = kernel(kernel.landmarks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))
    negatives = sorted(set(hard) | set(easy))
    x = kernel(insults + negatives) @ root
    y = np.concatenate([np.ones(len(insults)), -np.ones(len(negatives))])
    w, bias = train_svm(x, y, np.where(y > 0, 10.0, 10.0))
    return WordModel(kernel.keys, kernel.rows @ (root @ w), bias, np.zeros(4))


def portions(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and UTF-8 texts of about ``size`` bytes at a time."""
    rows, held, total = [], [], 0
    for row, text in enumerate(raw_texts(texts)):
        rows.append(row)
        held.append(text)
        total += len(held[-1])
        if total >= size:
            yield rows, held
            rows, held, total = [], [], 0
    if rows:
        yield rows, held


def fit_texts(top: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of the label on the three highest decisions, by Newton steps, without negative weights."""
    x = np.hstack([np.clip(top, -2, 2), np.ones((len(top), 1))])
    used = np.ones(4, bool)
    while True:
        w = np.zeros(4)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (p - label)) + ridge * w
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
            step = np.zeros(4)
            step[used] = np.linalg.solve(bend[np.ix_(used, used)], slope[used])
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if (w[:3] >= 0).all():
            return w
        used[int(w[:3].argmin())] = False


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def _plain(word: bytes) -> str:
    """Lower case without the symbols around the word."""
    return word.decode("utf-8", "replace").lower().strip("#*$%&|<>.,;:!?\"'()[]-_")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, label, text digest and four least hashes of three-word spans, equal for most near copies."""
    rolling = Rolling()
    for batch in batches:
        found = []
        for text in batch.column(1):
            codes = Words(pa.array([text.as_py()], pa.string()), rolling).codes
            spans = rolling.windows(rolling.sums(codes), 3)
            spans = spans if len(spans) else np.append(codes, np.uint64(0))[:1]
            found.append([int((spans * np.uint64(m)).min() >> np.uint64(1)) for m in (3, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *[pa.array([f[k] for f in found], pa.int64()) for k in range(4)]],
            names=["id", "label", *[f"s{k}" for k in range(4)]],
        )


def _neighbourhoods(text: bytes) -> Iterator[set[tuple[str, str, str]]]:
    """Distinct (left, word, right) of a text, a span of its words at a time."""
    words = text.split()
    for lo in range(0, len(words), _SPAN_WORDS):
        part = [_plain(w) for w in words[max(lo - 1, 0) : lo + _SPAN_WORDS + 1]]
        part = part if lo else ["", *part]
        part = part if lo + _SPAN_WORDS < len(words) else [*part, ""]
        yield set(zip(part, part[1:], part[2:], strict=False))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, neighbours) of each distinct word in its neighbourhood, per span of a text.

    Rows leave in batches of bounded size, however many texts a task gets and however long they are.
    """
    words: list[str] = []
    labels: list[int] = []
    around: list[str] = []

    def held() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(around, pa.string())],
            names=["word", "label", "around"],
        )
        words.clear()
        labels.clear()
        around.clear()
        return out

    for batch in batches:
        for text, label in zip(raw_texts(batch.column(0)), batch.column(1), strict=True):
            for seen in _neighbourhoods(text):
                for left, w, right in seen:
                    if 3 <= len(w) <= _LONGEST:
                        words.append(w)
                        labels.append(label.as_py())
                        around.append(f"{left} {right}")
                if len(words) >= _SPAN_WORDS:
                    yield held()
    yield held()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 3000,
    most_words: int = 1500,
    plain_words: int = 30_000,
) -> WordModel:
    """Learn which words make labelled texts toxic, from rows that are not held out.

    At most ``per_class`` texts of each label are used, the first by a hash of
    their text, equal texts once. A word's evidence is the number of distinct
    neighbourhoods it stands in, so that copies of a text count once. Stems (the first
    4, 5 or 6 characters, and the word) that toxic texts hold far more often than
    clean ones mark a word as an insult; at most ``most_words`` insults and
    ``plain_words`` clean words, chosen by hash, come to the driver. The machine is
    then trained on these words, so unseen inflections and words with inserted
    characters score by their common subsequences.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    sketched = rows.join(small_side(marks), "id").select("id", "text", "label").mapInArrow(
        _sketches, f"id {kind}, label int, " + ", ".join(f"s{k} bigint" for k in range(4))
    )
    chosen = stage(sketched, "train-sketches")
    for k in range(4):
        chosen = chosen.groupBy(f"s{k}", "label").agg(F.min_by(F.struct(*chosen.columns), "id").alias("r")).select("r.*")
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [chosen.where(F.col("label") == k).orderBy("s0", "id").limit(per_class) for k in (0, 1)]
    chosen = stage(first[0].unionByName(first[1]).select("id", "label"), "train-ids")
    sample = stage(rows.join(F.broadcast(chosen), "id").select("text", "label"), "train-texts")
    found = sample.mapInArrow(_contexts, "word string, label int, around string").distinct()
    words = stage(found.groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    ), "word-evidence")
    totals = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not totals["t"]:
        return fit_words([], [])
    stems = F.array_distinct(F.array(*[F.substring("word", 1, k) for k in STEMS], F.concat(F.lit("="), "word")))
    by_stem = words.select(F.explode(stems).alias("stem"), "toxic", "clean", "word")
    by_stem = by_stem.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (totals["t"] + 1)) / ((F.col("clean") + 0.5) / ((totals["c"] or 0) + 1))
    share = totals["t"] / (totals["t"] + (totals["c"] or 0) + 1.0)
    n = F.col("toxic") + F.col("clean")
    likely = 2 * (
        F.col("toxic") * F.log(F.greatest(F.col("toxic"), F.lit(0.5)) / (n * share))
        + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(0.5)) / (n * (1 - share)))
    )
    strong = by_stem.withColumn("ratio", ratio).where((F.col("ratio") >= 8) & (likely >= 20)).select("stem", "ratio")
    strong = stage(strong, "toxic-stems")
    insults = (
        words.where("toxic > clean")
        .select("word", "toxic", F.explode(stems).alias("stem"))
        .join(strong, "stem")
        .groupBy("word")
        .agg(F.max("ratio").alias("ratio"), F.max("toxic").alias("toxic"))
        .orderBy(F.desc("ratio"), F.desc("toxic"), "word")
        .limit(most_words)
    )
    bad = [r["word"] for r in insults.collect()]
    known = set(bad)
    plain = words.where("clean > 0 AND clean >= toxic").orderBy(F.xxhash64("word"), "word").limit(plain_words)
    model = fit_words(bad, [r["word"] for r in plain.select("word").collect() if r["word"] not in known])
    if not len(model.keys):
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = sample.mapInArrow(_tops(shared), "label int, top1 double, top2 double, top3 double").collect()
    label = np.array([r["label"] for r in found], float)
    top = np.array([[r["top1"], r["top2"], r["top3"]] for r in found])
    weight = np.where(label > 0, sizes.get(1, 0) / max(1, label.sum()), sizes.get(0, 0) / max(1, (1 - label).sum()))
    model.text_weights = fit_texts(top, label, weight)
    return model


def _reader(model: WordModel):
    """Function from a column of texts to the three highest word decisions of each."""
    kept: dict[bytes, float] = {}

    def read(column: pa.Array) -> np.ndarray:
        nonlocal kept
        tops = np.full((len(column), 3), _LEAST)
        for rows, texts in portions(column):
            words = [t.split() for t in texts]
            new = {w for ws in words for w in ws if w not in kept}
            if len(kept) + len(new) > _ENTRIES:
                kept, new = {}, {w for ws in words for w in ws}
            kept.update(decided(model, sorted(new)))
            for row, ws in zip(rows, words, strict=True):
                found = np.fromiter(map(kept.__getitem__, ws), np.float64, len(ws))
                found = np.sort(found if len(found) < 4 else np.partition(found, -3)[-3:])[::-1]
                tops[row, : len(found)] = found
        return tops

    return read


def _scorer(model: WordModel):
    """Function from a column of texts to their scores."""
    read = _reader(model)

    def score(column: pa.Array) -> np.ndarray:
        if not len(model.keys):
            return np.zeros(len(column))
        z = np.clip(read(column), -2, 2) @ model.text_weights[:-1] + model.text_weights[-1]
        return np.round(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), 9)

    return score


def _tops(shared):
    """Task that gives the three highest word decisions of each text beside its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(shared.value)
        for batch in batches:
            tops = read(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(tops[:, k]) for k in range(3)]], names=["label", "top1", "top2", "top3"]
            )

    return run


def decided(model: WordModel, words: list[bytes]) -> dict[bytes, float]:
    """Decision per word; a word of more than 40 characters has that of its worst piece."""
    parts: dict[bytes, list[str]] = {}
    for w in words:
        p = _plain(w)
        if len(p) >= 3:
            parts[w] = [p] if len(p) <= _LONGEST else [p[i : i + _LONGEST] for i in range(0, len(p), _LONGEST // 2)]
    flat = sorted({p for ps in parts.values() for p in ps}, key=len)
    value: dict[str, float] = {}
    if len(model.keys):
        for lo in range(0, len(flat), 2048):
            value.update(zip(flat[lo : lo + 2048], model.decide(flat[lo : lo + 2048]).tolist(), strict=True))
    return {w: max([value.get(p, _LEAST) for p in parts.get(w, [""])]) for w in words}


def score(
    docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``.

    Every word of the whole text is decided; the text's score comes from its three
    highest decisions, so long texts are not diluted. Null and empty texts get the
    score of a text without insults. Equal texts get equal scores. A map over Arrow
    batches: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], names=["id", "score"])

    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labelled rows that are not held out and score every row; without toxic labels all score 0."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)


def kept_by_score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3
) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``cut``; equal texts fare alike."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at).fill_null("")) < cut))

    return docs.mapInArrow(run, schema)
