"""Embedding and index tables (I-11, I-12, I-13, I-16)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.relational import small_side, stage
from codicil.functions.text import tokens, with_term_counts

DIM = 64


# --- sparse ---------------------------------------------------------------

@dataclass
class TextIndex:
    """Inverted index: ``postings`` (jurisdiction, chunk_id, dl, term, tf),
    ``terms`` (jurisdiction, term, df) and ``stats`` (jurisdiction, n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int = 0


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(jurisdiction, chunk_id, dl, counts) per chunk, without a shuffle.

    Unnest ``counts`` with the outer generators: for the inner ones Spark infers
    a not-empty filter and evaluates the whole array expression again in it.
    """
    df = chunks.select("jurisdiction", "chunk_id", tokens("text").alias("toks"))
    return with_term_counts(df).select(
        "jurisdiction", "chunk_id", F.size("toks").cast("bigint").alias("dl"), "counts"
    )


def build_index(chunks: DataFrame, stop: DataFrame | None = None) -> TextIndex:
    """I-12. Index tables of a chunk table.

    Postings are counted inside each chunk's row; only document frequencies are
    aggregated, with partial sums before the shuffle. ``stop`` (jurisdiction,
    term) is removed before anything is counted.
    """
    counts = chunk_counts(chunks)
    postings = counts.select("jurisdiction", "chunk_id", "dl", F.inline_outer("counts")).where(
        F.col("term").isNotNull()
    )
    stats = counts.groupBy("jurisdiction").agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl")
    )
    if stop is not None:
        postings = drop_stopwords(postings, stop)
        lengths = postings.groupBy("jurisdiction").agg(F.sum("tf").alias("total"))
        stats = (
            stats.drop("avgdl")
            .join(lengths, "jurisdiction", "left")
            .select("jurisdiction", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))
        )
    terms = postings.groupBy("jurisdiction", "term").agg(F.count("*").alias("df"))
    return TextIndex(postings, terms, stats)


def write_index(index: TextIndex, path: str, buckets: int = 64) -> None:
    """Store an index. Postings lie in term buckets so that a query reads only its own;
    the rebalance hint splits buckets that a frequent term makes large.

    Document frequencies are counted from the stored postings, so the texts are not
    cut into terms once more for them."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    postings = index.postings.withColumn("term_bucket", bucket)
    postings.hint("rebalance", "term_bucket").write.partitionBy("term_bucket").parquet(f"{path}/postings")
    held = postings.sparkSession.read.schema(postings.schema).parquet(f"{path}/postings")
    terms = held.groupBy("jurisdiction", "term", "term_bucket").agg(F.count("*").alias("df"))
    terms.hint("rebalance", "term_bucket").write.partitionBy("term_bucket").parquet(f"{path}/terms")
    index.stats.write.parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str, buckets: int = 64) -> TextIndex:
    return TextIndex(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/stats"),
        buckets,
    )


def drop_stopwords(terms: DataFrame, stop: DataFrame) -> DataFrame:
    """I-16. Remove the stop words of each jurisdiction."""
    return terms.join(small_side(stop), ["jurisdiction", "term"], "left_anti")


def frequent_terms(terms: DataFrame, stats: DataFrame, share: float) -> DataFrame:
    """Stop-word candidates: terms held by at least ``share`` of a jurisdiction's chunks."""
    return (
        terms.join(small_side(stage(stats, "stats")), "jurisdiction")
        .where(F.col("df") >= share * F.col("n"))
        .select("jurisdiction", "term")
    )


# --- dense ----------------------------------------------------------------

def token_slots(toks: Column, dim: int = DIM) -> Column:
    """Slot of each token: first seven hex digits of its MD5, modulo ``dim``."""
    return F.transform(
        toks,
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int"), F.lit(dim)),
    )


def hashed_terms(dim: int = DIM) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Default embedder: unit vector of hashed term counts.

    A lexical stand-in for a hosted model; it claims no retrieval quality.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for slots in batches:
            out = []
            for s in slots:
                v = np.bincount(np.asarray(s, dtype=np.int64), minlength=dim).astype(np.float64)
                norm = np.sqrt(np.dot(v, v))
                out.append(v / norm if norm > 0 else v)
            yield pd.Series(out)

    return run


def embed(df: DataFrame, embedder: Callable | None = None, column: str = "text", dim: int = DIM) -> DataFrame:
    """I-11. Add ``embedding`` in Arrow batches.

    ``embedder`` maps an iterator of text batches to vector batches, so a model
    is loaded once per task. Without one, token slots are computed in the JVM
    and only the small integer arrays reach Python.
    """
    if embedder is None:
        scorer = F.pandas_udf(_typed(hashed_terms(dim)), "array<double>")
        return (
            df.withColumn("__toks", tokens(column))
            .withColumn("embedding", scorer(token_slots(F.col("__toks"), dim)))
            .drop("__toks")
        )
    return df.withColumn("embedding", F.pandas_udf(_typed(embedder), "array<double>")(F.col(column)))


def _typed(fn: Callable) -> Callable:
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from fn(batches)

    return call


def build_vector_index(chunks: DataFrame, cells: int = 16, seed: int = 7, train_rows: int = 500_000):
    """I-13. Assign each chunk a k-means cell; returns (index, centroids).

    Only the centroids are learned from about ``train_rows`` chunks, staged since
    k-means reads them repeatedly; every chunk is assigned to a cell.
    ``centroids`` is a (cell, centroid) table of ``cells`` rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    featured = chunks.select("*", vector)
    share = min(1.0, train_rows / max(1, chunks.count()))
    train = stage(chunks.select("embedding").sample(share, seed), "train").select(vector)
    model = KMeans(k=cells, seed=seed, maxIter=5, predictionCol="cell").fit(train)
    index = model.transform(featured).drop("features")
    centroids = chunks.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell int, centroid array<double>",
    )
    return index, centroids


def assign_cells(chunks: DataFrame, centroids: DataFrame) -> DataFrame:
    """I-13. Chunks with the ``cell`` of the nearest centroid by cosine, ties to the lower cell; no shuffle.

    ``centroids`` (cell, centroid) is as small as the number of cells asked for.
    """
    known = sorted((r["cell"], r["centroid"]) for r in centroids.select("cell", "centroid").collect())
    cells, spots = np.array([c for c, _ in known]), np.array([v for _, v in known], dtype=np.float64)
    spots = spots / np.maximum(np.linalg.norm(spots, axis=1, keepdims=True), 1e-300)
    shipped = chunks.sparkSession.sparkContext.broadcast((cells, spots))

    def nearest_cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, at = shipped.value
        for vectors in batches:
            if len(vectors) == 0:
                yield pd.Series([], dtype="int32")
                continue
            rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            yield pd.Series(names[np.argmax(np.round(rows @ at.T, 6), axis=1)].astype("int32"))

    return chunks.withColumn("cell", F.pandas_udf(_typed(nearest_cell), "int")("embedding"))


def write_vector_index(index: DataFrame, path: str) -> None:
    """Store an index in one folder a cell, so that a search reads the cells it probes only; crowded cells are split."""
    index.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
