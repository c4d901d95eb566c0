"""Hybrid retrieval (R-01 .. R-14) for many questions in one job.

Shapes: chunks (chunk_id, jurisdiction, text, ...), queries (query_id,
jurisdiction, text), ranked lists (query_id, chunk_id, score, rank).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import best_first, fresh_path, join_hot, small_side, stage, top_k
from codicil.functions.text import bigrams, share_in, tokens
from codicil.operators.indexing import TextIndex, chunk_counts, embed

K1, B, RRF_K = 1.2, 0.75, 60
POOL, KEEP = 50, 10
#: Pairs of a question's term and a posting that one task scores; their sums are held in memory.
PAIRS_A_TASK = 2_000_000


# --- scope ----------------------------------------------------------------

def scope_filter(
    chunks: DataFrame,
    as_of: dt.date | None = None,
    jurisdictions: list[str] | None = None,
    doc_types: list[str] | None = None,
    min_authority: int | None = None,
    include_status: tuple[str, ...] = (),
    tenant_id: str | None = None,
) -> DataFrame:
    """R-01, R-11. Hard filter that must precede every ranking.

    Plain predicates, so partitions are pruned and the rest reaches the scan.
    ``include_status`` widens the default in-force rule; widened rows keep their
    ``status`` for disclosure. A scope over a column that the table lacks is an
    error, never a wider result.
    """
    wanted = {
        "effective_from": as_of, "effective_to": as_of, "jurisdiction": jurisdictions, "doc_type": doc_types,
        "authority_level": min_authority, "tenant_id": tenant_id,
    }
    missing = [c for c, v in wanted.items() if v is not None and c not in chunks.columns]
    if missing:
        raise ValueError(f"scope over columns that the table lacks: {', '.join(missing)}")
    df = chunks.where(F.col("status").isin("in_force", *include_status))
    if as_of is not None:
        d = F.lit(as_of)
        df = df.where(F.col("effective_from") <= d)
        df = df.where(F.col("effective_to").isNull() | (d < F.col("effective_to")))
    if jurisdictions is not None:
        df = df.where(F.col("jurisdiction").isin(*jurisdictions))
    if doc_types is not None:
        df = df.where(F.col("doc_type").isin(*doc_types))
    if min_authority is not None:
        df = df.where(F.col("authority_level") >= min_authority)
    if tenant_id is not None:
        df = df.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant_id))
    return df


def one_version(chunks: DataFrame) -> DataFrame:
    """R-10. All chunks of the newest version of each section; chunks of no Act or section have no versions and stay.

    Versions are compared on narrow columns with partial aggregates, so texts move
    only where the sections held are too many to broadcast.
    """
    key = ["jurisdiction", "act", "section_no"]
    cited = F.col("act").isNotNull() & F.col("section_no").isNotNull()
    version = F.struct("effective_from", "version")
    newest = chunks.where(cited).groupBy(*key).agg(F.max(version).alias("newest"))
    held = chunks.join(small_side(stage(newest, "versions")), key, "left")
    return held.where(F.col("newest").isNull() | (version == F.col("newest"))).select(*chunks.columns)


# --- sparse leg -----------------------------------------------------------

def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id", "jurisdiction", F.explode_outer(F.array_distinct(tokens("text"))).alias("term")
    ).where(F.col("term").isNotNull())


def _bm25_score(
    hits: DataFrame, wanted: DataFrame, df: DataFrame, stats: DataFrame, k: int, k1: float, b: float
) -> DataFrame:
    """Best ``k`` chunks per question.

    Weights of checked size meet the postings dealt by chunk, so a chunk's score is
    whole in its task and each task sends on at most ``k`` chunks a question. The
    document frequencies give the number of pairs, and that the number of tasks.
    """
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damp = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    weighted = (
        wanted.join(df, ["jurisdiction", "term"])
        .join(stats, "jurisdiction")
        .select("query_id", "jurisdiction", "term", "avgdl", idf.alias("idf"), "df")
    )
    weighted = stage(weighted, "weights")
    weights = weighted.drop("df")
    shipped, on = small_side(weights), ["jurisdiction", "term"]
    if shipped is not weights:
        pairs = weighted.agg(F.sum("df")).first()[0] or 0
        tasks = max(hits.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
        met = hits.repartition(tasks, "chunk_id").join(shipped, on)
    else:
        met = join_hot(hits, weights, on, "chunk_id")
    scored = (
        met
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / damp), 6).alias("score"))
    )
    return top_k(scored, ["query_id"], best_first(), k)


def bm25(
    chunks: DataFrame, queries: DataFrame, k: int = POOL, k1: float = K1, b: float = B
) -> DataFrame:
    """R-02. BM25 straight from a chunk table, top ``k`` per query.

    One pass over the text: postings outside the queries' vocabulary are dropped
    in the scan's own stage, and a marker row per chunk carries its length, so
    corpus statistics, document frequencies and scores all come from the small
    staged table. Statistics stay inside a jurisdiction.
    """
    wanted = query_terms(queries)
    vocab = wanted.select("jurisdiction", "term").distinct().withColumn("asked", F.lit(True))
    marker = F.concat(F.lit("\x00"), F.col("chunk_id").cast("string"))
    posted = chunk_counts(chunks).select(
        "jurisdiction",
        "chunk_id",
        "dl",
        F.inline_outer(F.concat(F.array(F.struct(marker.alias("term"), F.lit(0).cast("bigint").alias("tf"))), "counts")),
    )
    hits = stage(
        join_hot(posted, vocab, ["jurisdiction", "term"], "chunk_id", "left")
        .where(F.col("asked") | (F.col("tf") == 0))
        .drop("asked"),
        "postings",
    )
    df = hits.where("tf > 0").groupBy("jurisdiction", "term").agg(F.count("*").alias("df"))
    stats = hits.where("tf = 0").groupBy("jurisdiction").agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl")
    )
    return _bm25_score(hits.where("tf > 0"), wanted, df, stats, k, k1, b)


def bm25_from_index(
    index: TextIndex, queries: DataFrame, k: int = POOL, k1: float = K1, b: float = B
) -> DataFrame:
    """R-02 over a stored index (I-12); bucket pruning keeps the read to asked terms."""
    wanted = query_terms(queries)
    postings, terms = index.postings, index.terms
    if index.buckets:
        mine = F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int")
        asked = [r[0] for r in wanted.select(mine).distinct().collect()]
        postings = postings.where(F.col("term_bucket").isin(*asked)).drop("term_bucket")
        terms = terms.where(F.col("term_bucket").isin(*asked)).drop("term_bucket")
    return _bm25_score(postings, wanted, terms, index.stats, k, k1, b)


# --- dense leg ------------------------------------------------------------

QUESTIONS_A_ROUND = 4096


def _best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best by (score desc, id asc)."""
    if len(ids) > k:
        floor = np.partition(sims, len(sims) - k)[len(sims) - k]
        near = sims >= floor
        sims, ids = sims[near], ids[near]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


class _Shortlist:
    """Running best ``k`` chunks of each query: bounded by queries x k."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, qids: np.ndarray, qvecs: np.ndarray, ids: np.ndarray, vecs: np.ndarray, block: int = 256) -> None:
        for at in range(0, len(qids), block):
            self._add(qids[at : at + block], qvecs[at : at + block], ids, vecs)

    def _add(self, qids: np.ndarray, qvecs: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        sims = np.round(qvecs @ vecs.T, 6) + 0.0
        for row, q in enumerate(qids):
            new_ids, new_sims = _best_of(sims[row], ids, self.k)
            if q in self.held:
                old_ids, old_sims = self.held[q]
                new_ids, new_sims = np.concatenate([old_ids, new_ids]), np.concatenate([old_sims, new_sims])
                new_ids, new_sims = _best_of(new_sims, new_ids, self.k)
            self.held[q] = (new_ids, new_sims)

    def frame(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        return pd.DataFrame(
            {
                "query_id": np.repeat(list(self.held), [len(i) for i, _ in self.held.values()]),
                "chunk_id": np.concatenate([i for i, _ in self.held.values()]),
                "score": np.concatenate([s for _, s in self.held.values()]),
            }
        )



def _ids(column: pd.Series) -> np.ndarray:
    """Ids as a plain array, numbers or texts, so that they can be ordered."""
    return np.asarray(column.tolist())


def _ranked_type(corpus: DataFrame, asked: DataFrame) -> str:
    query, chunk = (df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (corpus, "chunk_id")))
    return f"query_id {query}, chunk_id {chunk}, score double"


def nearest(chunks: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """Top ``k`` cosine neighbours among the chunks that share ``key`` with the query.

    Questions go round by round to a corpus that stays in place: each round ships a
    bounded block of questions to the tasks, which score Arrow batches as matrix
    products and return at most ``k`` rows per question. No vector of the corpus is
    shuffled, whatever the number of questions. ``queries`` may name one query
    under several keys; all of them travel in one round.
    """
    corpus = chunks.select(F.col(key).cast("string").alias("key"), "chunk_id", "embedding")
    asked = queries.select(F.col(key).cast("string").alias("key"), "query_id", "embedding")
    shape = _ranked_type(corpus, asked)

    def answered(rows: list) -> DataFrame:
        return top_k(_nearest_shipped(corpus, rows, k, shape), ["query_id"], best_first(), k)

    rows = asked.limit(QUESTIONS_A_ROUND + 1).collect()
    if len(rows) <= QUESTIONS_A_ROUND:
        return answered(rows)
    rounds = -(-2 * asked.count() // QUESTIONS_A_ROUND)
    block = F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int").alias("block")
    blocks, path = stage(asked.select("*", block), "questions", by="block"), fresh_path(corpus.sparkSession, "rounds")
    for n in range(rounds):
        rows = blocks.where(F.col("block") == n).drop("block").collect()
        answered(rows).write.mode("append").parquet(path)
    return corpus.sparkSession.read.schema(f"{shape}, rank int").parquet(path)


def _nearest_shipped(corpus: DataFrame, rows: list, k: int, shape: str) -> DataFrame:
    by_key: dict[str, tuple] = {}
    for name in {r["key"] for r in rows}:
        mine = [r for r in rows if r["key"] == name]
        by_key[name] = (np.array([r["query_id"] for r in mine]), _unit([r["embedding"] for r in mine]))
    corpus = corpus.where(F.col("key").isin(*by_key))
    shipped = corpus.sparkSession.sparkContext.broadcast(by_key)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Shortlist(k)
        for pdf in batches:
            for name, part in pdf.groupby("key"):
                qids, qvecs = shipped.value[name]
                best.add(qids, qvecs, _ids(part["chunk_id"]), _unit(part["embedding"]))
        yield best.frame()

    return corpus.mapInPandas(score, shape)


def dense_exact(chunks: DataFrame, queries: DataFrame, k: int = POOL) -> DataFrame:
    """R-03. Exact cosine top ``k`` inside the query's jurisdiction."""
    return nearest(chunks, queries, "jurisdiction", k)


def dense_ann(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = POOL, probes: int = 4) -> DataFrame:
    """R-04. Approximate cosine: score only the ``probes`` cells nearest to the query.

    The cells are found by the exact search, over centroids. Cells are scanned
    row-parallel, so a crowded cell is only more batches.
    """
    spots = centroids.select(F.lit("*").alias("any"), F.col("cell").cast("bigint").alias("chunk_id"), F.col("centroid").alias("embedding"))
    asked = queries.withColumn("any", F.lit("*"))
    near = nearest(spots, asked, "any", probes).select("query_id", F.col("chunk_id").cast("int").alias("cell"))
    return nearest(index, queries.select("query_id", "embedding").join(near, "query_id"), "cell", k)


def overlap_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of each query's exact neighbours that an approximate list holds."""
    hit = found.select("query_id", "chunk_id").withColumn("hit", F.lit(1))
    return (
        exact.join(hit, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    )


def recall_by_probes(
    chunks: DataFrame, index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = POOL, least: float = 1.0
) -> DataFrame:
    """Mean recall against the exact search for 1, 2, 4, ... probed cells: (probes, recall).

    Stops at the first number of cells that reaches ``least``, or at all of them, which is exact.
    """
    spark, cells = queries.sparkSession, centroids.count()
    queries = stage(queries, "recall-questions")
    exact, out, probes = stage(dense_exact(chunks, queries, k), "recall-exact"), [], 1
    while True:
        found = dense_ann(index, centroids, queries, k, min(probes, cells))
        out.append((min(probes, cells), overlap_recall(exact, found).agg(F.round(F.avg("recall"), 6)).first()[0]))
        if probes >= cells or (out[-1][1] or 0.0) >= least:
            return spark.createDataFrame(out, "probes int, recall double")
        probes *= 2


def enough_probes(recalls: DataFrame, least: float = 0.9) -> int:
    """Least number of probed cells whose measured recall reaches ``least``; all that were tried if none does."""
    reached = recalls.where(F.col("recall") >= least).agg(F.min("probes")).first()[0]
    return reached or recalls.agg(F.max("probes")).first()[0]


# --- fusion, boosts, rerank -----------------------------------------------

def rrf(lists: list[DataFrame], k: int = RRF_K, pool: int = POOL) -> DataFrame:
    """R-05. Reciprocal rank fusion of any number of ranked lists; the best ``pool`` per question."""
    pooled = lists[0].select("query_id", "chunk_id", "rank")
    for other in lists[1:]:
        pooled = pooled.unionByName(other.select("query_id", "chunk_id", "rank"))
    fused = pooled.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score")
    )
    return top_k(fused, ["query_id"], best_first(), pool)


def boost(cands: DataFrame, weights: dict[str, tuple[Column, float]], pool: int = POOL) -> DataFrame:
    """R-06. Soft boosts after fusion: multiply by (1 + weight) per rule that holds; the best ``pool`` stay."""
    factor = F.lit(1.0)
    for cond, weight in weights.values():
        factor = factor * F.when(cond, F.lit(1.0 + weight)).otherwise(F.lit(1.0))
    boosted = cands.drop("rank").withColumn("score", F.round(F.col("score") * factor, 6))
    return top_k(boosted, ["query_id"], best_first(), pool)


def lexical_relevance() -> Column:
    """Default rerank score in [0,1] over q_toks, q_grams, c_toks, c_grams, h_toks.

    Query-term, query-bigram and heading shares: a lexical stand-in for a model.
    """
    return F.round(
        0.6 * share_in(F.col("q_toks"), F.col("c_toks"))
        + 0.2 * share_in(F.col("q_grams"), F.col("c_grams"))
        + 0.2 * share_in(F.col("q_toks"), F.col("h_toks")),
        6,
    )


def rerank(
    cands: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    scorer: Column | None = None,
    take: int = POOL,
    keep: int = KEEP,
) -> DataFrame:
    """R-07, R-13. Rescore the first ``take`` candidates and number the best ``keep``.

    At most ``take`` rows per query meet the chunk texts, so the candidate side
    is the small one and the corpus is scanned in place; a chunk that many
    queries picked is tokenized once. ``scorer`` is any column over the prepared
    token columns, a pandas UDF included.
    """
    if not 8 <= keep <= 12:
        raise ValueError("keep must be within 8..12")
    asked = queries.select("query_id", tokens("text").alias("q_toks")).withColumn("q_grams", bigrams(F.col("q_toks")))
    picked = cands.where(F.col("rank") <= take).select("query_id", "chunk_id", F.col("rank").alias("fused_rank"))
    wanted = small_side(picked.select("chunk_id").distinct())
    words = (
        chunks.join(wanted, "chunk_id", "left_semi")
        .select("chunk_id", tokens("text").alias("c_toks"), tokens("heading").alias("h_toks"))
        .withColumn("c_grams", bigrams(F.col("c_toks")))
    )
    paired = words.join(small_side(picked), "chunk_id").join(small_side(asked), "query_id")
    scored = paired.withColumn("score", lexical_relevance() if scorer is None else scorer)
    order = [F.col("score").desc(), F.col("fused_rank").asc(), F.col("chunk_id").asc()]
    return top_k(scored.select("query_id", "chunk_id", "fused_rank", "score"), ["query_id"], order, keep, "excerpt_no")


def number_excerpts(cands: DataFrame, max_excerpts: int = 12) -> DataFrame:
    """R-13. Excerpt numbers [n] per query, by final rank, up to the excerpt budget."""
    return top_k(cands, ["query_id"], [F.col("rank").asc(), F.col("chunk_id").asc()], max_excerpts, "excerpt_no")


def calibrate(scored: DataFrame, bins: int = 10) -> DataFrame:
    """R-08. Score bin -> observed relevance over (score, label)."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return (
        scored.groupBy(b.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("score"), 6).alias("mean_score"),
            F.round(F.avg(F.col("label").cast("double")), 6).alias("relevance"),
        )
        .withColumn("gap", F.round(F.col("relevance") - F.col("mean_score"), 6))
    )


def merge_variants(ranked: DataFrame, k: int = POOL) -> DataFrame:
    """R-09. Fold (query_id, variant_no, chunk_id, score) to the best variant per chunk."""
    merged = ranked.groupBy("query_id", "chunk_id").agg(
        F.max("score").alias("score"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col("variant_no").alias("v"))).getField("v").alias("variant_no"),
    )
    return top_k(merged, ["query_id"], best_first(), k)


def retrieve_many(chunks: DataFrame, variants: DataFrame, k: int = POOL) -> DataFrame:
    """R-09. One sparse job for all (query_id, variant_no, jurisdiction, text) rows."""
    keyed = variants.withColumn("vid", F.struct("query_id", "variant_no"))
    flat = keyed.select(F.col("vid").alias("query_id"), "jurisdiction", "text")
    found = bm25(chunks, flat, k)
    return merge_variants(
        found.select("query_id.query_id", "query_id.variant_no", "chunk_id", "score"), k
    )


def lexical_only(dense: DataFrame, queries: DataFrame, modes: dict[str, str]) -> DataFrame:
    """R-14. Drop the dense list of queries whose jurisdiction falls back to lexical."""
    off = [j for j, m in modes.items() if m == "lexical"]
    if not off:
        return dense
    kept = queries.where(~F.col("jurisdiction").isin(*off)).select("query_id")
    return dense.join(small_side(kept), "query_id", "left_semi")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = POOL,
    keep: int = KEEP,
    modes: dict[str, str] | None = None,
    boosts: dict[str, tuple[Column, float]] | None = None,
    scope: dict[str, object] | None = None,
) -> DataFrame:
    """R-10. One plan for all jurisdictions: sparse and dense, fused, boosted, reranked.

    ``scope`` holds the arguments of ``scope_filter``, a date (``as_of``) among them;
    it cuts the corpus before any ranking, so statistics see the scope only, and a
    section enters with one version. Without it ``chunks`` must already be scoped.
    Ranked lists are staged, at most ``k`` rows per query, so each leg reads the
    corpus once.
    """
    if scope is not None:
        chunks = one_version(scope_filter(chunks, **scope))
    sparse = stage(bm25(chunks, queries, k), "sparse")
    vectors = embed(chunks.select("chunk_id", "jurisdiction", "text"))
    dense = stage(dense_exact(vectors, embed(queries), k), "dense")
    if modes:
        dense = lexical_only(dense, queries, modes)
    fused = rrf([sparse, dense], pool=k)
    if boosts:
        facts = chunks.select("chunk_id", "act", "section_no", "authority_level", "doc_type")
        fused = boost(facts.join(small_side(fused), "chunk_id"), boosts, pool=k)
    fused = stage(fused.select("query_id", "chunk_id", "score", "rank"), "fused")
    return rerank(fused, chunks, queries, take=k, keep=keep)


def section_history(versions: DataFrame) -> DataFrame:
    """R-12. Versions of a section side by side, on the narrow key columns.

    A section holds one row per version, so the window group is its history.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("act", "section_no").orderBy("version")
    return versions.select(
        "act",
        "section_no",
        "version",
        "status",
        "effective_from",
        F.lag("version").over(w).alias("prev_version"),
        F.lag("status").over(w).alias("prev_status"),
        F.lead("effective_from").over(w).alias("next_from"),
    )
