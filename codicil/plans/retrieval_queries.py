"""Registered queries for indexing, retrieval and the retrieval metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path, stage
from codicil.functions.text import tokens
from codicil.operators import evaluation as ev
from codicil.operators import indexing as ix
from codicil.operators import retrieval as rt
from codicil.plans.inputs import LV, legal_view, open_chunks, questions, questions_sql, table, tok
from codicil.plans.registry import register, with_

Q_SCOPED, Q_OPEN = questions_sql(True), questions_sql(False)
AS_OF = dt.date(2021, 6, 1)


def scoped_chunks(spark, sf):
    """In-force statutes and regulations of the legal view: R-01 before any ranking."""
    return rt.scope_filter(legal_view(spark, sf), doc_types=["statute", "regulation"])


# SQL building blocks -------------------------------------------------------

CHUNKS_SCOPED = "chunks AS (SELECT * FROM lv WHERE status = 'in_force' AND doc_type IN ('statute', 'regulation'))"
CHUNKS_OPEN = "chunks AS (SELECT * REPLACE ('all' AS jurisdiction) FROM lv)"
POSTINGS = f"""
toked AS (SELECT jurisdiction, chunk_id, {tok('text')} AS toks FROM chunks),
lens AS (SELECT jurisdiction, chunk_id, CAST(len(toks) AS BIGINT) AS dl FROM toked),
post AS (SELECT jurisdiction, chunk_id, term, count(*) AS tf
         FROM (SELECT jurisdiction, chunk_id, unnest(toks) AS term FROM toked) GROUP BY ALL),
terms AS (SELECT jurisdiction, term, count(*) AS df FROM post GROUP BY ALL),
stats AS (SELECT jurisdiction, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY ALL)"""
BM25 = f"""{POSTINGS},
qterms AS (SELECT DISTINCT query_id, jurisdiction, term
           FROM (SELECT query_id, jurisdiction, unnest({tok('text')}) AS term FROM questions)),
bm25_all AS (SELECT q.query_id, p.chunk_id,
    round(sum(ln(1 + (s.n - t.df + 0.5) / (t.df + 0.5)) * p.tf * 2.2
        / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / s.avgdl))), 6) AS score
  FROM qterms q JOIN post p USING (jurisdiction, term) JOIN terms t USING (jurisdiction, term)
  JOIN stats s USING (jurisdiction) JOIN lens l USING (jurisdiction, chunk_id)
  GROUP BY q.query_id, p.chunk_id),
bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM bm25_all)
  WHERE rank <= 50)"""


def vec_sql(name: str, src: str, key: str) -> str:
    """Unit hashed-term vectors as (key, slot, w) rows."""
    return f"""{name}_cnt AS (SELECT {key}, jurisdiction, slot, count(*) AS c FROM
    (SELECT {key}, jurisdiction, CAST(('0x' || substr(md5(t), 1, 7)) AS BIGINT) % 64 AS slot
     FROM (SELECT {key}, jurisdiction, unnest({tok('text')}) AS t FROM {src})) GROUP BY ALL),
{name} AS (SELECT {key}, jurisdiction, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS w FROM {name}_cnt)"""


DENSE = f"""{vec_sql('cvec', 'chunks', 'chunk_id')},
{vec_sql('qvec', 'questions', 'query_id')},
dense_all AS (SELECT q.query_id, c.chunk_id, round(sum(q.w * c.w), 6) AS hit
  FROM qvec q JOIN cvec c USING (jurisdiction, slot) GROUP BY ALL),
dense AS (SELECT * FROM (SELECT q.query_id, c.chunk_id, coalesce(d.hit, 0.0) AS score,
    CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(d.hit, 0.0) DESC, c.chunk_id) AS INT) AS rank
  FROM questions q JOIN chunks c USING (jurisdiction) LEFT JOIN dense_all d
    ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id) WHERE rank <= 50)"""


def rrf_sql(lists: list[str], name: str = "fused") -> str:
    pool = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank FROM {x}" for x in lists)
    return f"""{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({pool}) GROUP BY ALL))
  WHERE rank <= 50)"""


GRAMS = "list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def rerank_sql(cands: str, name: str = "excerpts", keep: int = 10) -> str:
    q, c, h = tok("qs.text"), tok("ch.text"), tok("ch.heading")
    def share(a: str, b: str) -> str:
        return (
            f"CASE WHEN len(list_distinct({a})) > 0 "
            f"THEN len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a})) ELSE 0.0 END"
        )
    return f"""{name}_t AS (SELECT f.query_id, f.chunk_id, f.rank AS fused_rank, {q} AS qt, {c} AS ct, {h} AS ht
  FROM {cands} f JOIN questions qs ON qs.query_id = f.query_id JOIN chunks ch ON ch.chunk_id = f.chunk_id),
{name}_g AS (SELECT *, {GRAMS.format(t='qt')} AS qg, {GRAMS.format(t='ct')} AS cg FROM {name}_t),
{name}_s AS (SELECT query_id, chunk_id, fused_rank,
   round(0.6 * {share('qt', 'ct')} + 0.2 * {share('qg', 'cg')} + 0.2 * {share('qt', 'ht')}, 6) AS score FROM {name}_g),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, fused_rank, score,
   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank, chunk_id) AS INT) AS excerpt_no
   FROM {name}_s) WHERE excerpt_no <= {keep})"""


QRELS = f"""qrels AS (SELECT q.query_id, c.chunk_id FROM questions q, lv c
  WHERE len({tok('q.text')}) > 0
    AND contains(' ' || array_to_string({tok('c.text')}, ' ') || ' ', ' ' || array_to_string({tok('q.text')}, ' ') || ' '))"""

PER_QUERY = """per_query AS (SELECT l.query_id, count(*) FILTER (WHERE r.rank <= 10) / count(*) AS recall,
    coalesce(max(1.0::DOUBLE / r.rank), 0.0) AS rr
  FROM qrels l LEFT JOIN bm25 r USING (query_id, chunk_id) GROUP BY l.query_id)"""


# Indexing -----------------------------------------------------------------

@register("i07_token_counts", f"SELECT doc_id AS chunk_id, CAST(len({tok('text')}) AS INT) AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.size(tokens("text")).alias("tokens"))


@register(
    "i11_embed_hashed_terms",
    with_(LV, vec_sql("vec", "lv", "chunk_id"), body="SELECT chunk_id, CAST(slot AS INT) AS slot, round(w, 6) AS weight FROM vec"),
)
def embed_hashed(spark, sf):
    vecs = ix.embed(legal_view(spark, sf).select("chunk_id", "text")).select("chunk_id", F.posexplode_outer("embedding").alias("slot", "weight"))
    return vecs.where("weight <> 0").withColumn("weight", F.round("weight", 6))


@register(
    "i12_index_terms",
    with_(LV, "chunks AS (SELECT * FROM lv)", POSTINGS.strip(),
          body="SELECT jurisdiction, term, df, CAST(sum(tf) AS BIGINT) AS cf FROM terms JOIN post USING (jurisdiction, term) GROUP BY ALL"),
)
def index_terms(spark, sf):
    index = ix.build_index(legal_view(spark, sf))
    return index.postings.groupBy("jurisdiction", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register(
    "i12_index_stored",
    with_(LV, "chunks AS (SELECT * FROM lv)", POSTINGS.strip(),
          body="""SELECT jurisdiction, s.n, round(s.avgdl, 6) AS avgdl,
    (SELECT count(*) FROM terms t WHERE t.jurisdiction = s.jurisdiction) AS terms,
    (SELECT count(*) FROM post p WHERE p.jurisdiction = s.jurisdiction) AS postings FROM stats s"""),
)
def index_stored(spark, sf):
    path = fresh_path(spark, "index")
    ix.write_index(ix.build_index(legal_view(spark, sf)), path)
    index = ix.read_index(spark, path)
    terms = index.terms.groupBy("jurisdiction").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return index.stats.join(terms, "jurisdiction").select("jurisdiction", "n", F.round("avgdl", 6).alias("avgdl"), "terms", "postings")


@register("i13_vector_cells", "SELECT vec_id AS chunk_id, CAST(1 AS BIGINT) AS cells, true AS known FROM embeddings")
def vector_cells(spark, sf):
    """Every chunk lies in exactly one cell that has a centroid; which one is learned."""
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index, centroids = ix.build_vector_index(chunks)
    known = centroids.select("cell", F.lit(True).alias("known"))
    return index.join(known, "cell", "left").groupBy("chunk_id").agg(
        F.count("cell").alias("cells"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known")
    )


@register(
    "i16_stop_words",
    with_(LV, "chunks AS (SELECT * FROM lv)", POSTINGS.strip(),
          "stop AS (SELECT jurisdiction, term FROM terms JOIN stats USING (jurisdiction) WHERE df >= 0.5 * n)",
          body="""SELECT chunk_id, CAST(sum(tf) AS BIGINT) AS kept_tokens, count(*) AS kept_terms
  FROM post ANTI JOIN stop USING (jurisdiction, term) GROUP BY chunk_id"""),
)
def stop_words(spark, sf):
    index = ix.build_index(legal_view(spark, sf))
    stop = stage(ix.frequent_terms(index.terms, index.stats, 0.5), "stop")
    kept = ix.drop_stopwords(index.postings, stop)
    return kept.groupBy("chunk_id").agg(F.sum("tf").alias("kept_tokens"), F.count("*").alias("kept_terms"))


# Retrieval ----------------------------------------------------------------

@register(
    "r01_scope_filter",
    with_(LV, "iv AS (SELECT *, lead(effective_from) OVER (PARTITION BY act, section_no ORDER BY version) AS effective_to FROM lv)",
          body="""SELECT jurisdiction, act, section_no, version, status, chunk_id FROM iv
  WHERE status IN ('in_force', 'pending') AND effective_from <= DATE '2021-06-01'
    AND (effective_to IS NULL OR DATE '2021-06-01' < effective_to)
    AND doc_type IN ('statute', 'regulation') AND authority_level >= 2"""),
)
def scope(spark, sf):
    from codicil.operators.ingest import close_intervals

    dated = close_intervals(legal_view(spark, sf).drop("text", "heading"))
    held = rt.scope_filter(dated, AS_OF, doc_types=["statute", "regulation"], min_authority=2, include_status=("pending",))
    return held.select("jurisdiction", "act", "section_no", "version", "status", "chunk_id")


@register("r02_bm25", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), body="SELECT * FROM bm25"))
def bm25_scoped(spark, sf):
    return rt.bm25(scoped_chunks(spark, sf), questions(spark, sf))


@register("r02_bm25_stored_index", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), body="SELECT * FROM bm25"))
def bm25_stored(spark, sf):
    path = fresh_path(spark, "index")
    ix.write_index(ix.build_index(scoped_chunks(spark, sf)), path)
    return rt.bm25_from_index(ix.read_index(spark, path), questions(spark, sf))


LABEL_CENTROIDS = """cent AS (SELECT label, i, avg(x) AS x FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
centroid AS (SELECT label, list(x ORDER BY i) AS v FROM cent GROUP BY label),
cos AS (SELECT CAST(c.label AS BIGINT) AS query_id, e.vec_id AS chunk_id,
    round(list_cosine_similarity(c.v, e.embedding::DOUBLE[]), 6) AS score FROM centroid c, embeddings e),
near AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM cos)
  WHERE rank <= 50)"""


def vector_tables(spark, sf):
    """All vectors as chunks; one query per label, the mean of its vectors."""
    vecs = table(spark, sf, "embeddings")
    chunks = vecs.select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("jurisdiction"), "embedding")
    means = (
        vecs.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
    )
    asked = means.select(
        F.col("label").cast("bigint").alias("query_id"), F.lit("all").alias("jurisdiction"), F.col("xs.x").alias("embedding")
    )
    return chunks, asked


@register("r03_dense_exact", with_(LABEL_CENTROIDS, body="SELECT * FROM near"))
def dense_exact(spark, sf):
    return rt.dense_exact(*vector_tables(spark, sf))


@register("r03_dense_text", with_(LV, Q_SCOPED, CHUNKS_SCOPED, DENSE, body="SELECT * FROM dense"))
def dense_text(spark, sf):
    chunks = scoped_chunks(spark, sf).select("chunk_id", "jurisdiction", "text")
    return rt.dense_exact(ix.embed(chunks), ix.embed(questions(spark, sf)))


@register("r04_dense_ann_recall")
def dense_ann(spark, sf):
    """Recall per query with as many probes as a mean recall of 0.9 takes."""
    chunks, asked = vector_tables(spark, sf)
    index, centroids = ix.build_vector_index(chunks)
    asked = stage(asked, "asked")
    probes = rt.enough_probes(rt.recall_by_probes(chunks, index, centroids, asked, least=0.9))
    return rt.overlap_recall(rt.dense_exact(chunks, asked), rt.dense_ann(index, centroids, asked, probes=probes))


GIVEN_CELLS = LABEL_CENTROIDS + """,
spot AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS cell, embedding::DOUBLE[] AS v FROM embeddings QUALIFY cell < 16),
placed AS (SELECT e.vec_id AS chunk_id, arg_max(s.cell, (round(list_cosine_similarity(s.v, e.embedding::DOUBLE[]), 6), -s.cell)) AS cell
  FROM embeddings e, spot s GROUP BY e.vec_id),
probe AS (SELECT CAST(c.label AS BIGINT) AS query_id, s.cell,
  row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.v, s.v), 6) DESC, s.cell) AS turn FROM centroid c, spot s),
found AS (SELECT n, query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY n, query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
  FROM cos JOIN placed USING (chunk_id) JOIN probe USING (query_id, cell), (SELECT unnest([1, 2, 4, 8, 16]) AS n) WHERE turn <= n QUALIFY rank <= 50)"""


def given_index(spark, sf):
    """The index over cells around the first sixteen vectors, stored by cell and read back."""
    chunks, asked = vector_tables(spark, sf)
    first = table(spark, sf, "embeddings").orderBy("vec_id").limit(16)
    order = F.row_number().over(Window.orderBy("vec_id")) - 1
    centroids = stage(first.select(order.alias("cell"), F.col("embedding").cast("array<double>").alias("centroid")), "centroids")
    path = fresh_path(spark, "vector-index")
    ix.write_vector_index(ix.assign_cells(chunks, centroids), path)
    return chunks, ix.read_vector_index(spark, path), centroids, asked


@register("r04_dense_ann_given_cells", with_(GIVEN_CELLS, body="SELECT query_id, chunk_id, score, rank FROM found WHERE n = 4"))
def dense_ann_given(spark, sf):
    _, index, centroids, asked = given_index(spark, sf)
    return rt.dense_ann(index, centroids, asked, probes=4)


@register("r04_recall_by_probes", with_(GIVEN_CELLS, body="""SELECT CAST(n AS INT) AS probes, round(avg(recall), 6) AS recall FROM
  (SELECT t.n, e.query_id, round(count(f.chunk_id) / count(*), 6) AS recall FROM (SELECT DISTINCT n FROM found) t CROSS JOIN near e
   LEFT JOIN found f ON f.n = t.n AND f.query_id = e.query_id AND f.chunk_id = e.chunk_id GROUP BY ALL) GROUP BY n"""))
def recall_by_probes(spark, sf):
    return rt.recall_by_probes(*given_index(spark, sf))


@register("r04_dense_ann_all_cells", with_(LABEL_CENTROIDS, body="SELECT * FROM near"))
def dense_ann_all(spark, sf):
    """Probing every cell must give the exact neighbours."""
    chunks, asked = vector_tables(spark, sf)
    index, centroids = ix.build_vector_index(chunks)
    return rt.dense_ann(index, centroids, stage(asked, "asked"), probes=16)


@register("r05_rrf", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), DENSE, rrf_sql(["bm25", "dense"]), body="SELECT * FROM fused"))
def rrf(spark, sf):
    chunks, asked = scoped_chunks(spark, sf), questions(spark, sf)
    sparse = rt.bm25(chunks, asked)
    dense = rt.dense_exact(ix.embed(chunks.select("chunk_id", "jurisdiction", "text")), ix.embed(asked))
    return rt.rrf([sparse, dense])


def soft_boosts():
    return {
        "authority": (F.col("authority_level") >= 4, 0.2),
        "regulation": (F.col("doc_type") == "regulation", 0.1),
        "section": (F.col("section_no") == "3", 0.5),
    }


BOOSTED = """boosted AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
  FROM (SELECT f.query_id, f.chunk_id, round(f.score * CASE WHEN c.authority_level >= 4 THEN 1.2 ELSE 1.0 END::DOUBLE
      * CASE WHEN c.doc_type = 'regulation' THEN 1.1 ELSE 1.0 END::DOUBLE
      * CASE WHEN c.section_no = '3' THEN 1.5 ELSE 1.0 END::DOUBLE, 6) AS score
    FROM {src} f JOIN chunks c ON c.chunk_id = f.chunk_id)) WHERE rank <= 50)"""


@register("r06_boost", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), BOOSTED.format(src="bm25"),
                             body="SELECT query_id, chunk_id, score, rank FROM boosted"))
def boosted(spark, sf):
    chunks = scoped_chunks(spark, sf)
    cands = stage(rt.bm25(chunks, questions(spark, sf)), "cands")
    facts = chunks.select("chunk_id", "act", "section_no", "authority_level", "doc_type")
    return rt.boost(facts.join(cands, "chunk_id"), soft_boosts()).select("query_id", "chunk_id", "score", "rank")


@register("r07_rerank", with_(LV, Q_OPEN, CHUNKS_OPEN, BM25.strip(), rerank_sql("bm25"), body="SELECT * FROM excerpts"))
def reranked(spark, sf):
    chunks, asked = open_chunks(spark, sf), questions(spark, sf, scoped=False)
    return rt.rerank(stage(rt.bm25(chunks, asked), "cands"), chunks, asked)


@register(
    "r08_calibration",
    with_(LV, Q_OPEN, CHUNKS_OPEN, BM25.strip(), rerank_sql("bm25"), QRELS,
          "lab AS (SELECT e.score, CASE WHEN q.chunk_id IS NULL THEN 0 ELSE 1 END AS label FROM excerpts e LEFT JOIN qrels q USING (query_id, chunk_id))",
          "bins AS (SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS relevance FROM lab GROUP BY 1)",
          body="SELECT *, round(relevance - mean_score, 6) AS gap FROM bins"),
)
def calibration(spark, sf):
    scored = reranked(spark, sf)
    rel = ev.passage_qrels(legal_view(spark, sf), questions(spark, sf, scoped=False)).withColumn("label", F.lit(1))
    labelled = scored.join(rel, ["query_id", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return rt.calibrate(labelled)


@register(
    "r09_retrieve_many",
    with_(LV, Q_SCOPED.replace("questions AS", "base AS"),
          f"""vars AS (SELECT query_id, 0 AS variant_no, jurisdiction, text FROM base
   UNION ALL SELECT query_id, 1, jurisdiction, array_to_string(list_distinct({tok('text')}), ' ') || ' ' || jurisdiction FROM base
   UNION ALL SELECT query_id, 2, jurisdiction, text || ' section act ' || jurisdiction FROM base)""",
          "questions AS (SELECT query_id * 10 + variant_no AS query_id, jurisdiction, text FROM vars)",
          CHUNKS_SCOPED, BM25.strip(),
          """merged AS (SELECT query_id // 10 AS query_id, chunk_id, max(score) AS score,
    CAST(min(struct_pack(s := -score, v := query_id % 10)).v AS INT) AS variant_no FROM bm25 GROUP BY 1, 2)""",
          body="""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM merged)
  WHERE rank <= 50"""),
)
def many(spark, sf):
    base = questions(spark, sf)
    terse = F.concat_ws(" ", F.array_join(F.array_distinct(tokens("text")), " "), "jurisdiction")
    variants = (
        base.select("query_id", F.lit(0).alias("variant_no"), "jurisdiction", "text")
        .unionByName(base.select("query_id", F.lit(1).alias("variant_no"), "jurisdiction", terse.alias("text")))
        .unionByName(
            base.select("query_id", F.lit(2).alias("variant_no"), "jurisdiction", F.concat("text", F.lit(" section act "), "jurisdiction").alias("text"))
        )
    )
    return rt.retrieve_many(scoped_chunks(spark, sf), variants)


@register(
    "r10_retrieve",
    with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), DENSE, rrf_sql(["bm25", "dense"]), BOOSTED.format(src="fused"),
          rerank_sql("boosted"), body="SELECT * FROM excerpts"),
)
def hybrid(spark, sf):
    return rt.retrieve(questions(spark, sf), scoped_chunks(spark, sf), boosts=soft_boosts())


CHUNKS_AS_OF = """chunks AS (SELECT * FROM lv WHERE status = 'in_force' AND effective_from <= DATE '2021-01-15'
    AND (version = 3 OR DATE '2021-01-15' < effective_from + 400)
  QUALIFY act IS NULL OR section_no IS NULL
    OR rank() OVER (PARTITION BY jurisdiction, act, section_no ORDER BY effective_from DESC, version DESC) = 1)"""


@register(
    "r10_retrieve_as_of",
    with_(LV, Q_SCOPED, CHUNKS_AS_OF, BM25.strip(), DENSE, rrf_sql(["bm25", "dense"]), BOOSTED.format(src="fused"),
          rerank_sql("boosted"), body="SELECT * FROM excerpts"),
)
def hybrid_as_of(spark, sf):
    """On the date two versions of a section are valid; one of them is ranked, and cases are ranked with the Acts."""
    ends = F.when(F.col("version") < 3, F.date_add("effective_from", 400))
    dated = legal_view(spark, sf).withColumn("effective_to", ends)
    return rt.retrieve(questions(spark, sf), dated, boosts=soft_boosts(), scope={"as_of": dt.date(2021, 1, 15)})


@register("r11_doc_type_filter", with_(LV, body="""SELECT jurisdiction, doc_type, count(*) AS chunks, CAST(sum(len(text)) AS BIGINT) AS chars
  FROM lv WHERE doc_type IN ('case', 'regulation') AND status = 'in_force' GROUP BY ALL"""))
def doc_type_filter(spark, sf):
    held = rt.scope_filter(legal_view(spark, sf), doc_types=["case", "regulation"])
    return held.groupBy("jurisdiction", "doc_type").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@register("r12_section_history", with_(LV, body="""SELECT act, section_no, version, status, effective_from,
    lag(version) OVER w AS prev_version, lag(status) OVER w AS prev_status, lead(effective_from) OVER w AS next_from
  FROM lv WINDOW w AS (PARTITION BY act, section_no ORDER BY version)"""))
def history(spark, sf):
    return rt.section_history(legal_view(spark, sf))


@register("r13_number_excerpts", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(),
                                       body="SELECT query_id, chunk_id, score, rank, rank AS excerpt_no FROM bm25 WHERE rank <= 12"))
def numbered(spark, sf):
    return rt.number_excerpts(rt.bm25(scoped_chunks(spark, sf), questions(spark, sf)))


@register(
    "r14_lexical_fallback",
    with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), DENSE,
          "dense_on AS (SELECT d.* FROM dense d JOIN questions q USING (query_id) WHERE q.jurisdiction NOT IN ('de', 'us'))",
          rrf_sql(["bm25", "dense_on"]), rerank_sql("fused"), body="SELECT * FROM excerpts"),
)
def fallback(spark, sf):
    return rt.retrieve(questions(spark, sf), scoped_chunks(spark, sf), modes={"de": "lexical", "us": "lexical", "gb": "hybrid"})


# Retrieval metrics --------------------------------------------------------

def open_run(spark, sf):
    """Unscoped run with its relevance judgements: (qrels, run)."""
    asked = questions(spark, sf, scoped=False)
    run = rt.bm25(open_chunks(spark, sf), asked)
    return ev.passage_qrels(legal_view(spark, sf), asked), run


OPEN_RUN = (LV, Q_OPEN, CHUNKS_OPEN, BM25.strip(), QRELS)


@register("e01_qrels", with_(LV, Q_OPEN, QRELS, body="SELECT * FROM qrels"))
def qrels(spark, sf):
    return ev.passage_qrels(legal_view(spark, sf), questions(spark, sf, scoped=False))


@register("e01_recall_at_10", with_(*OPEN_RUN, PER_QUERY, body="SELECT count(*) AS queries, round(avg(recall), 6) AS recall FROM per_query"))
def recall(spark, sf):
    return ev.recall_at_k(*open_run(spark, sf))


@register("e02_mrr", with_(*OPEN_RUN, PER_QUERY, body="SELECT count(*) AS queries, round(avg(rr), 6) AS mrr FROM per_query"))
def mrr(spark, sf):
    return ev.mrr(*open_run(spark, sf))


LEAKY = """runj AS (SELECT r.query_id, r.chunk_id, q.jurisdiction, c.jurisdiction AS excerpt_jurisdiction
  FROM bm25 r JOIN {q} q ON q.query_id = r.query_id JOIN lv c ON c.chunk_id = r.chunk_id)"""
LEAK_BODY = """SELECT jurisdiction, count(*) AS returned, count(*) FILTER (WHERE excerpt_jurisdiction <> jurisdiction) AS leaked,
  round(count(*) FILTER (WHERE excerpt_jurisdiction <> jurisdiction) / count(*), 6) AS leakage FROM runj GROUP BY jurisdiction"""


def placed(spark, sf, run):
    where = legal_view(spark, sf).select("chunk_id", F.col("jurisdiction").alias("excerpt_jurisdiction"))
    asked = questions(spark, sf).select("query_id", "jurisdiction")
    return run.select("query_id", "chunk_id").join(asked, "query_id").join(where, "chunk_id")


@register("e03_leakage_scoped", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), LEAKY.format(q="questions"), body=LEAK_BODY))
def leak_scoped(spark, sf):
    return ev.leakage(placed(spark, sf, rt.bm25(scoped_chunks(spark, sf), questions(spark, sf))), ["jurisdiction"])


@register("e03_leakage_unscoped",
          with_(LV, Q_OPEN, Q_SCOPED.replace("questions AS", "homes AS"), CHUNKS_OPEN, BM25.strip(), LEAKY.format(q="homes"), body=LEAK_BODY))
def leak_unscoped(spark, sf):
    run = rt.bm25(open_chunks(spark, sf), questions(spark, sf, scoped=False))
    return ev.leakage(placed(spark, sf, run), ["jurisdiction"])


@register("e13_misses", with_(*OPEN_RUN, body="""SELECT query_id, chunk_id, r.rank AS near_miss_rank FROM qrels l LEFT JOIN bm25 r USING (query_id, chunk_id)
  WHERE r.rank IS NULL OR r.rank > 1"""))
def missed(spark, sf):
    return ev.misses(*open_run(spark, sf), k=1)


TAGGED = """tagged AS (SELECT q.query_id, CASE q.query_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END AS jurisdiction,
    CASE WHEN q.query_id % 3 = 0 THEN 'compound' ELSE 'plain' END AS tag, p.recall, p.rr FROM questions q JOIN per_query p USING (query_id))"""


def tagged(spark, sf):
    per = ev.per_query(*open_run(spark, sf))
    home = questions(spark, sf).select("query_id", "jurisdiction")
    tag = F.when(F.col("query_id") % 3 == 0, "compound").otherwise("plain")
    return per.join(home, "query_id").withColumn("tag", tag)


@register("e08_eval_matrix", with_(*OPEN_RUN, PER_QUERY, TAGGED, body="""SELECT jurisdiction, tag, CAST(grouping(jurisdiction) * 2 + grouping(tag) AS INT) AS level,
  count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM tagged GROUP BY ROLLUP (jurisdiction, tag)"""))
def matrix(spark, sf):
    return ev.eval_matrix(tagged(spark, sf))


OLD_RUN = """old AS (SELECT query_id, max(score) AS old_value FROM bm25 GROUP BY ALL),
fresh AS (SELECT query_id, max(score) AS new_value FROM boosted GROUP BY ALL)"""


@register("e09_eval_delta", with_(LV, Q_SCOPED, CHUNKS_SCOPED, BM25.strip(), BOOSTED.format(src="bm25"), OLD_RUN,
    body="""SELECT query_id, 'top_score' AS metric, old_value, new_value, round(new_value - old_value, 6) AS delta,
  CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'missing' WHEN new_value - old_value < -1e-9 THEN 'regressed'
    WHEN new_value - old_value > 1e-9 THEN 'improved' ELSE 'same' END AS change FROM old FULL JOIN fresh USING (query_id)"""))
def delta(spark, sf):
    chunks = scoped_chunks(spark, sf)
    run = stage(rt.bm25(chunks, questions(spark, sf)), "run")
    facts = chunks.select("chunk_id", "act", "section_no", "authority_level", "doc_type")
    tuned = rt.boost(facts.join(run, "chunk_id"), soft_boosts())
    def best(r):
        return r.groupBy("query_id").agg(F.max("score").alias("value")).withColumn("metric", F.lit("top_score"))
    return ev.eval_delta(best(run), best(tuned), ["query_id", "metric"])


GRID = [0.2, 0.4, 0.5, 0.6, 0.8]
SWEEP_SQL = (*OPEN_RUN, rerank_sql("bm25"),
    """best AS (SELECT e.query_id, max(e.score) AS score, bool_or(l.chunk_id IS NOT NULL) AS relevant
      FROM excerpts e LEFT JOIN qrels l USING (query_id, chunk_id) GROUP BY e.query_id)""",
    """sc AS (SELECT CASE query_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END AS jurisdiction, score, relevant FROM best)""",
    """swept AS (SELECT jurisdiction, threshold, count(*) FILTER (WHERE score >= threshold) AS answered,
      count(*) FILTER (WHERE score >= threshold AND relevant) AS answered_right,
      count(*) FILTER (WHERE score < threshold AND relevant) AS false_refusals
      FROM sc, (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8]::DOUBLE[]) AS threshold) GROUP BY ALL)""")


def best_scores(spark, sf):
    rel = ev.passage_qrels(legal_view(spark, sf), questions(spark, sf, scoped=False)).withColumn("hit", F.lit(True))
    best = (
        reranked(spark, sf)
        .join(rel, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.max("score").alias("score"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("relevant"))
    )
    return best.join(questions(spark, sf).select("query_id", "jurisdiction"), "query_id")


@register("e11_threshold_sweep", with_(*SWEEP_SQL, body="""SELECT *, CASE WHEN answered > 0 THEN round(answered_right / answered, 6) END AS precision FROM swept"""))
def threshold_sweep(spark, sf):
    return ev.sweep(best_scores(spark, sf), GRID)


@register("e11_best_threshold", with_(*SWEEP_SQL, body="""SELECT jurisdiction, threshold, gain FROM (SELECT jurisdiction, threshold, 2 * answered_right - answered AS gain,
  row_number() OVER (PARTITION BY jurisdiction ORDER BY 2 * answered_right - answered DESC, threshold) AS r FROM swept) WHERE r = 1"""))
def best_threshold(spark, sf):
    return ev.best_threshold(ev.sweep(best_scores(spark, sf), GRID))


@register("e14_by_language", with_(*OPEN_RUN, """hits AS (SELECT c.lang, count(*) AS n, avg(CASE WHEN r.rank <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE) AS recall
   FROM qrels l JOIN lv c USING (chunk_id) LEFT JOIN bm25 r USING (query_id, chunk_id) GROUP BY c.lang)""",
   body="SELECT lang, n, round(recall, 6) AS recall, round(recall - (SELECT sum(recall * n) / sum(n) FROM hits), 6) AS vs_overall FROM hits"))
def language_quality(spark, sf):
    pairs = ev.judged(*open_run(spark, sf))
    lang = legal_view(spark, sf).select("chunk_id", "lang")
    hit = F.when(F.col("rank") <= 10, F.lit(1.0)).otherwise(F.lit(0.0))
    return ev.by_language(pairs.join(lang, "chunk_id").withColumn("recall", hit))
