import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.functions import relational as rel
from codicil.functions.relational import fresh_path
from codicil.operators import indexing as ix
from codicil.operators import retrieval as rt


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    data = [
        (1, "gb", "notice period of employment", "notice", "a1", "1", "in_force", "statute", 1),
        (2, "gb", "employment contract terms and notice notice", "contract", "a1", "2", "in_force", "statute", 5),
        (3, "za", "notice of termination under the labour act", "termination", "a2", "1", "in_force", "statute", 3),
        (4, "za", "minimum wage", "wage", "a2", "2", "repealed", "regulation", 2),
    ]
    return spark.createDataFrame(
        data, "chunk_id bigint, jurisdiction string, text string, heading string, act string, section_no string, status string, doc_type string, authority_level int"
    )


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(10, "gb", "notice period"), (11, "za", "notice of termination"), (12, "za", "zebra")],
        "query_id bigint, jurisdiction string, text string",
    )


def test_bm25_by_hand(chunks, asked):
    got = {(r.query_id, r.chunk_id): r.score for r in rt.bm25(chunks, asked).collect()}
    avg = (4 + 6) / 2
    idf = {"notice": np.log(1 + 0.5 / 2.5), "period": np.log(1 + 1.5 / 1.5)}

    def part(term, tf, dl):
        return idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert got[(10, 1)] == pytest.approx(part("notice", 1, 4) + part("period", 1, 4), abs=1e-6)
    assert got[(10, 2)] == pytest.approx(part("notice", 2, 6), abs=1e-6)
    assert (12, 4) not in got and all(c in (3, 4) for q, c in got if q == 11)


def test_scores_are_cut_before_they_are_shuffled(chunks, asked):
    plan = rt.bm25(chunks, asked)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)


def test_adding_a_corpus_changes_no_other_ranks(spark, chunks, asked):
    more = chunks.where("jurisdiction = 'gb'").withColumn("jurisdiction", F.lit("nz")).withColumn("chunk_id", F.col("chunk_id") + 100)
    assert rows(rt.bm25(chunks, asked)) == rows(rt.bm25(chunks.unionByName(more), asked))


def test_stored_index_agrees_with_one_pass(spark, chunks, asked):
    path = fresh_path(spark, "ix")
    ix.write_index(ix.build_index(chunks), path, buckets=8)
    assert rows(rt.bm25_from_index(ix.read_index(spark, path, 8), asked)) == rows(rt.bm25(chunks, asked))


def test_hot_join_agrees_without_broadcast(spark, chunks, asked, monkeypatch):
    want = rows(rt.bm25(chunks, asked))
    monkeypatch.setattr(rel.small_side, "__defaults__", (0,))
    assert rows(rt.bm25(chunks, asked)) == want


def vectors(spark, n, key, seed):
    rng = np.random.default_rng(seed)
    data = [(i, "gb" if i % 3 else "za", [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    return spark.createDataFrame(data, f"{key} bigint, jurisdiction string, embedding array<double>")


def brute(chunks, queries, k):
    out = set()
    for q in queries.collect():
        a = np.array(q.embedding)
        sims = []
        for c in chunks.collect():
            if c.jurisdiction == q.jurisdiction:
                b = np.array(c.embedding)
                sims.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), c.chunk_id))
        out |= {(q.query_id, c, r + 1) for r, (_, c) in enumerate(sorted(sims)[:k])}
    return out


def test_dense_exact_against_brute_force(spark, monkeypatch):
    chunks, queries = vectors(spark, 120, "chunk_id", 1), vectors(spark, 9, "query_id", 2)
    want = brute(chunks, queries, 5)
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in rt.dense_exact(chunks, queries, 5).collect()}
    assert got == want
    named = chunks.withColumn("chunk_id", F.format_string("c%03d", "chunk_id"))
    texts = {(r.query_id, int(r.chunk_id[1:]), r["rank"]) for r in rt.dense_exact(named, queries, 5).collect()}
    assert texts == want
    monkeypatch.setattr(rt, "QUESTIONS_A_ROUND", 4)
    blocked = {(r.query_id, r.chunk_id, r["rank"]) for r in rt.dense_exact(chunks, queries, 5).collect()}
    assert blocked == want


def test_many_questions_leave_the_corpus_in_place(spark, monkeypatch):
    chunks, queries = vectors(spark, 60, "chunk_id", 5), vectors(spark, 10_000, "query_id", 6)
    plans, real = [], rt._nearest_shipped

    def seen(*args):
        plans.append(real(*args))
        return plans[-1]

    monkeypatch.setattr(rt, "_nearest_shipped", seen)
    got = rt.dense_exact(chunks, queries, 3).collect()
    assert len(plans) >= 3 and not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    monkeypatch.setattr(rt, "QUESTIONS_A_ROUND", 20_000)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rt.dense_exact(chunks, queries, 3).collect()))


def test_probes_are_chosen_by_measured_recall(spark):
    place = lambda df: df.withColumn("jurisdiction", F.lit("all"))
    chunks, queries = place(vectors(spark, 300, "chunk_id", 7)), place(vectors(spark, 8, "query_id", 8))
    spots = chunks.where("chunk_id < 8").selectExpr("CAST(chunk_id AS INT) AS cell", "CAST(embedding AS array<double>) AS centroid")
    index = ix.assign_cells(chunks, spots)
    recalls = rt.recall_by_probes(chunks, index, spots, queries, 10, least=0.9)
    got = {r.probes: r.recall for r in recalls.collect()}
    assert max(got.values()) >= 0.9 and all(v < 0.9 for p, v in got.items() if p < max(got))
    assert rt.enough_probes(recalls) == max(got)


def test_a_stored_index_reads_the_probed_cells_only(spark):
    chunks = vectors(spark, 200, "chunk_id", 9).withColumn("jurisdiction", F.lit("all"))
    queries = vectors(spark, 1, "query_id", 10).withColumn("jurisdiction", F.lit("all"))
    spots = chunks.where("chunk_id < 8").selectExpr("CAST(chunk_id AS INT) AS cell", "CAST(embedding AS array<double>) AS centroid")
    path = fresh_path(spark, "cells")
    ix.write_vector_index(ix.assign_cells(chunks, spots), path)
    stored = ix.read_vector_index(spark, path)
    one = rt.dense_ann(stored, spots, queries, 5, probes=2)
    filters = [line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert any("cell" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)
    memory = rt.dense_ann(ix.assign_cells(chunks, spots), spots, queries, 5, probes=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, memory.collect()))


def test_ann_with_all_cells_is_exact(spark):
    chunks, queries = vectors(spark, 80, "chunk_id", 3).withColumn("jurisdiction", F.lit("all")), vectors(spark, 5, "query_id", 4).withColumn("jurisdiction", F.lit("all"))
    index, centroids = ix.build_vector_index(chunks, cells=4)
    exact = rt.dense_exact(chunks, queries, 10)
    full = rt.dense_ann(index, centroids, queries, 10, probes=4)
    assert {r.recall for r in rt.overlap_recall(exact, full).collect()} == {1.0}
    few = rt.overlap_recall(exact, rt.dense_ann(index, centroids, queries, 10, probes=1)).collect()
    assert len(few) == 5 and all(0 <= r.recall <= 1 for r in few)


def test_term_counts(spark):
    from codicil.functions.text import tokens, with_term_counts

    df = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, "x")], "id int, text string").withColumn("toks", tokens("text"))
    got = {r.id: {(c.term, c.tf) for c in r.counts} for r in with_term_counts(df).collect()}
    assert got == {1: {("a", 2), ("b", 3), ("c", 1)}, 2: set(), 3: {("x", 1)}}


def ranked(spark, data):
    return spark.createDataFrame(data, "query_id bigint, chunk_id bigint, rank int")


def test_rrf_order_free_and_by_hand(spark):
    a, b = ranked(spark, [(1, 7, 1), (1, 8, 2)]), ranked(spark, [(1, 8, 1), (1, 9, 2)])
    got = rows(rt.rrf([a, b]))
    assert got == rows(rt.rrf([b, a]))
    assert got[1] == (1, 8, round(1 / 61 + 1 / 62, 6), 1)


def test_filter_before_rank_differs_from_filter_after(chunks, asked):
    scoped = rt.bm25(rt.scope_filter(chunks, doc_types=["statute"], min_authority=2), asked, 1)
    late = rt.bm25(chunks, asked, 1).join(chunks.where("authority_level >= 2").select("chunk_id"), "chunk_id")
    assert scoped.where("query_id = 10").count() == 1 and late.where("query_id = 10").count() == 0


def test_scope_keeps_marked_status_only_if_asked(chunks):
    assert {r.chunk_id for r in rt.scope_filter(chunks).collect()} == {1, 2, 3}
    wide = rt.scope_filter(chunks, include_status=("repealed",)).collect()
    assert {r.chunk_id: r.status for r in wide}[4] == "repealed"


def test_scope_reaches_the_scan(spark, chunks):
    path = fresh_path(spark, "scoped")
    dated = chunks.withColumn("effective_from", F.lit(dt.date(2020, 1, 1))).withColumn("effective_to", F.lit(None).cast("date"))
    dated.write.partitionBy("jurisdiction").parquet(path)
    df = rt.scope_filter(spark.read.parquet(path), dt.date(2021, 1, 1), jurisdictions=["gb"], doc_types=["statute"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "jurisdiction" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(doc_type,statute)" in plan or "doc_type" in plan.split("PushedFilters:")[1]


def test_scope_over_absent_columns_is_an_error(spark, chunks):
    for scope in ({"as_of": dt.date(2021, 1, 1)}, {"tenant_id": "t"}):
        with pytest.raises(ValueError, match="lacks"):
            rt.scope_filter(chunks, **scope)


def test_retrieve_ranks_one_version_valid_on_the_date(spark):
    day = dt.date
    data = [
        (1, "a1", "1", 1, day(2019, 1, 1), day(2021, 3, 1), "in_force", "t1"),
        (2, "a1", "1", 2, day(2021, 1, 1), None, "in_force", None),
        (3, "a1", "1", 2, day(2021, 1, 1), None, "in_force", None),
        (4, "a1", "1", 3, day(2022, 1, 1), None, "in_force", None),
        (5, "a1", "2", 1, day(2019, 1, 1), day(2020, 1, 1), "in_force", None),
        (6, None, None, 1, day(2019, 1, 1), None, "in_force", None),
        (7, None, None, 2, day(2020, 1, 1), None, "in_force", None),
        (8, "a1", "3", 1, day(2019, 1, 1), None, "repealed", None),
        (9, "a2", "1", 1, day(2019, 1, 1), None, "in_force", "t2"),
    ]
    corpus = spark.createDataFrame(
        data, "chunk_id bigint, act string, section_no string, version int, effective_from date, effective_to date, status string, tenant_id string"
    ).selectExpr("*", "'gb' AS jurisdiction", "'case' AS doc_type", "1 AS authority_level", "'notice' AS heading",
                 "concat('notice period number ', chunk_id) AS text")
    asked = spark.createDataFrame([(1, "gb", "notice period")], "query_id bigint, jurisdiction string, text string")
    found = lambda **scope: sorted(r.chunk_id for r in rt.retrieve(asked, corpus, scope=scope).collect())
    assert found(as_of=day(2021, 2, 1), tenant_id="t1") == [2, 3, 6, 7]
    assert found(as_of=day(2020, 6, 1), tenant_id="t2") == [6, 7, 9]
    assert sorted(r.chunk_id for r in rt.one_version(corpus).collect()) == [4, 5, 6, 7, 8, 9]


def test_top_k_prunes_before_the_shuffle(spark):
    run = ranked(spark, [(1, i, i) for i in range(20)]).withColumn("score", F.rand(1))
    plan = rel.top_k(run.drop("rank"), ["query_id"], rel.best_first(), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rerank_bounds(chunks, asked):
    with pytest.raises(ValueError):
        rt.rerank(rt.bm25(chunks, asked), chunks, asked, keep=20)
    best = {r.query_id: r for r in rt.rerank(rt.bm25(chunks, asked), chunks, asked).where("excerpt_no = 1").collect()}
    assert best[11].chunk_id == 3 and best[11].score == pytest.approx(0.6 + 0.2 + 0.2 / 3, abs=1e-6)


def test_rerank_takes_a_scorer(chunks, asked):
    by_length = F.size("c_toks").cast("double")
    best = {r.query_id: r.chunk_id for r in rt.rerank(rt.bm25(chunks, asked), chunks, asked, by_length).where("excerpt_no = 1").collect()}
    assert best[10] == 2


def test_lexical_fallback_drops_only_that_jurisdiction(spark, asked):
    dense = ranked(spark, [(10, 1, 1), (11, 3, 1)])
    assert rows(rt.lexical_only(dense, asked, {"za": "lexical", "gb": "hybrid"}).select("query_id")) == [(10,)]


def test_retrieve_leaks_nothing(chunks, asked):
    out = rt.retrieve(asked, chunks).join(chunks.select("chunk_id", F.col("jurisdiction").alias("j")), "chunk_id").join(asked, "query_id")
    assert out.count() > 0 and out.where("j <> jurisdiction").count() == 0


def test_custom_embedder(spark, chunks):
    def lengths(batches):
        for texts in batches:
            yield texts.map(lambda t: [float(len(t)), 1.0])

    got = {r.chunk_id: r.embedding for r in ix.embed(chunks, lengths).collect()}
    assert got[4] == [12.0, 1.0]
