import datetime as dt

import pytest
from pyspark.sql import functions as F

from codicil.operators import evaluation as ev


@pytest.fixture(scope="module")
def judged(spark):
    qrels = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "query_id bigint, chunk_id bigint")
    run = spark.createDataFrame([(1, 99, 1), (1, 10, 2), (2, 20, 12), (9, 1, 1)], "query_id bigint, chunk_id bigint, rank int")
    return qrels, run


def test_recall_and_mrr(judged):
    assert tuple(ev.recall_at_k(*judged).first()) == (3, round((0.5 + 0 + 0) / 3, 6))
    assert tuple(ev.mrr(*judged).first()) == (3, round((1 / 2 + 1 / 12 + 0) / 3, 6))
    assert {tuple(r) for r in ev.misses(*judged).collect()} == {(1, 11, None), (2, 20, 12), (3, 30, None)}


def test_no_qrels_gives_null(spark, judged):
    assert ev.recall_at_k(judged[0].limit(0), judged[1]).first().recall is None


def test_passage_qrels_against_brute_force(spark):
    docs = [(1, "The quick, brown fox jumps over the lazy dog again and again"), (2, "quick brown"), (3, "a brown fox jumps over the lazy cat"), (4, "foxes"), (5, "")]
    asks = [(1, "Quick brown fox jumps over the lazy dog"), (2, "quick BROWN"), (3, "fox"), (4, "brown fox jumps over the lazy"), (5, "...")]
    import re

    def words(t):
        return " " + " ".join(w for w in re.split(r"[^a-z0-9]+", t.lower()) if w) + " "

    want = {(q, d) for q, a in asks for d, t in docs if words(a).strip() and words(a) in words(t)}
    got = ev.passage_qrels(
        spark.createDataFrame(docs, "chunk_id bigint, text string"), spark.createDataFrame(asks, "query_id bigint, text string")
    )
    assert {tuple(r) for r in got.collect()} == want


def test_leaked_excerpt_turns_the_gate_red(spark):
    clean = [("gb", "gb")] * 3 + [("za", "za")]
    run = spark.createDataFrame([*clean, ("za", "gb")], "jurisdiction string, excerpt_jurisdiction string")
    leak = ev.leakage(run, ["jurisdiction"])
    assert {r.jurisdiction: r.leakage for r in leak.collect()} == {"gb": 0.0, "za": 0.5}
    assert ev.leakage(run.limit(0)).first().leakage is None
    metrics = leak.select("jurisdiction", F.lit("leakage").alias("metric"), F.col("leakage").alias("value"))
    for m in ("refusal_recall", "citation_validity"):
        metrics = metrics.unionByName(leak.select("jurisdiction", F.lit(m).alias("metric"), F.lit(1.0).alias("value")))
    got = {r.jurisdiction: (r.passed, r.failing) for r in ev.gate(metrics).collect()}
    assert got == {"gb": (True, []), "za": (False, ["leakage"])}


def test_release_gate_has_recall_bars_and_fails_on_absent_metrics(spark):
    full = {"leakage": 0.0, "refusal_recall": 1.0, "citation_validity": 1.0, "invented_rate": 0.0, "entail_rate": 0.96}
    rows = [(j, m, v) for j in ("za", "gb", "nz") for m, v in full.items()] + [("za", "recall", 0.84), ("gb", "recall", 0.81)]
    rows += [("us", "leakage", 0.0)]
    got = {r.jurisdiction: r.failing for r in ev.gate(spark.createDataFrame(rows, "jurisdiction string, metric string, value double"), "release").collect()}
    assert got["za"] == ["recall"] and got["gb"] == [] and got["nz"] == []
    assert got["us"] == ["citation_validity", "entail_rate", "invented_rate", "refusal_recall"]


def test_refusals_both_ways(spark):
    g = spark.createDataFrame([(1, "za", True), (2, "za", True), (3, "za", False), (4, "za", False), (5, "gb", False)], "query_id int, jurisdiction string, must_refuse boolean")
    out = spark.createDataFrame([(1, True), (3, True), (4, False)], "query_id int, refused boolean")
    got = {r.jurisdiction: r for r in ev.refusal_correctness(g, out).collect()}
    assert (got["za"].refusal_recall, got["za"].false_refusal_rate, got["za"].missed_refusals) == (0.5, 0.5, 1)
    assert got["gb"].refusal_recall is None


def test_matrix_delta_sweep(spark):
    s = spark.createDataFrame([("za", "trap", 1.0, 0.5), ("za", "plain", 0.0, 0.0), ("gb", "plain", 1.0, 1.0)], "jurisdiction string, tag string, recall double, rr double")
    got = {(r.jurisdiction, r.tag): (r.level, r.queries, r.recall) for r in ev.eval_matrix(s).collect()}
    assert got[("za", None)] == (1, 2, 0.5) and got[(None, None)] == (3, 3, 0.666667) and len(got) == 6
    a = spark.createDataFrame([("q1", 1.0), ("q2", 0.5), ("q3", 0.1), ("q4", 0.2)], "qa_id string, value double")
    b = spark.createDataFrame([("q1", 0.5), ("q2", 0.5), ("q3", 0.9), ("q5", 0.2)], a.schema)
    assert {r.qa_id: r.change for r in ev.eval_delta(a, b, ["qa_id"]).collect()} == {"q1": "regressed", "q2": "same", "q3": "improved", "q4": "missing", "q5": "added"}
    scored = spark.createDataFrame([("za", 0.9, True), ("za", 0.55, False), ("za", 0.3, True)], "jurisdiction string, score double, relevant boolean")
    swept = ev.sweep(scored, [0.2, 0.5, 0.8, 0.95])
    got = {r.threshold: (r.answered, r.answered_right, r.false_refusals, r.precision) for r in swept.collect()}
    assert got == {0.2: (3, 2, 0, 0.666667), 0.5: (2, 1, 1, 0.5), 0.8: (1, 1, 1, 1.0), 0.95: (0, 0, 2, None)}
    assert tuple(ev.best_threshold(swept).first()) == ("za", 0.2, 1)


def test_streak_breaks_on_a_missing_night(spark):
    d = dt.date
    five = [("za", d(2024, 1, i), True) for i in range(1, 6)]
    gap = [("gb", d(2024, 1, i), True) for i in (1, 2, 3, 5, 6)]
    red = [("us", d(2024, 1, i), i != 3) for i in range(1, 7)]
    nightly = spark.createDataFrame(five + gap + red, "jurisdiction string, night date, green boolean")
    met = {}
    for r in ev.streak(nightly).collect():
        met[r.jurisdiction] = met.get(r.jurisdiction, False) or r.met
    assert met == {"za": True, "gb": False, "us": False}
    assert [(r.jurisdiction, r.night) for r in ev.regression_alerts(nightly).collect()] == [("us", d(2024, 1, 3))]


def test_quota_and_language(spark):
    g = spark.createDataFrame([("za", True, ["trap"]), ("za", False, ["plain"])], "jurisdiction string, must_refuse boolean, tags array<string>")
    r = ev.golden_quota(g, {"total": 3, "must_refuse": 1, "trap": 1}).first()
    assert (r.total, r.must_refuse, r.trap, r.short, r.met) == (2, 1, 1, ["total"], False)
    langs = spark.createDataFrame([("de", 1.0), ("de", 0.0), ("en", 1.0)], "lang string, recall double")
    assert {r.lang: r.vs_overall for r in ev.by_language(langs).collect()} == {"de": round(0.5 - 2 / 3, 6), "en": round(1 / 3, 6)}


def test_expected_jurisdictions_cannot_be_missing(spark):
    metrics = spark.createDataFrame(
        [("gb", m, v) for m, v in (("leakage", 0.0), ("refusal_recall", 1.0), ("citation_validity", 1.0))],
        "jurisdiction string, metric string, value double",
    )
    got = {r.jurisdiction: (r.passed, r.failing) for r in ev.gate(metrics, "ci", ["gb", "za"]).collect()}
    assert got == {"gb": (True, []), "za": (False, sorted(m for m, _, _ in ev.PROFILES["ci"]))}
    assert [r.jurisdiction for r in ev.gate(metrics, "ci").collect()] == ["gb"]
    golden = spark.createDataFrame([("gb", True, ["trap"])], "jurisdiction string, must_refuse boolean, tags array<string>")
    rows = {r.jurisdiction: (r.total, r.short, r.met) for r in ev.golden_quota(golden, {"total": 1, "trap": 1}, ["gb", "za"]).collect()}
    assert rows == {"gb": (1, [], True), "za": (0, ["total", "trap"], False)}
