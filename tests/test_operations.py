import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path
from codicil.operators import operations as op
from codicil.streaming import monitors as mo

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        user = 1 if rng.random() < 0.4 else rng.randrange(2, 9)  # one busy user
        rows.append((i, T0 + dt.timedelta(seconds=rng.randrange(0, 200_000) // 7 * 7), user, f"10.0.0.{rng.randrange(3)}"))
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, ip string"), rows


def us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def test_breaches_against_brute_force(log):
    df, rows = log
    for window, limit in ((3600, 3), (60, 1), (86400, 40)):
        want = set()
        for u in {r[2] for r in rows}:
            mine = [us(r[1]) for r in rows if r[2] == u]
            for t in set(mine):
                n = sum(1 for x in mine if t - window * 1_000_000 < x <= t)
                if n > limit:
                    want.add((u, t, n))
        got = {(r.key, r.us, r.in_window) for r in op.breaches(df, "user_id", window, limit).collect()}
        assert got == want


def test_window_excludes_its_far_edge(spark):
    df = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(seconds=60))], "k int, ts timestamp")
    assert op.breaches(df, "k", 60, 1).count() == 0
    assert op.breaches(df, "k", 61, 1).count() == 1


def test_sessions_against_brute_force(log):
    df, rows = log
    want = set()
    for u in {r[2] for r in rows}:
        mine = sorted((us(r[1]), r[3]) for r in rows if r[2] == u)
        runs = [[mine[0]]]
        for e in mine[1:]:
            if e[0] - runs[-1][-1][0] >= 1800 * 1_000_000:
                runs.append([])
            runs[-1].append(e)
        want |= {(u, i + 1, s[0][0], s[-1][0], len(s), len({ip for _, ip in s})) for i, s in enumerate(runs)}
    got = {(r.user_id, r.session_no, r.start_us, r.end_us, r.events, r.addresses) for r in op.session_audit(df).collect()}
    assert got == want


def test_bursts_against_brute_force(log):
    df, rows = log
    step = 900 * 1_000_000
    counts = {}
    for r in rows:
        for b in range(4):
            k = (r[2], us(r[1]) // step - b)
            counts[k] = counts.get(k, 0) + 1
    want = {(c, s * step, n) for (c, s), n in counts.items() if n > 4}
    got = op.bursts(df.withColumn("corpus_id", F.col("user_id")), 4)
    assert {(r.corpus_id, r.u, r.n) for r in got.withColumn("u", F.unix_micros("window_start")).collect()} == want


def test_quota(log):
    df, rows = log
    got = op.quota_use(df.withColumn("endpoint", F.when(F.col("event_id") % 2 == 0, "search").otherwise("draft")), {"search": 3})
    assert got.agg(F.sum("used")).first()[0] == len(rows)
    assert got.where("endpoint = 'draft' AND over").count() == 0 and got.where("over AND used <= 3").count() == 0


def test_spoofed_chain(spark):
    df = spark.createDataFrame([(1, "9.9.9.9", "6.6.6.6, 10.0.0.1"), (2, "9.9.9.9", "10.0.0.1"), (3, "9.9.9.9", None), (4, "9.9.9.9", "10.0.0.1, 10.0.0.1")], "id int, ip string, xff string")
    got = {r.id: (r.client_ip, r.spoof_suspect) for r in op.client_ip(df).collect()}
    assert got == {1: ("6.6.6.6", True), 2: ("10.0.0.1", False), 3: ("9.9.9.9", False), 4: ("10.0.0.1", False)}
    assert {r.client_ip for r in op.client_ip(df, hop=1).where("id = 1").collect()} == {"10.0.0.1"}


def test_canary_only_grows(spark):
    reqs = spark.range(2000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, "za").otherwise("gb").alias("jurisdiction"))
    arms = {p: {r.request_id for r in op.assign_canary(reqs, {"za": p}).where("arm = 'canary'").collect()} for p in (10, 50, 100)}
    assert arms[10] < arms[50] < arms[100] and len(arms[100]) == 1000
    assert 60 < len(arms[10]) < 140


def test_slo_window_needs_seven_present_days(spark):
    d = dt.date
    full = [("za", d(2024, 1, i), True) for i in range(1, 9)]
    hole = [("gb", d(2024, 1, i), True) for i in (1, 2, 3, 4, 6, 7, 8)]
    bad = [("us", d(2024, 1, i), i != 2) for i in range(1, 10)]
    got = {(r.jurisdiction, r.day.day): (r.met, r.rollback) for r in op.slo_window(spark.createDataFrame(full + hole + bad, "jurisdiction string, day date, ok boolean")).collect()}
    assert got[("za", 6)] == (False, False) and got[("za", 7)] == (True, False)
    assert not got[("gb", 8)][0]
    assert got[("us", 2)] == (False, True) and not got[("us", 8)][0] and got[("us", 9)][0]


def test_latency_costs_shadow_access(spark):
    t = spark.createDataFrame([([("retrieval", ms)],) for ms in (100, 200, 300, 2000)], "steps array<struct<step:string,ms:bigint>>")
    r = op.latency(t, {"retrieval": 1500}).first()
    assert (r.calls, r.p50, r.p95, r.over_budget, r.p95_met) == (4, 250.0, pytest.approx(1745.0), 1, False)
    costs = spark.createDataFrame([("model", "writer", 2, "1.5"), ("model", "rerank", 1, "0.25"), ("db", "store", 1, "3")], "line string, role string, qty bigint, cost string")
    got = {(r.line, r.role): float(r.cost) for r in op.cost_report(costs.withColumn("cost", F.col("cost").cast("decimal(18,6)"))).collect()}
    assert got[(None, None)] == 4.75 and got[("model", None)] == 1.75
    schema = "request_id int, results array<int>, refused boolean, ms int"
    a = spark.createDataFrame([(1, [1, 2, 3], False, 10), (2, [], True, 5)], schema)
    b = spark.createDataFrame([(1, [2, 3, 4], True, 30), (2, [], True, 5)], schema)
    assert [tuple(r) for r in op.shadow_diff(a, b).orderBy("request_id").collect()] == [(1, 0.5, True, 20), (2, 1.0, False, 0)]
    allow = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "z")], "user_id int, owner string")
    seen = spark.createDataFrame([(1, dt.datetime(2024, 5, 1)), (4, dt.datetime(2023, 1, 1))], "user_id int, ts timestamp")
    assert {r.user_id: r.finding for r in op.stale_access(allow, seen, dt.date(2024, 5, 2)).collect()} == {2: "unowned", 3: "never_used", 4: "unused"}
    p = op.sample_prompts(spark.range(500).select(F.col("id").alias("request_id"), F.lit("p").alias("prompt")), 10)
    assert p.count() == 500 and 20 < p.where("prompt IS NOT NULL").count() < 90


# --- streams --------------------------------------------------------------

EV = "event_id bigint, ts timestamp, user_id bigint, ip string"


@pytest.fixture(scope="module")
def arriving(spark, log):
    path = fresh_path(spark, "events")
    log[0].orderBy("ts").coalesce(1).write.parquet(path)
    return lambda: mo.stream_table(spark, path, EV)


def test_closed_windows_agree_with_batch(log, arriving):
    df, rows = log
    closed = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    got = mo.run_available(mo.rate_stream(arriving(), "user_id", 2, "1 hour"), "rate").collect()
    batch = df.groupBy(F.window("ts", "1 hour"), "user_id").count().where("count > 2").collect()
    assert {(r.key, r.window_start, r.n) for r in got} == {(r.user_id, r.window.start, r["count"]) for r in batch if r.window.end <= closed}
    slo = mo.run_available(mo.slo_stream(arriving().withColumn("status", F.when(F.col("user_id") == 1, 503).otherwise(200))), "slo")
    assert all(r.errors <= r.requests for r in slo.collect())


def test_sessions_agree_with_batch(log, arriving):
    df, rows = log
    closed = us(max(r[1] for r in rows)) - 600 * 1_000_000
    got = {(r.user_id, us(r.session_start), r.events) for r in mo.run_available(mo.session_stream(arriving()), "sessions").collect()}
    want = {(r.user_id, r.start_us, r.events) for r in op.session_audit(df).collect() if r.end_us + 1800 * 1_000_000 <= closed}
    assert got == want


def test_repeats_are_dropped(spark, arriving):
    twice = arriving().withColumn("request_id", F.col("event_id")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert mo.run_available(mo.dedupe_traces(twice, "1 hour"), "dedupe").count() == 600


def test_a_second_run_takes_only_new_files(spark):
    path, out, mark = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "mark")

    def drain():
        q = mo.stream_table(spark, path, "v int").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.v for r in spark.read.parquet(out).collect())

    spark.createDataFrame([(1,)], "v int").write.parquet(path)
    assert drain() == [1]
    assert drain() == [1]
    spark.createDataFrame([(2,)], "v int").write.mode("append").parquet(path)
    assert drain() == [1, 2]


def test_cache_state_agrees_with_batch(spark, arriving, log):
    from codicil.operators.understanding import cache_hits

    df, _ = log
    want = cache_hits(df.select(F.col("user_id").cast("string").alias("key"), F.lit("za").alias("jurisdiction"), "ts"), ttl_hours=2)
    path = fresh_path(spark, "folded")
    want.select("key", "us", "requests").coalesce(1).write.parquet(path)
    reqs = mo.stream_table(spark, path, "key string, us bigint, requests bigint")
    got = mo.run_available(mo.cache_stream(reqs, ttl_hours=2), "cache")
    assert {(r.key, r.us, r.misses) for r in got.collect()} == {(r.key, r.us, r.misses) for r in want.collect()}
