"""Registered queries for operations, rollout and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from codicil.functions.relational import fresh_path, stage
from codicil.operators import evaluation as ev
from codicil.operators import operations as op
from codicil.operators import retrieval as rt
from codicil.plans import corpus_queries as cq
from codicil.plans import grounding_queries as gq
from codicil.plans import retrieval_queries as rq
from codicil.plans.inputs import LV, questions, table
from codicil.plans.registry import register, with_
from codicil.schemas import EVENTS, PAGES
from codicil.streaming import monitors as mo

PLACE = "CASE user_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END"


def events(spark, sf):
    return table(spark, sf, "events")


def stream(spark, sf):
    # A pattern, since a table may be one file and the file source wants a folder or a pattern.
    return mo.event_time(mo.stream_table(spark, f"{sf}/events.parque[t]", EVENTS))


@register("o01_breaches", """WITH per AS (SELECT user_id AS key, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY ALL),
  w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM per)
  SELECT * FROM w WHERE in_window > 1""")
def breaches(spark, sf):
    return op.breaches(events(spark, sf), "user_id", 3600, 1)


@register("o02_quota_use", """WITH u AS (SELECT user_id, event_type AS endpoint, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY ALL),
  q AS (SELECT *, CASE endpoint WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS quota FROM u) SELECT *, coalesce(used > quota, false) AS over FROM q""")
def quota(spark, sf):
    return op.quota_use(events(spark, sf).withColumn("endpoint", F.col("event_type")), {"click": 1, "purchase": 2})


@register("o03_bursts", """WITH per AS (SELECT event_type AS corpus_id, epoch_us(ts) // 900000000 AS step, count(*) AS n FROM events GROUP BY ALL),
  w AS (SELECT corpus_id, step - b AS first_step, CAST(sum(n) AS BIGINT) AS n FROM per, (SELECT unnest([0, 1, 2, 3]) AS b) GROUP BY ALL)
  SELECT corpus_id, make_timestamp(first_step * 900000000) AS window_start, n FROM w WHERE n > 2""")
def bursts(spark, sf):
    found = op.bursts(events(spark, sf).withColumn("corpus_id", F.col("event_type")), 2)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


SESSIONS = """WITH e AS (SELECT user_id, epoch_us(ts) AS us, '10.0.' || CAST(event_id % 3 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS ip FROM events),
  l AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM e),
  s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS session_no FROM l)
  SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(us) AS start_us, max(us) AS end_us, count(*) AS events, count(DISTINCT ip) AS addresses, count(DISTINCT ip) > 1 AS replay_suspect
  FROM s GROUP BY user_id, session_no"""


@register("o04_session_audit", SESSIONS)
def sessions(spark, sf):
    ip = "'10.0.' || CAST(event_id % 3 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS ip"
    return op.session_audit(events(spark, sf).selectExpr("user_id", "ts", ip))


STEPS = ("understanding", "retrieval", "writer", "verifier")
BUDGETS = {"understanding": 300, "retrieval": 1500, "writer": 4000, "verifier": 1500}


@register("o05_latency", """WITH s AS (SELECT unnest([{step: 'understanding', ms: CAST(round(value * 5) AS BIGINT)}, {step: 'retrieval', ms: CAST(round(value * 10) AS BIGINT)},
     {step: 'writer', ms: CAST(round(value * 15) AS BIGINT)}, {step: 'verifier', ms: CAST(round(value * 20) AS BIGINT)}]) AS s FROM events),
  f AS (SELECT s.step AS step, s.ms AS ms, CASE s.step WHEN 'understanding' THEN 300 WHEN 'writer' THEN 4000 ELSE 1500 END AS b FROM s)
  SELECT step, count(*) AS calls, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, count(*) FILTER (WHERE ms > b) AS over_budget, quantile_cont(ms, 0.95) < any_value(b) AS p95_met FROM f GROUP BY step""")
def latency(spark, sf):
    steps = F.array(*[F.struct(F.lit(s).alias("step"), F.round(F.col("value") * 5 * (i + 1)).cast("bigint").alias("ms")) for i, s in enumerate(STEPS)])
    return op.latency(events(spark, sf).select(steps.alias("steps")), BUDGETS)


@register("o06_slo", f"""WITH t AS (SELECT CAST(ts AS DATE) AS day, {PLACE} AS jurisdiction, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status, value < 1 AS refused, event_id % 100 < 10 AS canary FROM events)
  SELECT day, count(*) AS requests, round(avg((status >= 500)::INT::DOUBLE), 6) AS rate_5xx, round(1 - avg((status >= 500)::INT::DOUBLE), 6) AS availability, round(avg(refused::INT::DOUBLE), 6) AS refusal_rate,
   round(avg(refused::INT::DOUBLE) FILTER (WHERE canary) - avg(refused::INT::DOUBLE) FILTER (WHERE NOT canary), 6) AS refusal_shift FROM t GROUP BY day""")
def slo(spark, sf):
    return op.slo(trace_rows(spark, sf), ["day"])


def trace_rows(spark, sf):
    rows = events(spark, sf).selectExpr(
        "event_id AS request_id", "CAST(ts AS DATE) AS day", "ts", f"{PLACE} AS jurisdiction",
        "CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status", "value < 1 AS refused", "value AS ms",
    )
    return op.assign_canary(rows, {"gb": 10, "de": 10, "ca": 10, "us": 10}, F.col("request_id") % 100)


XFF = "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN '6.6.6.6, 10.1.' || CAST(user_id AS {s}) || '.1' ELSE '10.1.' || CAST(user_id AS {s}) || '.1' END"


@register("o07_client_ip", f"""WITH x AS (SELECT event_id, '10.9.9.' || CAST(user_id % 200 AS VARCHAR) AS ip, {XFF.format(s='VARCHAR')} AS xff FROM events),
  h AS (SELECT *, list_filter(list_transform(string_split(xff, ','), lambda t: trim(t)), lambda t: t <> '') AS hops FROM x)
  SELECT event_id, coalesce(hops[1], ip) AS client_ip, coalesce(len(hops) > 1 AND hops[1] <> hops[-1], false) AS spoof_suspect FROM h""")
def client(spark, sf):
    rows = events(spark, sf).selectExpr("event_id", "'10.9.9.' || CAST(user_id % 200 AS STRING) AS ip", f"{XFF.format(s='STRING')} AS xff")
    return op.client_ip(rows).select("event_id", "client_ip", "spoof_suspect")


@register("o08_shadow_diff", with_(LV, rq.Q_SCOPED, rq.CHUNKS_SCOPED, rq.BM25.strip(), rq.BOOSTED.format(src="bm25"),
   """a AS (SELECT query_id, list(chunk_id) AS a, max(score) AS ma FROM bm25 WHERE rank <= 10 GROUP BY ALL), b AS (SELECT query_id, list(chunk_id) AS b, max(score) AS mb FROM boosted WHERE rank <= 10 GROUP BY ALL)""",
   body="""SELECT query_id AS request_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap, (ma < 20) <> (mb < 20) AS refusal_changed, round(mb - ma, 6) AS added_ms FROM a JOIN b USING (query_id)"""))
def shadow(spark, sf):
    chunks = rq.scoped_chunks(spark, sf)
    prod = stage(rt.bm25(chunks, questions(spark, sf)), "prod")
    facts = chunks.select("chunk_id", "act", "section_no", "authority_level", "doc_type")
    tuned = rt.boost(facts.join(prod, "chunk_id"), rq.soft_boosts())

    def packed(run):
        top = run.where("rank <= 10").groupBy(F.col("query_id").alias("request_id"))
        return top.agg(F.collect_list("chunk_id").alias("results"), F.max("score").alias("ms")).withColumn("refused", F.col("ms") < 20)

    return op.shadow_diff(packed(prod), packed(tuned)).withColumn("added_ms", F.round("added_ms", 6))


@register("o09_assign_canary", f"""WITH e AS (SELECT event_id, {PLACE} AS jurisdiction, event_id % 100 AS bucket FROM events)
  SELECT *, CASE WHEN bucket < CASE jurisdiction WHEN 'gb' THEN 10 WHEN 'de' THEN 50 WHEN 'ca' THEN 100 ELSE 0 END THEN 'canary' ELSE 'control' END AS arm FROM e""")
def canary(spark, sf):
    rows = events(spark, sf).selectExpr("event_id", f"{PLACE} AS jurisdiction")
    return op.assign_canary(rows, {"gb": 10, "de": 50, "ca": 100}, F.col("event_id") % 100)


DAILY = f"""daily AS (SELECT {PLACE} AS jurisdiction, CAST(ts AS DATE) AS day, avg((event_type = 'error')::INT::DOUBLE) < 0.25 AS ok FROM events GROUP BY ALL)"""


def daily(spark, sf):
    return events(spark, sf).groupBy(F.expr(PLACE).alias("jurisdiction"), F.to_date("ts").alias("day")).agg(
        (F.avg((F.col("event_type") == "error").cast("double")) < 0.25).alias("ok")
    )


@register("o10_slo_window", with_(DAILY, body="""SELECT jurisdiction, day, ok, count(*) OVER w AS present, count(*) OVER w = 7 AND bool_and(ok) OVER w AS met, NOT ok AS rollback FROM daily
  WINDOW w AS (PARTITION BY jurisdiction ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""))
def slo_window(spark, sf):
    return op.slo_window(daily(spark, sf))


@register("o11_cost_report", """SELECT l_returnflag AS line, l_linestatus AS role, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INT) AS level, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
   CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6))) AS DOUBLE) AS cost FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def costs(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS line", "l_linestatus AS role", "CAST(l_quantity AS BIGINT) AS qty", "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6)) AS cost"
    )
    return op.cost_report(rows).withColumn("cost", F.col("cost").cast("double"))


@register("o12_sample_prompts", "SELECT event_id, event_id % 100 < 5 AS sampled, CASE WHEN event_id % 100 < 5 THEN props END AS prompt FROM events")
def prompts(spark, sf):
    return op.sample_prompts(events(spark, sf).select("event_id", F.col("props").alias("prompt")), 5, F.col("event_id") % 100).select("event_id", "sampled", "prompt")


TODAY = dt.date(1998, 7, 1)


@register("o13_stale_access", """WITH seen AS (SELECT o_custkey AS user_id, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-07-01' GROUP BY ALL),
  a AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal >= 0 THEN c_name END AS owner FROM customer),
  f AS (SELECT user_id, last_seen, date_diff('day', last_seen, DATE '1998-07-01') AS idle_days, CASE WHEN owner IS NULL THEN 'unowned' WHEN last_seen IS NULL THEN 'never_used' WHEN date_diff('day', last_seen, DATE '1998-07-01') > 90 THEN 'unused' END AS finding FROM a LEFT JOIN seen USING (user_id))
  SELECT user_id, last_seen, CAST(idle_days AS INT) AS idle_days, finding FROM f WHERE finding IS NOT NULL""")
def stale(spark, sf):
    allow = table(spark, sf, "customer").selectExpr("c_custkey AS user_id", "CASE WHEN c_acctbal >= 0 THEN c_name END AS owner")
    return op.stale_access(allow, table(spark, sf, "orders").selectExpr("o_custkey AS user_id", "o_orderdate AS ts"), TODAY)


@register("e15_streak", with_(DAILY, """g AS (SELECT jurisdiction, day, day - CAST(row_number() OVER (PARTITION BY jurisdiction ORDER BY day) AS INT) AS island FROM daily WHERE ok)""",
   body="SELECT jurisdiction, min(day) AS first_night, max(day) AS last_night, count(*) AS nights, count(*) >= 5 AS met FROM g GROUP BY jurisdiction, island"))
def streak(spark, sf):
    return ev.streak(daily(spark, sf).select("jurisdiction", F.col("day").alias("night"), F.col("ok").alias("green")))


@register("e15_regression_alerts", with_(DAILY, "p AS (SELECT *, lag(ok) OVER (PARTITION BY jurisdiction ORDER BY day) AS was FROM daily)",
   body="SELECT jurisdiction, day AS night FROM p WHERE NOT ok AND was"))
def alerts(spark, sf):
    return ev.regression_alerts(daily(spark, sf).select("jurisdiction", F.col("day").alias("night"), F.col("ok").alias("green")))


@register("o16_eval_trend", """WITH d AS (SELECT event_type AS metric, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL)
  SELECT metric, day, value, round(value - lag(value) OVER w, 6) AS change, round(avg(value) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7
  FROM d WINDOW w AS (PARTITION BY metric ORDER BY day)""")
def trend(spark, sf):
    per = events(spark, sf).groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day"))
    return ev.eval_trend(per.agg(F.round(F.avg("value"), 6).alias("value")))


# Streams ------------------------------------------------------------------

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@register("s03_stream_raw", with_(cq.RAW_SQL, body="SELECT jurisdiction, count(*) AS sources, CAST(sum(length(body)) AS BIGINT) AS chars FROM raw GROUP BY jurisdiction"))
def stream_raw(spark, sf):
    arriving = mo.stream_table(spark, f"{sf}/pages.parque[t]", PAGES)
    landed = mo.run_available(arriving.withColumn("jurisdiction", F.expr(cq.PLACE)), "raw_stream", by=["jurisdiction"])
    return landed.groupBy("jurisdiction").agg(F.count("*").alias("sources"), F.sum(F.length("html")).alias("chars"))


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@register("o14_slo_stream", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events
  GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {CLOSED}""")
def slo_stream(spark, sf):
    rows = stream(spark, sf).select("ts", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))
    return ntz(mo.run_available(mo.slo_stream(rows), "slo_stream"), "window_start")


@register("o01_rate_stream", f"""SELECT user_id AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events
  GROUP BY ALL HAVING count(*) > 1 AND time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {CLOSED}""")
def rate_stream(spark, sf):
    return ntz(mo.run_available(mo.rate_stream(stream(spark, sf).select("ts", "user_id"), "user_id", 1, "1 hour"), "rate_stream"), "window_start")


@register("o03_burst_stream", f"""WITH w AS (SELECT event_type AS corpus_id, make_timestamp((epoch_us(ts) // 900000000 - b) * 900000000) AS window_start FROM events, (SELECT unnest([0, 1, 2, 3]) AS b))
  SELECT corpus_id, window_start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 2 AND window_start + INTERVAL 1 HOUR <= {CLOSED}""")
def burst_stream(spark, sf):
    rows = stream(spark, sf).select("ts", F.col("event_type").alias("corpus_id"))
    return ntz(mo.run_available(mo.burst_stream(rows, 2), "burst_stream"), "window_start")


@register("o04_session_stream", f"""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
  s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM l)
  SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTES <= {CLOSED}""")
def session_stream(spark, sf):
    return ntz(mo.run_available(mo.session_stream(stream(spark, sf).select("ts", "user_id")), "session_stream"), "session_start")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@register("q07_cache_stream", gq.CACHE + "SELECT key, us, requests, misses FROM hits")
def cache_stream(spark, sf):
    folded = gq.requests(spark, sf).groupBy("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).agg(F.count("*").alias("requests"))
    path = fresh_path(spark, "folded")
    folded.write.parquet(path)
    former = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # arbitrary state needs it; put back once the stream is drained
    try:
        return mo.run_available(mo.cache_stream(mo.stream_table(spark, path, "key string, us bigint, requests bigint")), "cache")
    finally:
        spark.conf.set(PROVIDER, former)


@register("o15_dedupe_traces", "SELECT DISTINCT event_id AS request_id FROM events")
def dedupe(spark, sf):
    rows = stream(spark, sf).select(F.col("event_id").alias("request_id"), "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    return mo.run_available(mo.dedupe_traces(rows), "dedupe").select("request_id")
