"""Quota, latency, rollout and cost tables over logs (O-01 .. O-13).

One user, address or endpoint may own a third of a log, so every step that
orders events first folds them by time slot with partial sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def breaches(events: DataFrame, key: str, window_sec: int, max_n: int) -> DataFrame:
    """O-01. Instants at which a key's count in ``(t - window, t]`` exceeds the limit.

    Events are folded per instant and placed in slots one window long, so a busy
    key is spread over its slots. A slot starts with the total of the slot before
    it; each event of that slot leaves again one window after it came. The count
    is then one running sum per slot, exact and linear in the events.
    """
    w = window_sec * MICROS
    per = (
        events.groupBy(F.col(key).alias("key"), micros().alias("us"))
        .agg(F.count("*").alias("n"))
        .withColumn("slot", F.floor(F.col("us") / w))
    )
    no_event = F.lit(None).cast("bigint")

    def move(slot: Column, us: Column, step: Column, n: Column) -> Column:
        return F.struct(slot.alias("slot"), us.alias("us"), step.alias("step"), n.alias("n"))

    n = F.col("n")
    comes = move(F.col("slot"), F.col("us"), n, n)
    leaves = move(F.col("slot") + 1, F.col("us") + w, -n, no_event)
    moves = per.select("key", F.inline(F.array(comes, leaves)))
    carried = per.groupBy("key", "slot").agg(F.sum("n").alias("step")).select(
        "key", (F.col("slot") + 1).alias("slot"), ((F.col("slot") + 1) * w - 1).alias("us"), "step", no_event.alias("n")
    )
    running = Window.partitionBy("key", "slot").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    return (
        moves.unionByName(carried)
        .withColumn("in_window", F.sum("step").over(running))
        .where(F.col("n").isNotNull() & (F.col("in_window") > max_n))
        .select("key", "us", "n", "in_window")
    )


def quota_use(events: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """O-02. Daily use per identity and endpoint against the endpoint's quota."""
    quota = F.coalesce(*[F.when(F.col("endpoint") == e, F.lit(q)) for e, q in quotas.items()], F.lit(None).cast("int"))
    return (
        events.groupBy("user_id", "endpoint", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("used"))
        .withColumn("quota", quota)
        .withColumn("over", F.coalesce(F.col("used") > F.col("quota"), F.lit(False)))
    )


def bursts(events: DataFrame, threshold: int, length_min: int = 60, step_min: int = 15) -> DataFrame:
    """O-03. Sliding windows per corpus whose count exceeds the threshold.

    Events are first counted per step, then each step joins the windows it lies in.
    """
    step = step_min * 60 * MICROS
    per = events.groupBy("corpus_id", F.floor(micros() / step).alias("step")).agg(F.count("*").alias("n"))
    back = length_min // step_min - 1
    return (
        per.withColumn("first_step", F.explode(F.sequence(F.col("step") - back, F.col("step"))))
        .groupBy("corpus_id", "first_step")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > threshold)
        .select("corpus_id", F.timestamp_micros(F.col("first_step") * step).alias("window_start"), "n")
    )


def session_audit(events: DataFrame, gap_min: int = 30) -> DataFrame:
    """O-04. Sessions per user with their events and distinct addresses.

    Events in one slot as long as the gap are always of one session, so the log
    is folded to slots with partial sums, and only slots are ordered per user:
    as many as the log is long, however many events a user has.
    """
    gap = gap_min * 60 * MICROS
    log = events.select("user_id", "ip", micros().alias("us")).withColumn("slot", F.floor(F.col("us") / gap))
    slots = log.groupBy("user_id", "slot").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("slot")
    fresh = F.coalesce((F.col("a") - F.lag("b").over(w) >= gap).cast("int"), F.lit(1))
    numbered = slots.withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(w))
    addresses = (
        log.select("user_id", "slot", "ip")
        .distinct()
        .join(numbered.select("user_id", "slot", "session_no"), ["user_id", "slot"])
        .groupBy("user_id", "session_no")
        .agg(F.countDistinct("ip").alias("addresses"))
    )
    sessions = numbered.groupBy("user_id", "session_no").agg(
        F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.sum("n").alias("events")
    )
    return sessions.join(addresses, ["user_id", "session_no"]).withColumn("replay_suspect", F.col("addresses") > 1)


def latency(traces: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """O-05. Exact p50 and p95 in milliseconds per step, with budget violations.

    Whole milliseconds are counted first, so the exact percentile runs on one
    row per distinct value.
    """
    steps = traces.select(F.explode("steps").alias("s")).select("s.step", "s.ms")
    per = steps.groupBy("step", "ms").agg(F.count("*").alias("n"))
    budget = F.coalesce(*[F.when(F.col("step") == s, F.lit(b)) for s, b in budgets.items()], F.lit(None).cast("int"))
    return (
        per.groupBy("step")
        .agg(
            F.sum("n").alias("calls"),
            F.percentile("ms", F.lit(0.5), F.col("n")).alias("p50"),
            F.percentile("ms", F.lit(0.95), F.col("n")).alias("p95"),
            F.sum(F.when(F.col("ms") > budget, F.col("n")).otherwise(0)).alias("over_budget"),
        )
        .withColumn("p95_met", F.coalesce(F.col("p95") < budget, F.lit(True)))
    )


def slo(traces: DataFrame, by: list[str]) -> DataFrame:
    """O-06. 5xx rate, availability and refusal rate per group, over (status, refused, arm)."""
    bad = (F.col("status") >= 500).cast("double")
    gone = F.col("refused").cast("double")

    def arm(name: str) -> Column:
        return F.avg(F.when(F.col("arm") == name, gone))

    return traces.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.round(F.avg(bad), 6).alias("rate_5xx"),
        F.round(1 - F.avg(bad), 6).alias("availability"),
        F.round(F.avg(gone), 6).alias("refusal_rate"),
        F.round(arm("canary") - arm("control"), 6).alias("refusal_shift"),
    )


def client_ip(requests: DataFrame, hop: int = 0) -> DataFrame:
    """O-07. Client address from the forwarding chain; a chain whose ends differ is suspect."""
    hops = F.transform(F.split(F.coalesce("xff", F.lit("")), ","), lambda h: F.trim(h))
    chain = F.filter(F.col("__h"), lambda h: h != "")
    return (
        requests.withColumn("__h", hops)
        .withColumn("__h", chain)
        .withColumns(
            {
                "client_ip": F.coalesce(F.get("__h", F.lit(hop)), F.col("ip")),
                "spoof_suspect": (F.size("__h") > 1)
                & (F.get("__h", F.lit(0)) != F.element_at("__h", F.greatest(F.size("__h"), F.lit(1)))),
            }
        )
        .withColumn("spoof_suspect", F.coalesce("spoof_suspect", F.lit(False)))
        .drop("__h")
    )


def shadow_diff(prod: DataFrame, shadow: DataFrame) -> DataFrame:
    """O-08. Result overlap, refusal change and added latency of mirrored requests.

    Both sides: (request_id, results array, refused, ms).
    """
    a = prod.select("request_id", F.col("results").alias("a"), F.col("refused").alias("ra"), F.col("ms").alias("ma"))
    b = shadow.select("request_id", F.col("results").alias("b"), F.col("refused").alias("rb"), F.col("ms").alias("mb"))
    union = F.size(F.array_union("a", "b"))
    return a.join(b, "request_id").select(
        "request_id",
        F.when(union > 0, F.round(F.size(F.array_intersect("a", "b")) / union, 6)).otherwise(F.lit(1.0)).alias("overlap"),
        (F.col("ra") != F.col("rb")).alias("refusal_changed"),
        (F.col("mb") - F.col("ma")).alias("added_ms"),
    )


def canary_bucket(request_id: str = "request_id") -> Column:
    return F.pmod(F.xxhash64(request_id), F.lit(100))


def assign_canary(requests: DataFrame, percents: dict[str, int], bucket: Column | None = None) -> DataFrame:
    """O-09. Arm per request from a stable bucket; raising a percentage only adds requests."""
    pct = F.coalesce(*[F.when(F.col("jurisdiction") == j, F.lit(p)) for j, p in percents.items()], F.lit(0))
    b = canary_bucket() if bucket is None else bucket
    return requests.withColumn("bucket", b).withColumn("arm", F.when(F.col("bucket") < pct, "canary").otherwise("control"))


def slo_window(daily: DataFrame, days: int = 7) -> DataFrame:
    """O-10. Were all checks true on each of the last ``days`` days; roll back on a breach.

    Input (jurisdiction, day, ok), one row per day; fewer days means not met.
    """
    day_no = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("jurisdiction").orderBy("day_no").rangeBetween(-(days - 1), 0)
    return (
        daily.withColumn("day_no", day_no)
        .select(
            "jurisdiction",
            "day",
            "ok",
            F.count("*").over(w).alias("present"),
            ((F.count("*").over(w) == days) & F.bool_and("ok").over(w)).alias("met"),
        )
        .withColumn("rollback", ~F.col("ok"))
    )


def cost_report(costs: DataFrame) -> DataFrame:
    """O-11. Cost and quantity by line and role, with totals."""
    return costs.rollup("line", "role").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("qty").alias("qty"), F.sum("cost").alias("cost")
    )


def sample_prompts(traces: DataFrame, pct: int, bucket: Column | None = None, prompt: str = "prompt") -> DataFrame:
    """O-12. Every trace, but the full prompt of only ``pct`` percent."""
    b = canary_bucket() if bucket is None else bucket
    return traces.withColumn("sampled", b < pct).withColumn(prompt, F.when(F.col("sampled"), F.col(prompt)))


def stale_access(allow: DataFrame, activity: DataFrame, today: dt.date, idle_days: int = 90) -> DataFrame:
    """O-13. Allowlist entries that are unowned or unused for ``idle_days``.

    ``allow`` (user_id, owner); ``activity`` (user_id, ts) is folded to the last day first.
    """
    seen = activity.where(F.to_date("ts") <= F.lit(today)).groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last_seen"))
    idle = F.datediff(F.lit(today), F.col("last_seen"))
    finding = (
        F.when(F.col("owner").isNull(), "unowned").when(F.col("last_seen").isNull(), "never_used").when(idle > idle_days, "unused")
    )
    return (
        allow.join(seen, "user_id", "left")
        .select("user_id", "last_seen", idle.alias("idle_days"), finding.alias("finding"))
        .where(F.col("finding").isNotNull())
    )
