"""Evaluation metrics, reports and gates (E-01 .. E-16 and O-16).

Shapes: qrels (query_id, chunk_id), run (query_id, chunk_id, rank), metrics
(run_id, jurisdiction, tag, metric, value). An empty denominator gives null,
which no gate accepts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.relational import join_hot, small_side, stage
from codicil.functions.text import shingles, tokens


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6))


def passage_qrels(docs: DataFrame, passages: DataFrame, width: int = 5) -> DataFrame:
    """Relevant pairs: the document's token run contains the passage's token run.

    Each passage is anchored by its first ``width`` tokens (all, if shorter). The
    documents' shingles, without the texts, meet the anchors in an equi-join; the
    whole passage is then checked in the documents of the pairs that met.
    """
    asked = (
        passages.select("query_id", tokens("text").alias("p_toks"))
        .where(F.size("p_toks") > 0)
        .withColumn("w", F.least(F.size("p_toks"), F.lit(width)))
        .withColumn("anchor", F.array_join(F.slice("p_toks", 1, F.col("w")), " "))
        .withColumn("needle", F.concat(F.lit(" "), F.array_join("p_toks", " "), F.lit(" ")))
    )
    held = docs.select("chunk_id", tokens("text").alias("toks"))
    widths = sorted(r[0] for r in asked.select("w").distinct().collect())
    runs = F.flatten(F.array(*[shingles(F.col("toks"), w) for w in widths or [width]]))
    met = held.select("chunk_id", F.explode_outer(F.array_distinct(runs)).alias("anchor"))
    anchors = asked.select("query_id", "anchor")
    pairs = stage(
        join_hot(met.where(F.col("anchor").isNotNull()), anchors, ["anchor"], "chunk_id").select("query_id", "chunk_id"),
        "anchored",
    )
    hay = F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))
    return (
        held.join(small_side(pairs), "chunk_id")
        .join(small_side(asked.select("query_id", "needle")), "query_id")
        .where(F.contains(hay, F.col("needle")))
        .select("query_id", "chunk_id")
    )


def judged(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """Relevant items with the rank the run gave them, null if it missed them."""
    return qrels.join(run.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")


def per_query(qrels: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """Recall at ``k`` and reciprocal rank per query with at least one relevant item."""
    return judged(qrels, run).groupBy("query_id").agg(
        (F.count_if(F.col("rank") <= k) / F.count("*")).alias("recall"),
        F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"),
    )


def recall_at_k(qrels: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """E-01. Macro recall at ``k``."""
    return per_query(qrels, run, k).agg(
        F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall")
    )


def mrr(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """E-02. Mean reciprocal rank."""
    return per_query(qrels, run).agg(F.count("*").alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"))


def leakage(run: DataFrame, by: list[str] | None = None) -> DataFrame:
    """E-03. Share of returned excerpts from another jurisdiction than the query's."""
    return run.groupBy(*(by or [])).agg(
        F.count("*").alias("returned"),
        F.count_if(F.col("excerpt_jurisdiction") != F.col("jurisdiction")).alias("leaked"),
        ratio(
            F.count_if(F.col("excerpt_jurisdiction") != F.col("jurisdiction")), F.count("*")
        ).alias("leakage"),
    )


def refusal_correctness(golden: DataFrame, out: DataFrame) -> DataFrame:
    """E-04. Must-refuse recall (the gate) and false-refusal rate, per jurisdiction.

    A golden question without an output counts as not refused.
    """
    both = golden.join(out.select("query_id", "refused"), "query_id", "left").withColumn(
        "refused", F.coalesce("refused", F.lit(False))
    )
    must, did = F.col("must_refuse"), F.col("refused")
    return both.groupBy("jurisdiction").agg(
        F.count_if(must & did).alias("right_refusals"),
        F.count_if(must & ~did).alias("missed_refusals"),
        F.count_if(~must & did).alias("false_refusals"),
        F.count_if(~must & ~did).alias("answered"),
        ratio(F.count_if(must & did), F.count_if(must)).alias("refusal_recall"),
        ratio(F.count_if(~must & did), F.count_if(~must)).alias("false_refusal_rate"),
    )


def rate(df: DataFrame, good: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """E-05, E-06, E-07. Share of rows for which ``good`` holds, with its counts."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("checked"),
        F.count_if(good).alias("held"),
        ratio(F.count_if(good), F.count("*")).alias(name),
    )


def eval_matrix(scored: DataFrame) -> DataFrame:
    """E-08. Means per (jurisdiction, tag), per jurisdiction, and overall."""
    return (
        scored.rollup("jurisdiction", "tag")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count("*").alias("queries"),
            F.round(F.avg("recall"), 6).alias("recall"),
            F.round(F.avg("rr"), 6).alias("mrr"),
        )
    )


def eval_delta(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """E-09. Old against new value per key; regressed, improved, same, or only in one."""
    old = a.select(*keys, F.col("value").alias("old_value"))
    new = b.select(*keys, F.col("value").alias("new_value"))
    delta = F.col("new_value") - F.col("old_value")
    return old.join(new, keys, "full_outer").select(
        *keys,
        "old_value",
        "new_value",
        F.round(delta, 6).alias("delta"),
        F.when(F.col("old_value").isNull(), "added")
        .when(F.col("new_value").isNull(), "missing")
        .when(delta < -eps, "regressed")
        .when(delta > eps, "improved")
        .otherwise("same")
        .alias("change"),
    )


# Metric, direction, bound.
PROFILES = {
    "ci": [
        ("leakage", "max", 0.0),
        ("refusal_recall", "min", 1.0),
        ("citation_validity", "min", 1.0),
    ],
    "release": [
        ("leakage", "max", 0.0),
        ("refusal_recall", "min", 1.0),
        ("citation_validity", "min", 1.0),
        ("invented_rate", "max", 0.0),
        ("entail_rate", "min", 0.95),
    ],
}
RELEASE_RECALL = {"za": 0.85, "gb": 0.80}


def _each_expected(found: DataFrame, expected: Sequence[str] | None) -> DataFrame:
    """The rows of a report with one row of nulls for each expected jurisdiction that has none."""
    if expected is None:
        return found
    places = found.sparkSession.createDataFrame([(p,) for p in sorted(set(expected))], "jurisdiction string")
    return found.join(places, "jurisdiction", "full")


def gate(metrics: DataFrame, profile: str = "ci", expected: Sequence[str] | None = None) -> DataFrame:
    """E-10. Per jurisdiction: does every bound of the profile hold, and which fail.

    Input (jurisdiction, metric, value). A bound whose metric is absent or null fails;
    of a jurisdiction that is ``expected`` and has no metric at all, every bound does.
    """
    values = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
    wide = metrics.where(F.col("metric").isin(*[m for m, _, _ in PROFILES["release"]], "recall")).groupBy(
        "jurisdiction"
    ).agg(values.alias("v"))
    wide = _each_expected(wide, expected)
    checks = [
        (m, (F.col("v")[m] <= bound) if way == "max" else (F.col("v")[m] >= bound))
        for m, way, bound in PROFILES[profile]
    ]
    if profile == "release":
        bar = F.coalesce(
            *[F.when(F.col("jurisdiction") == j, F.lit(v)) for j, v in RELEASE_RECALL.items()], F.lit(None).cast("double")
        )
        checks.append(("recall", bar.isNull() | (F.col("v")["recall"] >= bar)))
    failing = F.array_sort(
        F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in checks]))
    )
    return wide.select("jurisdiction", failing.alias("failing")).select(
        "jurisdiction", (F.size("failing") == 0).alias("passed"), "failing"
    )


def sweep(scored: DataFrame, grid: list[float]) -> DataFrame:
    """E-11. Precision and false refusals per jurisdiction and threshold.

    ``scored`` holds one row per query (jurisdiction, score, relevant). The short
    grid is an array literal, folded per row and aggregated in one pass.
    """
    on = F.col("score") >= F.col("threshold")
    rel = F.col("relevant")
    return (
        scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
        .groupBy("jurisdiction", "threshold")
        .agg(
            F.count_if(on).alias("answered"),
            F.count_if(on & rel).alias("answered_right"),
            F.count_if(~on & rel).alias("false_refusals"),
        )
        .withColumn("precision", ratio(F.col("answered_right"), F.col("answered")))
    )


def best_threshold(swept: DataFrame) -> DataFrame:
    """Threshold with the most right answers less wrong ones; the lowest of equals."""
    gain = 2 * F.col("answered_right") - F.col("answered")
    return swept.groupBy("jurisdiction").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("threshold")).alias("t"))).alias("top")
    ).select("jurisdiction", (-F.col("top.t")).alias("threshold"), F.col("top.gain").alias("gain"))


def golden_quota(golden: DataFrame, quota: dict[str, int], expected: Sequence[str] | None = None) -> DataFrame:
    """E-12. Counts per jurisdiction against quotas (keys total, must_refuse, trap).

    An ``expected`` jurisdiction without golden rows counts 0 and is short of every quota.
    """
    counts = golden.groupBy("jurisdiction").agg(
        F.count("*").alias("total"),
        F.count_if("must_refuse").alias("must_refuse"),
        F.count_if(F.array_contains("tags", "trap")).alias("trap"),
    )
    counts = _each_expected(counts, expected).fillna(0, ["total", "must_refuse", "trap"])
    short = F.array_compact(F.array(*[F.when(F.col(n) < q, F.lit(n)) for n, q in sorted(quota.items())]))
    return counts.withColumn("short", short).withColumn("met", F.size("short") == 0)


def misses(qrels: DataFrame, run: DataFrame, k: int = 10) -> DataFrame:
    """E-13. Relevant items absent from the first ``k``, with the rank of a near miss."""
    return (
        judged(qrels, run)
        .where(F.col("rank").isNull() | (F.col("rank") > k))
        .select("query_id", "chunk_id", F.col("rank").alias("near_miss_rank"))
    )


def by_language(scored: DataFrame) -> DataFrame:
    """E-14. Mean per language and its distance from the overall mean."""
    per = scored.groupBy("lang").agg(F.count("*").alias("n"), F.sum("recall").alias("s"))
    everything = Window.partitionBy(F.lit(1))  # one row per language
    return per.select(
        "lang",
        "n",
        F.round(F.col("s") / F.col("n"), 6).alias("recall"),
        F.round(F.col("s") / F.col("n") - F.sum("s").over(everything) / F.sum("n").over(everything), 6).alias(
            "vs_overall"
        ),
    )


def streak(nightly: DataFrame, n: int = 5) -> DataFrame:
    """E-15. Runs of green nights per jurisdiction; a missing night breaks a run.

    Input is one row per (jurisdiction, night, green).
    """
    w = Window.partitionBy("jurisdiction").orderBy("night")
    island = F.date_sub("night", F.row_number().over(w))
    return (
        nightly.where("green")
        .withColumn("island", island)
        .groupBy("jurisdiction", "island")
        .agg(F.min("night").alias("first_night"), F.max("night").alias("last_night"), F.count("*").alias("nights"))
        .drop("island")
        .withColumn("met", F.col("nights") >= n)
    )


def regression_alerts(nightly: DataFrame) -> DataFrame:
    """E-15. Nights that turned red after a green one."""
    w = Window.partitionBy("jurisdiction").orderBy("night")
    return (
        nightly.withColumn("was_green", F.lag("green").over(w))
        .where(~F.col("green") & F.col("was_green"))
        .select("jurisdiction", "night")
    )


def eval_trend(daily: DataFrame) -> DataFrame:
    """O-16. Daily value with its change and a moving mean over seven present days."""
    w = Window.partitionBy("metric").orderBy("day")
    return daily.select(
        "metric",
        "day",
        "value",
        F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"),
        F.round(F.avg("value").over(w.rowsBetween(-6, 0)), 6).alias("mean7"),
    )
