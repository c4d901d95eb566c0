"""Quality rules and a hashed n-gram likelihood ratio, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import small_side, stage
from codicil.llm.words import BLANKS, text_of, word_array

BUCKETS = 1 << 14
#: Grams of prior mass that draw the trusted multinomial towards the raw one, so that little evidence weighs little.
PRIOR = 1000.0


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    df = df.withColumn("words", word_array(F.col("text")))
    return df.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))


def with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """Buckets of the unigrams and bigrams of a row's word codes."""
    codes = F.col("codes")
    firsts = F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0)))
    pairs = F.transform(
        firsts, lambda c, i: F.pmod(F.xxhash64(c, F.get(codes, i + 1)), F.lit(buckets)).cast("int")
    )
    single = F.transform(codes, lambda c: F.pmod(c, F.lit(buckets)).cast("int"))
    return df.withColumn("grams", F.concat(single, pairs))


def likelihood_weights(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """One row: ``weights``, the log ratio per bucket of the trusted multinomial, smoothed by the raw one, over the raw.

    With no trusted row every weight is 0, so nothing is rejected by the ratio.
    """
    marks = trusted.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("marked", F.lit(1))
    texts = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    df = texts.join(small_side(marks), "id", "left").select("text", F.coalesce("marked", F.lit(0)).cast("bigint").alias("target"))
    df = df.withColumn("words", word_array(F.col("text"))).withColumn(
        "codes", F.transform("words", lambda w: F.xxhash64(w))
    )
    grams = with_grams(df, buckets).select("target", F.explode_outer("grams").alias("bucket"))
    counts = grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    counts = stage(counts, "gram-counts")
    totals = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    share = F.col("raw") / F.col("n_raw")
    grid = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    weighed = (
        grid.join(counts, "bucket", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")
        .select(
            "bucket",
            F.when(
                (F.col("n_target") > 0) & (F.col("raw") > 0),
                F.log((F.col("target") + PRIOR * share) / (F.col("n_target") + PRIOR)) - F.log(share),
            )
            .otherwise(F.lit(0.0))
            .alias("weight"),
        )
    )
    return weighed.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda s: s["weight"]).alias("weights")
    )


def repeated_words(codes: Column) -> tuple[Column, Column]:
    """Codes of the 5-word windows, and the words that repeated windows cover."""
    n = F.size(codes)
    windows = F.when(
        n >= 5,
        F.transform(
            F.slice(codes, 1, F.greatest(n - 4, F.lit(1))),
            lambda c, i: F.xxhash64(
                c, F.get(codes, i + 1), F.get(codes, i + 2), F.get(codes, i + 3), F.get(codes, i + 4)
            ),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows, n


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    least_ratio: float = -0.15,
) -> DataFrame:
    """Base rules per row, the length-normalised log-likelihood ratio ``llr`` and the verdict ``kept``.

    ``trusted`` names the ids of the trusted-target documents. Unigrams and bigrams
    are hashed to ``buckets``; both multinomials are counted over all rows. A row
    is kept if it passes the base rules and its mean weight per gram is at least
    ``least_ratio``. No row leaves its task but for the counts.

    Null and empty texts have no words and fail the base rules. Equal rows get
    equal verdicts. With no trusted row the ratio is 0 everywhere.
    """
    weights = likelihood_weights(docs, trusted, id_col, text_col, buckets)
    df = with_grams(with_words(docs, id_col, text_col), buckets)
    text, words = F.col("text"), F.col("words")
    df = df.withColumn("one", F.lit(1)).join(F.broadcast(weights.withColumn("one", F.lit(1))), "one")
    windows, _ = repeated_words(F.col("codes"))
    df = df.withColumn("windows", windows)
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.coalesce(F.get("weights", b), F.lit(0.0)))
    df = df.select(
        "id",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("run"),
        F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)).alias("llr"),
    )
    run = F.col("run")
    twice = F.sort_array(
        F.transform(
            F.filter(
                run,
                lambda s, k: ((k > 0) & (F.get(run, k - 1)["h"] == s["h"]))
                | (F.coalesce(F.get(run, k + 1)["h"] == s["h"], F.lit(False))),
            ),
            lambda s: s["i"],
        )
    )
    df = df.withColumn("twice", twice)
    starts = F.col("twice")
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(
            (i + 5).alias("end"), (acc["n"] + F.least(F.lit(5), i + 5 - acc["end"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", covered.cast("bigint"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return df.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("llr") >= least_ratio)).alias("kept"),
        F.round("llr", 6).alias("llr"),
    )
