"""Dictionaries, golden sets and traces (S-07, S-08, S-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.schemas import GOLDEN, SYNONYMS

# Fields of a per-query trace. Texts of any kind are not among them; prompts and answers are sampled apart.
TRACE_FIELDS = (
    "request_id", "event_id", "query_id", "session_id", "user_id", "ts", "jurisdiction", "corpus_id", "corpus_snapshot_id",
    "event_type", "step", "attempt", "role", "intent", "question_type", "verdict", "verdicts", "refused", "reason", "reasons",
    "score", "scores", "confidence", "match_count", "tokens", "value", "ms", "timings", "status", "provider", "writer", "model",
)


def write_dict(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("jurisdiction", "dict_version").parquet(path)


def load_dict(
    spark: SparkSession, path: str, jurisdictions: list[str] | None = None, version: int | None = None, schema: str = SYNONYMS
) -> DataFrame:
    """S-07. A versioned dictionary (synonyms, thresholds, boosts): one version, else each newest."""
    df = spark.read.schema(schema).parquet(path)
    if jurisdictions is not None:
        df = df.where(F.col("jurisdiction").isin(*jurisdictions))
    if version is not None:
        return df.where(F.col("dict_version") == version)
    newest = df.groupBy("jurisdiction").agg(F.max("dict_version").alias("dict_version"))
    return df.join(newest, ["jurisdiction", "dict_version"], "left_semi")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """S-08. Golden questions from JSON lines; malformed rows fail the read."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def without_bodies(df: DataFrame, allowed: tuple[str, ...] = TRACE_FIELDS) -> DataFrame:
    """The columns that a trace may hold; any other, known or new, is left out."""
    return df.select(*[c for c in df.columns if c in allowed])


def write_trace(df: DataFrame, path: str, allowed: tuple[str, ...] = TRACE_FIELDS) -> None:
    """S-09. Append traces by day; only ``allowed`` fields are written, so no body, prompt or answer can slip in."""
    (
        without_bodies(df, allowed)
        .withColumn("day", F.to_date("ts"))
        .hint("rebalance", "day")
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


__all__ = ["write_dict", "load_dict", "read_golden", "without_bodies", "write_trace"]
