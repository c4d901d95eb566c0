"""Inputs of the registered queries, derived in Spark and, alike, in SQL.

The driver tables hold no law, so a *legal view* over ``documents`` plays the
corpus and per-line drafts over the same texts play the answers. Each Spark
function here has a SQL twin used by the reference side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores if it comes in fewer splits than there are cores.

    Filters and column pruning still reach the scan; a large table is read in place.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- legal view -----------------------------------------------------------

def legal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as a dated version of a section of an Act."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS chunk_id",
        "CASE lang WHEN 'en' THEN 'gb' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'ca' ELSE 'us' END AS jurisdiction",
        "source AS act",
        "CAST(CAST(FLOOR(doc_id / 60) AS INT) + 1 AS STRING) AS section_no",
        "CAST(FLOOR(doc_id / 20) AS INT) % 3 + 1 AS version",
        "CASE WHEN doc_id % 11 = 0 THEN 'repealed' WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'in_force' END AS status",
        "date_add(DATE '2020-01-01', (CAST(FLOOR(doc_id / 20) AS INT) % 3) * 365) AS effective_from",
        "date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS as_at",
        "CASE doc_id % 10 WHEN 0 THEN 'case' WHEN 1 THEN 'regulation' ELSE 'statute' END AS doc_type",
        "CAST(doc_id % 5 + 1 AS INT) AS authority_level",
        "split(text, '\n')[0] AS heading",
        "text",
        "lang",
    )


LV = r"""lv AS (
  SELECT doc_id AS chunk_id,
    CASE lang WHEN 'en' THEN 'gb' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'ca' ELSE 'us' END AS jurisdiction,
    source AS act,
    CAST(CAST(FLOOR(doc_id / 60) AS INT) + 1 AS VARCHAR) AS section_no,
    CAST(FLOOR(doc_id / 20) AS INT) % 3 + 1 AS version,
    CASE WHEN doc_id % 11 = 0 THEN 'repealed' WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'in_force' END AS status,
    CAST(DATE '2020-01-01' + (CAST(FLOOR(doc_id / 20) AS INT) % 3) * 365 AS DATE) AS effective_from,
    CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS as_at,
    CASE doc_id % 10 WHEN 0 THEN 'case' WHEN 1 THEN 'regulation' ELSE 'statute' END AS doc_type,
    CAST(doc_id % 5 + 1 AS INT) AS authority_level,
    string_split(text, chr(10))[1] AS heading,
    text, lang
  FROM documents)"""


def tok(expr: str) -> str:
    """SQL twin of ``functions.text.tokens``."""
    return rf"list_filter(regexp_split_to_array(lower({expr}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


# --- questions ------------------------------------------------------------

def questions(spark: SparkSession, sf_dir: str, scoped: bool = True) -> DataFrame:
    """Every benchmark passage as a question, with an assigned or an open jurisdiction."""
    place = (
        "CASE item_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END"
        if scoped
        else "'all'"
    )
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id", f"{place} AS jurisdiction", "text"
    )


def questions_sql(scoped: bool = True) -> str:
    place = (
        "CASE item_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'de' WHEN 2 THEN 'ca' ELSE 'us' END"
        if scoped
        else "'all'"
    )
    return f"questions AS (SELECT item_id AS query_id, {place} AS jurisdiction, text FROM benchmark)"


def open_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal view as one corpus, for unscoped runs."""
    return legal_view(spark, sf_dir).withColumn("jurisdiction", F.lit("all"))


def with_toks(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("toks", tokens(column))
