"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, encoding; each stage works on what the last one kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from codicil.functions.relational import drop_staged, stage, staged_paths
from codicil.llm.bpe import bpe_digests
from codicil.llm.exact_dedup import keep_one
from codicil.llm.mixing import mixed_rows
from codicil.llm.near_dedup import keep_representatives
from codicil.llm.toxicity import kept_by_score


_left: list[str] = []


def owned(step):
    """A stage whose working tables go when the next stage begins, as its result is written by then."""

    @functools.wraps(step)
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, _left, keep=docs)
        with staged_paths() as made:
            out = step(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return apply


@owned
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return kept_by_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@owned
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_one(docs)


@owned
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets."""
    return keep_representatives(docs)


@owned
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


@owned
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, similarity components and merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
