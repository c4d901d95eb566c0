"""Corpus gates and audits (C-01 .. C-09). A corpus is named by ``corpus_id``."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.relational import small_side
from codicil.operators.ingest import parent_context


def missing_smoke(chunks: DataFrame, smoke: DataFrame) -> DataFrame:
    """C-01. Required sections a corpus lacks.

    The corpus is folded to its distinct sections (map-side first) before the join.
    """
    held = chunks.select("corpus_id", "section_no").distinct()
    return smoke.join(held, ["corpus_id", "section_no"], "left_anti")


def manifest_check(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """C-02. Counts against the manifest; a corpus on one side only fails."""
    held = chunks.groupBy("corpus_id").agg(F.count("*").alias("actual_count"))
    return (
        manifest.select("corpus_id", "expected_count")
        .join(held, "corpus_id", "full_outer")
        .withColumn("matches", F.coalesce(F.col("expected_count") == F.col("actual_count"), F.lit(False)))
    )


def null_audit(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """C-03. Nulls per audited column; an open end is a fault only before a later version.

    Expects ``next_version`` (null on the current version) when ``effective_to`` is audited.
    """
    def fault(c: str):
        bad = F.col(c).isNull()
        return bad & F.col("next_version").isNotNull() if c == "effective_to" else bad

    return chunks.groupBy("corpus_id").agg(
        F.count("*").alias("rows"), *[F.count_if(fault(c)).alias(f"null_{c}") for c in columns]
    )


def context_check(chunks: DataFrame) -> DataFrame:
    """C-04. Every chunk whose text does not start with its parent context."""
    return chunks.where(~F.startswith(F.col("text"), parent_context()))


def ingestion_gate(corpora: DataFrame, *failures: DataFrame) -> DataFrame:
    """C-05. Pass or fail per corpus with its sorted reasons.

    ``corpora`` (corpus_id) lists all; each failure frame is (corpus_id, reason).
    """
    pooled = corpora.select("corpus_id", F.lit(None).cast("string").alias("reason")).distinct()
    for failure in failures:
        pooled = pooled.unionByName(failure.select("corpus_id", "reason").distinct())
    return (
        pooled.groupBy("corpus_id")
        .agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
        .select("corpus_id", (F.size("reasons") == 0).alias("passed"), "reasons")
    )


def coverage_gaps(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """C-06. What was wanted and is not held."""
    return wanted.join(held.select(*keys).distinct(), keys, "left_anti")


def hmac_sha256(message, key: bytes):
    """Keyed digest of a string column (RFC 2104 over SHA-256)."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def sign_manifest(chunks: DataFrame, key: bytes, parts: list[str]) -> DataFrame:
    """C-07. Order-free content digest, snapshot id and signature per corpus.

    Each row's SHA-256 is read as four integers and summed per lane in exact
    decimals, so the digest is a plain sum: combined map-side, any size, no list.
    A field is signed with its length, and a null has a mark of its own, so no two
    rows that differ are signed alike.
    """
    texts = [F.col(p).cast("string") for p in parts]
    fields = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    row = F.sha2(F.concat_ws(",", *fields), 256)
    hashed = chunks.select("corpus_id", row.alias("h"))
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"lane{i}") for i in range(4)
    ]
    sums = hashed.groupBy("corpus_id").agg(F.count("*").alias("rows"), *lanes)
    body = F.concat_ws(":", "corpus_id", F.col("rows").cast("string"), *[F.col(f"lane{i}").cast("string") for i in range(4)])
    return (
        sums.withColumn("digest", F.sha2(body, 256))
        .withColumn("corpus_snapshot_id", F.concat_ws("-", "corpus_id", F.substring("digest", 1, 16)))
        .withColumn("signature", hmac_sha256(F.col("digest"), key))
        .select("corpus_id", "rows", "digest", "corpus_snapshot_id", "signature")
    )


def read_pinned(chunks: DataFrame, pins: DataFrame) -> DataFrame:
    """C-08. Exactly the pinned snapshot of each jurisdiction (prunes partitions at run time)."""
    return chunks.join(small_side(pins), ["jurisdiction", "snapshot_id"], "left_semi")


def ingest_timings(log: DataFrame) -> DataFrame:
    """C-09. First and last step and the time between, per corpus."""
    return log.groupBy("corpus_id").agg(
        F.count("*").alias("steps"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("micros"),
    )
