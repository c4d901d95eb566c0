"""Corpus sources and sinks (S-01, S-02, S-04, S-05, S-06)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codicil.functions.relational import small_side
from codicil.schemas import RAW


def read_raw(
    spark: SparkSession,
    path: str,
    jurisdictions: list[str] | None = None,
    years: list[int] | None = None,
    schema: str = RAW,
) -> DataFrame:
    """S-01. Raw sources; the jurisdiction is a directory, so others are not listed."""
    df = spark.read.schema(schema).parquet(path)
    if jurisdictions is not None:
        df = df.where(F.col("jurisdiction").isin(*jurisdictions))
    if years is not None:
        df = df.where(F.col("year").isin(*years))
    return df


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """S-01. Raw text or HTML files under ``jurisdiction=`` directories, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        "jurisdiction", F.col("_metadata.file_path").alias("url"), F.col("value").alias("body")
    )


def read_corpora(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """S-02. All corpora through one path; a column one lacks is null there."""
    every = None
    for corpus_id, path in paths.items():
        one = spark.read.parquet(path).withColumn("corpus_id", F.lit(corpus_id))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return every


def snapshot(df: DataFrame, path: str, snapshot_id: str, by: str = "jurisdiction") -> str:
    """S-04. Write an immutable snapshot; fails if the id was already written.

    The rebalance hint sizes files per jurisdiction and splits a large one.
    """
    target = f"{path}/snapshot_id={snapshot_id}"
    df.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(target)
    return target


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """S-05. Rows of ``new`` replace those of ``old`` by key; twice equals once.

    Null keys are equal to each other. A key that ``new`` holds twice is refused.
    Only the keys of ``new`` meet ``old``, so a small delta is broadcast by its
    real size and the old texts are not moved.
    """
    if not new.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated keys in the new rows: {key}")
    named = new.select(*[F.col(k).alias(f"__new_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__new_{k}")) for k in key]
    kept = old.join(named, same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def content_address(df: DataFrame) -> str:
    """Digest of a table's columns and rows; order and partitioning do not count, repeated rows do."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)), *lanes).first()
    kinds = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    return hashlib.sha256("|".join([kinds, *map(str, sums)]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class _Log:
    """Numbered entries of a commit log; an entry is created exclusively, so two publishers never share a number."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._folder = self._path(folder)
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(self._folder) if f.getPath().getName().isdigit())

    def append(self) -> int:
        """Claim the next number."""
        number = (self.entries() or [0])[-1] + 1
        while not self._files.createNewFile(self._path(self._folder, f"{number:012d}")):
            number += 1
        return number


def publish(snapshot_df: DataFrame, gate: DataFrame, root: str, snapshot_id: str) -> DataFrame:
    """S-06. Stage a snapshot, then point readers to it for the corpora that pass.

    ``gate`` is (corpus_id, passed, reasons), and this call's gate alone decides.
    Staging lies under the digest of its content, so no publish can change what an
    earlier one shows, and a repeated one writes nothing twice. The decisions are
    written next; last, one entry of the commit log is created exclusively and names
    them. A run that ends before that shows nothing to readers. A blocked corpus
    keeps its former snapshot. Returns the decisions.
    """
    spark = snapshot_df.sparkSession
    content = f"c{content_address(snapshot_df)}"
    staged = f"{root}/staging/content={content}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        snapshot_df.hint("rebalance", "corpus_id").write.mode("overwrite").partitionBy("corpus_id").parquet(staged)
    decided = gate.withColumns({"snapshot_id": F.lit(snapshot_id), "content": F.lit(content)})
    attempt = f"{root}/decisions/attempt=a{uuid.uuid4().hex}"
    decided.write.parquet(attempt)
    number = _Log(spark, f"{root}/numbers").append()
    entry = spark.createDataFrame([(number, attempt.rsplit("=", 1)[1])], "number bigint, attempt string")
    entry.coalesce(1).write.parquet(f"{root}/log/entry={number:012d}")
    return spark.read.schema(decided.schema).parquet(attempt).drop("content")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The commit log as a table: corpus_id, passed, snapshot_id, content and the number of the publish."""
    if not _exists(spark, f"{root}/log"):
        raise ValueError(f"nothing was published under {root}")
    log = spark.read.schema("number bigint, attempt string").parquet(f"{root}/log").select("number", "attempt")
    made = spark.read.option("mergeSchema", "true").parquet(f"{root}/decisions")
    return made.select("corpus_id", "passed", "snapshot_id", "content", "attempt").join(log, "attempt")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot of each corpus that passed last. Only the folders of live content are read."""
    live = (
        published(spark, root)
        .where("passed")
        .groupBy("corpus_id")
        .agg(F.max_by(F.struct("snapshot_id", "content"), "number").alias("last"))
        .select("corpus_id", "last.*")
    )
    folders = sorted(r["content"] for r in live.select("content").distinct().collect())  # at most one a corpus
    paths = [f"{root}/staging/content={f}" for f in folders] or [f"{root}/staging"]
    read = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/staging")
    names = [T.StructField(f.name, T.StringType() if f.name in live.columns else f.dataType) for f in read.parquet(*paths).schema]
    return read.schema(T.StructType(names)).parquet(*paths).join(small_side(live), ["corpus_id", "content"]).drop("content")
