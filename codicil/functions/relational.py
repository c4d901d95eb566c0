"""Join, ranking and staging helpers shared by the operators."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
_own_dirs: dict[str, str | None] = {}
_scopes: list[list[str]] = []


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one ``spark.checkpoint.dir`` names.

    Only a local session may go without; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _own_dirs.setdefault(app, None) or tempfile.mkdtemp(prefix="codicil-")
        _own_dirs[app] = root
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def staged_paths() -> Iterator[list[str]]:
    """List of the folders that ``stage`` writes inside the block, for ``drop_staged`` once nothing reads them."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        own = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(own)


def drop_staged(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Delete staged folders, but for those that ``keep`` still reads.

    Plans over them are garbage then; collecting it lets Spark delete their shuffle files.
    """
    read = "\n".join(keep.inputFiles()) if keep is not None and paths else ""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in read]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        paths.remove(path)
    gc.collect()
    jvm.System.gc()


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, in directories of ``by`` if given.

    Cuts lineage in a way that survives lost executors, and gives the optimizer
    true sizes for the joins that follow.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
    writer.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the table is measured to be within ``max_rows`` and 64 MB.

    Beyond either bound the plain table comes back and the join shuffles, with
    adaptive skew handling. A row is measured by its JSON form.
    """
    size = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)).cast("bigint")
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and total <= BROADCAST_BYTES else df


def join_hot(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join on keys of which some may hold much of ``big``.

    The small side is broadcast if it is counted to be small. If not, each key is
    split into ``salts`` parts by a hash of ``spread_by`` and the small side is
    repeated per part, so no task gets a whole hot key. Both ways are exact.
    """
    hinted = small_side(small)
    if hinted is not small:
        return big.join(hinted, keys, how)
    part = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", part).join(repeated, [*keys, "__salt"], how).drop("__salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes to ``k`` per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def best_first(score: str = "score", tie: str = "chunk_id") -> list[Column]:
    return [F.col(score).desc(), F.col(tie).asc()]


def flags_to_reasons(flags: dict[str, Column]) -> Column:
    """Sorted array of the names whose flag holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))
