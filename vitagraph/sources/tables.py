"""Readers of the parquet test tables and helpers shared by all plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables: below the shared folder that
    ``spark.checkpoint.dir`` names. Only a session on one machine may leave it unset (a
    temporary folder is used then); on a cluster that is an error. The folder is
    removed when the driver ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="vitagraph-")
        _SCRATCH[sc.applicationId] = path = f"{base}/vitagraph-{sc.applicationId}"
        atexit.register(_remove, sc, path)
    return _SCRATCH[sc.applicationId]


def _remove(sc, path: str) -> None:
    try:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except Exception:  # the driver's JVM is gone: nothing can be done from here
        pass


#: Application id -> its folder.
_SCRATCH: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a table written once in the shared folder. Unlike a
    checkpoint of the rows, which computes them twice, later steps read only the
    columns they need, and lost executors cost nothing before it. What was shuffled for it
    is removed when it is written, not only when the driver collects its garbage."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, "false")
    conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables that were written so far; frames that were built on
    them can no longer be read."""
    path = _SCRATCH.get(spark.sparkContext.applicationId)
    if path:
        _remove(spark.sparkContext, path)


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's number, from 1, in the ``order`` of its group
    (ties in any order). Rows are sorted by ranges and numbered by counts of each range,
    so that a group of any size is divided among tasks; nulls are a group of their own."""
    by = [*groups, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = checkpointed(rows.withColumn("p_", F.spark_partition_id()).withColumn("k_", F.monotonically_increasing_id()))
    parts = rows.groupBy(*groups, "p_").agg(F.count("*").alias("n_"), F.min("k_").alias("first_"))
    until = F.sum("n_").over(W.partitionBy(*groups).orderBy("p_").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(*[F.col(g).alias(f"{g}_g") for g in groups], F.col("p_").alias("p_g"), "first_", F.coalesce(until, F.lit(0)).alias("before_"))
    same = F.col("p_") == F.col("p_g")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_g"))
    return rows.join(parts, same).select(*df.columns, (F.col("before_") + F.col("k_") - F.col("first_") + 1).alias(name))


def latest_by(df: DataFrame, key: str, *values: str) -> DataFrame:
    """The current row of each ``key``: greatest ``loaded_at``, ties by greatest
    ``row_id``. A partial aggregate, so a hot key is combined before the shuffle.
    Rows whose key is null have no identity and are left out; an empty table
    gives an empty result."""
    latest = F.max_by(
        F.struct(*[F.col(v).alias(v) for v in values]),
        F.struct(F.col("loaded_at").isNotNull(), F.col("loaded_at"), F.col("row_id")),
    ).alias("latest")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(latest)
        .select(key, *[F.col(f"latest.{v}").alias(v) for v in values])
    )


def plain_term(c: Column) -> Column:
    """Lower case, trimmed, inner blanks (of any kind) reduced to one."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))
