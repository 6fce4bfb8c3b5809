"""Session helpers: reading tables, and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC time; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema tables; a Parquet file or a directory of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset a temporary folder is used, which is right only when
    driver and executors are one process; on a cluster this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting for removing the shuffle files of a statement at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, for `release` to remove."""
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the tables that this process has written to the shared folder; results that were not read by then are lost. Returns their number."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint: the files outlive any
    executor. In contrast to `checkpoint()` the result has size statistics, so
    Catalyst can choose joins by them. The table stays until `release`. With `sweep`
    what was shuffled to make it is removed as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(SWEEP, None)
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)
