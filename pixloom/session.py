"""Session settings and the shared folder that operators write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pixloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator assumes; nothing set by a cluster is overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pixloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_RUN_DIRS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables below the shared one, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUN_DIRS:
        path = f"{shared_dir(spark)}/pixloom-{app}-{uuid.uuid4().hex[:8]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _RUN_DIRS[app] = path
    return _RUN_DIRS[app]


def work_dir(spark: SparkSession, what: str) -> str:
    """A new, unused folder name below that of this application."""
    return f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing. The table is there until the
    application ends, since the frame may be read until then."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that is bound by CPU. A table that has enough already, as any
    large one has, is not moved. Nothing is run to find out: the partitions of a scan are known, and behind a shuffle the optimizer's
    estimate of the size decides."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" not in plan and "Adaptive" not in plan:
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * part else df


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a work folder that is no longer read."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
