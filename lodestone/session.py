"""Session set-up, table access and staging of intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of one Arrow batch sent to a Python worker while a result is staged; Spark's own default is 64 MB.
STAGED_BATCH_BYTES = str(8 << 20)


def local_session(cpus: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over four tasks a core: tables whose few bytes make one or two tasks, but whose rows take long."""
    return df.repartition(4 * max(1, df.sparkSession.sparkContext.defaultParallelism))


#: Staging folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one for a local master, whose
    executors are threads of this machine; elsewhere an error, as executors would write to disks of their own."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _LOCAL[context.applicationId]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives the loss of
    executors, and gives the planner true sizes for what follows."""
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, STAGED_BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)
