"""Session defaults. A cluster's own settings always win over these."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "marketlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    AQE resolves broadcast sides from measured sizes, merges small shuffle
    partitions and splits skewed ones; the UTC zone keeps day boundaries equal on
    every executor. Pass ``spark.sql.shuffle.partitions`` etc. through ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, it lies
    beneath the warehouse folder on the session's default file system; a local path
    is only accepted when the executors run on the driver's machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/_shared")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = system.makeQualified(path).toString()
    if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints, set on the context where it is not yet."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = shared_folder(spark)
    spark.sparkContext.setCheckpointDir(folder)
    return folder
