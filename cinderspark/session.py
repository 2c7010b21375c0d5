"""Session defaults.

Only what a job needs for itself is set, and only where the cluster has not set it.
"""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cinderspark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and stage tables.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        folder = configured
    elif spark.sparkContext.master.startswith("local"):
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: worked out once, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
