"""Session settings the operators are tuned for, and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="sparselens", master=None, **conf):
    """A session with adaptive execution on; keyword settings override the defaults.

    Shuffle partitions are left to the cluster: adaptive execution coalesces small
    ones, so a large initial number costs little and a small one cannot be repaired.
    """
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder every executor can reach: the cluster's checkpoint directory.

    Only where the cluster names none (tests on one machine) a temporary folder is used.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="sparselens-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def settle(df):
    """Compute a small result once and cut its lineage; it is kept in the shared folder.

    Used for results that several later steps read (a selection, cut-offs per feature), so
    that the scan behind them is not repeated and a lost executor only re-reads the file.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def staged(df, name="stage"):
    """The frame written as a table in the shared folder and read back: it is computed exactly once.

    For results whose rows must not change between two readers (positions of a sampled range
    partitioning), where ``checkpoint`` would compute them a second time.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
