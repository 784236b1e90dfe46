"""Session settings and the shared folder for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every pulse job relies on. Sizes are set for local runs; on a cluster
# the deploy config wins, since getOrCreate() keeps an existing session's values.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "pulse", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Read from the session. Only a local-mode session with nothing set (tests,
    a laptop) gets a folder under the system temp dir; on a cluster a
    machine-local folder would be invisible to the executors, so it is an
    error to leave the setting out.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        root = tempfile.mkdtemp(prefix="pulse-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root, unique per call."""
    return f"{checkpoint_root(spark).rstrip('/')}/pulse/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write ``df`` once as Parquet below the shared folder and return a
    reader of it. Use where several branches consume one costly intermediate:
    each branch then scans only its own columns, the intermediate is computed
    once, and the lineage is cut (a lost executor does not recompute it)."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
