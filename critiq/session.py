"""Session construction and cluster-wide settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every critiq session wants.  They are only applied when the
# caller (or the cluster) has not set them already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep adaptive execution inside persisted (shared) aggregates
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "critiq",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with critiq's defaults.

    On a cluster ``master`` stays None and the launcher decides.  Locally,
    pass ``local[N]`` and a shuffle-partition count near N.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting (or the context's checkpoint folder) is needed:
    a folder of one machine would lose rows.  A local session is one machine,
    so there, as in tests, a temporary folder stands in.
    """
    ctx = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or ctx.getCheckpointDir()
    if not d:
        if not ctx.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="critiq-ckpt-")
    if not ctx.getCheckpointDir():
        ctx.setCheckpointDir(d)
    return d
