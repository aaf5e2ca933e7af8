"""Session settings shared by tests, bench and batch jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Broadcasts are never hinted: Spark compares each side with this size (from file statistics
# before the run, from shuffle statistics during it) and otherwise shuffles, splitting hot
# partitions. So what is broadcast has always been measured.
BROADCAST_BYTES = 64 * 1024 * 1024

SETTINGS = {
    # static: saves a JVM call per column expression; plans here are built from many
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
}

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "pingloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Fix the settings results depend on in a session somebody else created."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else (tests only) a new temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pingloom-")
    return _LOCAL_FOLDERS[app]
