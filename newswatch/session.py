"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings every job of this package is written for. No join carries a
# broadcast hint: Spark broadcasts a side only when its measured size is below
# the threshold, and sort-merges (with skew splitting) beyond it.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    BATCH_BYTES: "16m",  # Python workers hold one batch at a time
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "newswatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; keyword keys replace dots by ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs this store; a session not made by ``build_session`` may have another."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def use_small_batches(spark: SparkSession) -> None:
    """A task holds a batch in the JVM and in its Python worker; a session that names no size would fill 64 MB each time."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "3m")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without one gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="newswatch-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

