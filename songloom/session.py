"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings every job relies on. Shuffle width is left to the cluster (AQE coalesces it).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "songloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the required settings; keyword settings win (dots as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> None:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)


def load(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read one parquet table; zone-less timestamps are taken as UTC instants."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster a
    missing setting is an error, because a lost executor would lose the data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    global _LOCAL_DIR
    if _LOCAL_DIR is None or not os.path.isdir(_LOCAL_DIR):
        _LOCAL_DIR = tempfile.mkdtemp(prefix="songloom-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that later stages restart
    from files and read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/cuts/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
