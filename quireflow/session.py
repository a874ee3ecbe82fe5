"""Session construction and the few runtime settings the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that belong to the engine's semantics or its default physical plan.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "quireflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` entries win over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; a temporary folder only where none is set, on one machine (tests)."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quireflow-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as a Parquet table to the shared folder and read back.

    Every executor can read it, so losing one loses nothing. The table is deleted when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quireflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete_written() -> None:
    for spark, path in _WRITTEN:
        local = path.removeprefix("file:")
        if local.startswith("/"):
            shutil.rmtree("/" + local.lstrip("/"), ignore_errors=True)
            continue
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already
            return
