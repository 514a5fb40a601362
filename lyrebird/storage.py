"""Steps written to the folder that all executors share, and read back: their lineage ends there, and what a step drew by chance is drawn once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. One of our own only where none is named and all tasks run in this process; it goes with the process."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.TemporaryDirectory(prefix="lyrebird-steps-")
    return f"file://{_LOCAL[app].name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet and read back; ``drop`` removes them."""
    path = f"{shared_folder(df.sparkSession)}/lyrebird-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote; only for frames that no later plan reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
