"""Tables that end a step: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local master without it gets a folder of its own, a
    cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return _own[app]


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df, written below the shared folder (in a folder for each value of `by`). A lost executor costs a
    read, not what led to df."""
    at = f"{shared_dir(df.sparkSession)}/sparkloom-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._stored_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing unfinished reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
