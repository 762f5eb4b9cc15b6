"""Reading the archive's tables and writing intermediate results to storage all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names, which on a cluster is shared storage. A temporary one only where it is unset and the master local."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or _made.get(spark.sparkContext.applicationId)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = _made[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tables-")
    return folder


_made: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and returns what was written: compressed, readable by any executor, and
    with the sizes that let joins be planned. drop_written() removes those that are no longer needed; what results still read stays until the
    application ends, then all its tables go."""
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder for a table of this application."""
    own = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


_owned: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def drop_written(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of cut_lineage()."""
    for df in frames:
        _remove(df.sparkSession, df._written_at)
