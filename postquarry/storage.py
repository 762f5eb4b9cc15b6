"""Small files by way of Hadoop's file systems, so that an archive may lie on any of them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory; none if there is no such."""
    system, target = _at(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    system, target = _at(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target and puts it in place of the old file, so readers never see half of it."""
    system, target = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    replace = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = replace
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(beside, target, options)
