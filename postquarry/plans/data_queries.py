"""Queries of the general data problems (deliveries and dates) over the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postquarry.operators.deliveries import delivered_pairs, delivery_classes, keep_one_copy
from postquarry.operators.instants import as_timestamp, misread, resolve_instants
from postquarry.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return delivered_pairs(table(spark, d, "messages"), table(spark, d, "sources"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = keep_one_copy(table(spark, d, "messages"), table(spark, d, "sources"))
    return kept.select("read_ord", "batch_id", "message_id", "uid", "from_addr", "subject")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return misread(table(spark, d, "messages"), table(spark, d, "sources")).select("read_ord")


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").select("read_ord", "source_id", "date_raw")
    rows = resolve_instants(rows, table(spark, d, "sources"))
    return rows.select("read_ord", "date_raw", as_timestamp(F.col("instant_us")).alias("instant"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return delivery_classes(table(spark, d, "messages"), table(spark, d, "sources"))


QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept, "p5_classes": p5_classes, "p6_found": p6_found, "p6_instants": p6_instants}
SQL: dict[str, str] = {}
