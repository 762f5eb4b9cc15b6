"""Folder listings, navigation, threads and sorted views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from postquarry import schema as S
from postquarry.functions.text import folder_sort_key, list_subject, priority_rank
from postquarry.tables import cut_lineage


def flags(attached: Column, flagged: Column, unread: Column) -> Column:
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return bit(attached, S.FLAG_ATTACHED).bitwiseOR(bit(flagged, S.FLAG_FLAGGED)).bitwiseOR(bit(unread, S.FLAG_UNREAD))


DAY = 86_400


def _dated(messages: DataFrame) -> DataFrame:
    """messages with _at (the date, 0 for none) and its _day: windows go by day, so the largest folder or thread is many of them."""
    return messages.withColumn("_at", F.coalesce("epoch", F.lit(0))).withColumn("_day", F.floor(F.col("_at") / DAY))


def _newest_in_day(key: str = "path") -> WindowSpec:
    return Window.partitionBy(key, "_day").orderBy(F.desc("_at"), F.desc("uid"))


def listing(messages: DataFrame) -> DataFrame:
    """messages (path, epoch, uid, ...) with idx, the place in the folder: newest first, undated ones last."""
    rows = _dated(messages)
    later = Window.partitionBy("path").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("path", "_day").agg(F.count("*").alias("_n")).select("path", "_day", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_rank", F.row_number().over(_newest_in_day())).join(days, ["path", "_day"])
    return placed.withColumn("idx", (F.col("_before") + F.col("_rank") - 1).cast("int")).drop("_at", "_day", "_rank", "_before")


def document_ids(messages: DataFrame) -> DataFrame:
    """messages with gid, the place over all folders in tree order: the folder's offset plus the place in the folder."""
    counts = messages.groupBy("path").agg(F.count("*").alias("_n")).withColumn("_key", folder_sort_key(F.col("path")))
    # one row a folder: the running sum is over the folder dimension only
    before = Window.orderBy("_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return listing(messages).join(offsets, "path").withColumn("gid", F.col("_from") + F.col("idx")).drop("_from")


def neighbours(messages: DataFrame) -> DataFrame:
    """messages with prev (newer) and next (older) uid in the folder; empty at its ends. Days hand over their first and last uid."""
    rows = _dated(messages)
    place = F.struct("_at", "uid")
    by_day = Window.partitionBy("path").orderBy(F.desc("_day"))
    ends = rows.groupBy("path", "_day").agg(F.max_by("uid", place).alias("_first"), F.min_by("uid", place).alias("_last"))
    ends = ends.select("path", "_day", F.lag("_last").over(by_day).alias("_newer"), F.lead("_first").over(by_day).alias("_older"))
    w = _newest_in_day()
    near = rows.withColumns({"prev": F.lag("uid").over(w), "next": F.lead("uid").over(w)}).join(ends, ["path", "_day"])
    side = lambda c, edge: F.coalesce(c, edge, F.lit(""))
    return near.withColumns({"prev": side(F.col("prev"), F.col("_newer")), "next": side(F.col("next"), F.col("_older"))}).drop("_at", "_day", "_newer", "_older")


def sort_keys(column: str) -> Column:
    return {
        "subject": list_subject(F.col("subject")), "sender": F.coalesce(F.nullif("from_name", F.lit("")), F.nullif("from_addr", F.lit("")), F.lit("")),
        "priority": priority_rank(F.col("priority")), "size": F.coalesce("size", F.lit(0)), "date": F.coalesce("epoch", F.lit(0)),
    }[column]


def sort_order(column: str = "date", descending: bool = True) -> list[Column]:
    """By the column, then date, both in the same direction, then uid."""
    d = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [d(sort_keys(column)), d(sort_keys("date")), F.asc("uid")]


def sort_list(rows: DataFrame, column: str = "date", descending: bool = True) -> DataFrame:
    return rows.orderBy(*sort_order(column, descending))


def ranked(rows: DataFrame, order: list[Column], parts: int = 64) -> DataFrame:
    """rows with place, from 1, in an order over all of them: ranges of the order are written, numbered each by itself, and shifted by the sizes
    of those before. No task sees more than a range."""
    ranged = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(shifts, "_part").withColumn("place", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def threads(rows: DataFrame, thread: str = "thread") -> DataFrame:
    """rows with member (by date in the thread), depth (0 for the first), kids and newest (the thread's last date). A null thread is one."""
    dated = _dated(rows).withColumn("_thread", F.coalesce(F.concat(F.lit("t"), F.col(thread)), F.lit("")))
    earlier = Window.partitionBy("_thread").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_thread")
    days = dated.groupBy("_thread", "_day").agg(F.count("*").alias("_n"), F.max("_at").alias("_newest"))
    days = days.select("_thread", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"), F.max("_newest").over(whole).alias("newest"))
    in_day = Window.partitionBy("_thread", "_day").orderBy("_at", "uid")
    placed = dated.withColumn("_rank", F.row_number().over(in_day)).join(days, ["_thread", "_day"])
    member = (F.col("_before") + F.col("_rank")).cast("int")
    out = placed.withColumns({"member": member, "depth": F.when(member > 1, 1).otherwise(0), "kids": F.when(member == 1, F.col("_all") - 1).otherwise(0)})
    return out.drop("_thread", "_at", "_day", "_before", "_rank", "_all")


def thread_groups(rows: DataFrame, thread: str = "thread") -> DataFrame:
    """(thread, size, newest, newest_uid), partially aggregated before the shuffle."""
    last = F.max_by("uid", F.struct(F.coalesce("epoch", F.lit(0)), F.col("uid")))
    return rows.groupBy(thread).agg(F.count("*").alias("size"), F.max(F.coalesce("epoch", F.lit(0))).alias("newest"), last.alias("newest_uid"))


def next_unread(rows: DataFrame) -> DataFrame:
    """rows with next_unread: uid of the next unread message further down the folder, null if there is none."""
    dated = _dated(rows)
    unread = F.coalesce("unread", F.lit(False))
    older = Window.partitionBy("path").orderBy(F.desc("_day")).rowsBetween(1, Window.unboundedFollowing)
    days = dated.groupBy("path", "_day").agg(F.max_by("uid", F.when(unread, F.struct("_at", "uid"))).alias("_open"))
    days = days.select("path", "_day", F.first("_open", ignorenulls=True).over(older).alias("_later"))
    in_day = F.first(F.when(unread, F.col("uid")), ignorenulls=True).over(_newest_in_day().rowsBetween(1, Window.unboundedFollowing))
    return dated.withColumn("_next", in_day).join(days, ["path", "_day"]).withColumn("next_unread", F.coalesce("_next", "_later")).drop("_at", "_day", "_next", "_later")


def unread_rows(rows: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Unread rows, without those a reader has marked as read."""
    open_ = rows.where(F.coalesce("unread", F.lit(False)))
    return open_.join(marks.select("uid").distinct(), "uid", "left_anti") if marks is not None else open_


def mark_read(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """marks with the uids of rows added once."""
    return marks.select("uid").unionByName(rows.select("uid")).distinct()
