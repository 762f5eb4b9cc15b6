"""Messages delivered more than once: which rows are one message, the copy to keep, and admission of new batches.

Rows belong to one message if they have the same identifier and sender and their dates are less than a minute from the next one. Which minutes
hang together is worked out on one row per minute that has any, day by day, so an identifier that carries a third of all rows (a gateway's
constant, say) or a message delivered that often meets only partial aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postquarry.functions.identifiers import bare_id, uid_of_id
from postquarry.operators.instants import MICROS, resolve_instants
from postquarry.tables import cut_lineage

DAY, MINUTE = 86_400 * MICROS, 60 * MICROS


def delivery_keys(messages: DataFrame, sources: DataFrame, undated: bool = True) -> DataFrame:
    """(read_ord, ident, sender, instant_us, content, fetched_at, batch_id): the fields a delivery is told by.

    ident is the hash of the bare identifier; a row without one has its own uid, and uids that hash the identifier as it was written are led
    back to the one that ignores case. Null where both are missing. content is a hash of subject, written date and bodies of rows whose date
    names no instant, null for others; bodies are read only for them, and not at all without undated.
    """
    if not undated:
        messages = messages.withColumns({c: F.lit(None).cast("string") for c in _CONTENT})
    rows = messages.select("read_ord", "batch_id", "fetched_at", "source_id", "uid", "message_id", "from_addr", "date_raw", *_CONTENT)
    rows = resolve_instants(rows, sources)
    cased, folded = bare_id(F.col("message_id"), fold=False), bare_id(F.col("message_id"))
    told = F.concat(*[x for c in ("date_raw", *_CONTENT) for x in (F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))])
    content = F.when(F.col("instant_us").isNull(), F.sha1(F.encode(told, "utf-8")))
    rows = cut_lineage(rows.select("read_ord", "batch_id", "fetched_at", "instant_us", "uid", content.alias("content"), F.lower("from_addr").alias("sender"), cased.alias("_cased"), folded.alias("_folded")))
    written = (
        rows.where(F.col("_cased") != F.col("_folded"))
        .select(uid_of_id(F.col("_cased")).alias("uid"), uid_of_id(F.col("_folded")).alias("_led"))
        .distinct()
    )
    known = rows.where(F.col("_folded").isNotNull()).withColumn("ident", uid_of_id(F.col("_folded")))
    bare = rows.where(F.col("_folded").isNull()).join(written, "uid", "left").withColumn("ident", F.coalesce("_led", "uid"))
    kept = ["read_ord", "batch_id", "fetched_at", "instant_us", "content", "sender", "ident"]
    return known.select(kept).unionByName(bare.select(kept))


_CONTENT = ("subject", "body_text", "body_html")
GROUP = ["ident", "sender", "start_us", "content"]


def chained(keys: DataFrame) -> DataFrame:
    """Rows of delivery_keys with ident, with start_us: the first instant of the message a row delivers; the sender null as empty.

    Rows of one minute are one message; a minute goes on with the one before if less than a minute lies between the last and first of them. A row
    without an instant has its content in place of a start.
    """
    told = keys.where("ident is not null").withColumns({"sender": F.coalesce("sender", F.lit("")), "_minute": F.floor(F.col("instant_us") / MINUTE)})
    dated = told.where("instant_us is not null")
    minutes = dated.groupBy("ident", "sender", "_minute").agg(F.min("instant_us").alias("_first"), F.max("instant_us").alias("_last"))
    minutes = minutes.withColumn("_day", F.floor(F.col("_first") / DAY))
    # at most 1440 rows a window, and days carry over their last minute and open start
    in_day = Window.partitionBy("ident", "sender", "_day").orderBy("_minute")
    days = minutes.groupBy("ident", "sender", "_day").agg(F.max("_last").alias("_end"))
    by_day = Window.partitionBy("ident", "sender").orderBy("_day")
    minutes = minutes.join(days.select("ident", "sender", "_day", F.lag("_end").over(by_day).alias("_before")), ["ident", "sender", "_day"])
    previous = F.coalesce(F.lag("_last").over(in_day), F.col("_before"))
    begins = previous.isNull() | (F.col("_first") - previous >= MINUTE)
    minutes = minutes.withColumn("_begin", F.when(begins, F.col("_first")))
    minutes = minutes.withColumn("_start", F.last("_begin", ignorenulls=True).over(in_day))
    opened = minutes.groupBy("ident", "sender", "_day").agg(F.max("_begin").alias("_open"))
    carried = opened.select("ident", "sender", "_day", F.last("_open", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    starts = minutes.join(carried, ["ident", "sender", "_day"]).select("ident", "sender", "_minute", F.coalesce("_start", "_carried").alias("start_us"))
    undated = told.where("instant_us is null").withColumn("start_us", F.lit(None).cast("bigint"))
    return dated.join(starts, ["ident", "sender", "_minute"]).drop("_minute").unionByName(undated.drop("_minute"))


def delivery_groups(messages: DataFrame, sources: DataFrame, undated: bool = True) -> DataFrame:
    """One row per delivery: read_ord, ident, sender, instant_us, start_us, content and the fields of arrival.

    Rows whose date names no instant are copies if identifier, sender and content (subject, written date, bodies) are equal; they have content
    in place of start_us. Rows without an identifier can't be told to be copies: both are null. A null sender equals a null sender.
    """
    keys = delivery_keys(messages, sources, undated)
    alone = keys.where("ident is null").withColumn("start_us", F.lit(None).cast("bigint")).withColumn("content", F.lit(None).cast("string"))
    return chained(keys).unionByName(alone)


def first_copies(groups: DataFrame) -> DataFrame:
    """(read_ord) of the copies to keep: ranked by arrival (fetched_at, then batch_id, then read_ord) the first of each message. Ranks are
    limited to the first before the shuffle, so a message with very many copies is no hot spot."""
    arrival = Window.partitionBy(*GROUP).orderBy("fetched_at", "batch_id", "read_ord")
    ranked = groups.where("ident is not null").select("read_ord", "fetched_at", "batch_id", *GROUP).withColumn("copy_no", F.row_number().over(arrival))
    return ranked.where("copy_no = 1").select("read_ord").unionByName(groups.where("ident is null").select("read_ord"))


def keep_one_copy(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """messages without the repeated deliveries; columns unchanged."""
    return messages.join(first_copies(delivery_groups(messages, sources)), "read_ord", "left_semi")


def admit_batch(stored: DataFrame, batch: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of batch that are neither repeated within it nor delivered among stored rows before (read_ord is unique over both).

    Of the stored rows only those under identifiers of the batch are looked at.
    """
    marked = stored.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    keys = delivery_keys(marked, sources).join(batch.select("read_ord", F.lit(True).alias("_new")), "read_ord", "left")
    fresh, old = keys.where("_new"), keys.where("_new is null")
    met = old.join(fresh.select("ident").where("ident is not null").distinct(), "ident", "left_semi")
    groups = chained(fresh.unionByName(met.select(fresh.columns)))
    known = groups.where("_new is null").select(GROUP).distinct()
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("start_us", "content")]
    new = groups.where("_new").alias("g").join(known.alias("k"), [F.col("g.ident") == F.col("k.ident"), F.col("g.sender") == F.col("k.sender"), *same], "left_anti")
    keep = first_copies(new.unionByName(fresh.where("ident is null").withColumn("start_us", F.lit(None).cast("bigint")).select(new.columns)))
    return batch.join(keep, "read_ord", "left_semi")


def delivery_classes(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """(read_ord, class_id, copies): one row per delivery with the least read_ord of its message and the number of its deliveries."""
    rows = cut_lineage(delivery_groups(messages, sources).select("read_ord", *GROUP))
    told = rows.where("ident is not null")
    classes = told.groupBy(GROUP).agg(F.min("read_ord").alias("class_id"), F.count("*").alias("copies"))
    same = told["ident"].eqNullSafe(classes["ident"]) & told["sender"].eqNullSafe(classes["sender"]) & told["start_us"].eqNullSafe(classes["start_us"]) & told["content"].eqNullSafe(classes["content"])
    alone = rows.where("ident is null").select("read_ord", F.col("read_ord").alias("class_id"), F.lit(1).cast("bigint").alias("copies"))
    return told.join(classes, same).select("read_ord", "class_id", "copies").unionByName(alone)


def delivered_pairs(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """(read_ord_a, read_ord_b), a < b, of rows that deliver one message with dates less than a minute apart.

    Rows meet only in equal or neighbouring minutes of one message.
    """
    rows = cut_lineage(delivery_groups(messages, sources, undated=False).where("start_us is not null").select("read_ord", "ident", "sender", "start_us", "instant_us"))
    copies = rows.groupBy("ident", "sender", "start_us").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(copies, ["ident", "sender", "start_us"], "left_semi").withColumn("_minute", F.floor(F.col("instant_us") / MINUTE))
    key = ["ident", "sender", "start_us", "_meet"]
    x = rows.select("ident", "sender", "start_us", F.explode(F.array("_minute", F.col("_minute") + 1)).alias("_meet"), F.col("_minute").alias("_mx"), F.col("instant_us").alias("_ix"), F.col("read_ord").alias("_x"))
    y = rows.select("ident", "sender", "start_us", F.col("_minute").alias("_meet"), F.col("instant_us").alias("_iy"), F.col("read_ord").alias("_y"))
    pairs = x.join(y, key).where(((F.col("_mx") < F.col("_meet")) | (F.col("_x") < F.col("_y"))) & (F.abs(F.col("_ix") - F.col("_iy")) < MINUTE))
    return pairs.select(F.least("_x", "_y").alias("read_ord_a"), F.greatest("_x", "_y").alias("read_ord_b"))
