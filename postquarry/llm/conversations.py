"""Conversations rebuilt from message rows.

Rows are an event log: creates, edits, retries and deletes of a message fold by version (arrival) into one final turn per identifier, links
between messages give the conversations, and those that are broken, empty or unanswered are dropped. All steps are joins and aggregations,
so neither a long conversation nor one that holds a third of all rows has to fit in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postquarry.functions.identifiers import bare_id
from postquarry.operators.instants import resolve_instants
from postquarry.tables import cut_lineage, drop_written

LATE = 1 << 62  # stands for a missing instant: after all others
MINUTE, DAY = 60_000_000, 86_400_000_000


def _refs() -> Column:
    return F.filter(F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda x: bare_id(x)), lambda x: x.isNotNull())


def deliveries(messages: DataFrame, sources: DataFrame, deleted: Column | None = None) -> DataFrame:
    """Events with an identifier: message_id, at (version: arrival, then read_ord), sender, reply, last_ref, instant_us, seen (has visible
    text), deleted (the event takes the message back; null and no column: it doesn't)."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    kept = ["read_ord", "fetched_at", "source_id", "message_id", "from_addr", "in_reply_to", "refs", "date_raw", "body_text", "body_html"]
    rows = resolve_instants(messages.select(*kept, gone.alias("_gone")), sources)
    markup = r"(?is)<(script|style|head|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&nbsp;|&#160;|&#xa0;"
    visible = lambda c: F.coalesce(c.rlike("(?U)[^\\s \u200b\ufeff]"), F.lit(False))
    refs = _refs()
    return rows.select(
        bare_id(F.col("message_id")).alias("message_id"), F.struct(F.coalesce("fetched_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("at"), "read_ord").alias("at"),
        F.nullif(F.lower(F.trim("from_addr")), F.lit("")).alias("sender"), bare_id(F.col("in_reply_to")).alias("reply"), F.get(refs, F.size(refs) - 1).alias("last_ref"), "instant_us",
        (visible(F.col("body_text")) | visible(F.regexp_replace("body_html", markup, ""))).alias("seen"), F.col("_gone").alias("deleted"),
    ).where("message_id is not null")


def fold_messages(rows: DataFrame) -> DataFrame:
    """One row per bare identifier: sender, parent, instant_us, seen, last_ord (read_ord of the version whose text counts).

    Who wrote a message, what it answers and when it was written belong to its creation: the earliest event that has a value gives it, so
    later ones mend missing values but no unrelated mail under the same identifier takes a message over; of dates in the same minute one with
    seconds says more. The text is that of the last version with visible text, so edits count and empty retries don't. A message whose last
    event deletes it is left out, and answers to it lead nowhere. All sums are partial before the shuffle, so an identifier on a third of the
    rows is no hot spot.
    """
    first = lambda c, told=None: F.min_by(c, F.when(c.isNotNull() if told is None else told, F.col("at")))
    minute = lambda c: F.floor(c / MINUTE)
    folded = rows.groupBy("message_id").agg(
        first(F.col("sender")).alias("sender"), F.coalesce(first(F.col("reply")), first(F.col("last_ref"))).alias("parent"), first(F.col("instant_us")).alias("_date"),
        first(F.col("instant_us"), F.col("instant_us") % MINUTE != 0).alias("_exact"), F.max("seen").alias("seen"),
        F.max(F.when(F.col("seen"), F.col("at")))["read_ord"].alias("last_ord"), F.max(F.struct("at", "deleted"))["deleted"].alias("_gone"),
    )
    date = F.when(minute(F.col("_exact")) == minute(F.col("_date")), F.col("_exact")).otherwise(F.col("_date"))
    return folded.where("not _gone").select("message_id", "sender", "parent", date.alias("instant_us"), "seen", "last_ord")


def named_links(messages: DataFrame) -> DataFrame:
    """(a, b): message a names identifier b in in_reply_to or refs of any delivery. Reads three columns."""
    named = F.array_distinct(F.array_compact(F.concat(_refs(), F.array(bare_id(F.col("in_reply_to"))))))
    return messages.select(bare_id(F.col("message_id")).alias("a"), F.explode(named).alias("b")).where("a is not null").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component, for edges (a, b).

    Each round takes the smallest label among the neighbours, then the label's own label; sums are small because
    partial minima are taken before the shuffle. Ends when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("_near")).withColumnRenamed("a", "node")
        stepped = labels.join(near, "node").select("node", F.least("label", "_near").alias("_step"), F.col("label").alias("_was"))
        over = stepped.join(stepped.select(F.col("node").alias("_step"), F.col("_step").alias("_jump")), "_step", "left")
        new = cut_lineage(over.select("node", F.least("_step", "_jump").alias("label"), (F.least("_step", "_jump") != F.col("_was")).alias("moved")))
        drop_written(labels)
        labels = new
        if new.where("moved").isEmpty():
            drop_written(both)
            return labels.select("node", "label")
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def turn_keys(links: DataFrame) -> DataFrame:
    """(message_id, root_id, key) for links (message_id, parent, instant_us, size) of messages, size being the number of messages of their
    component; sorting by key gives the turns.

    The wanted order always takes the earliest message whose parent has been taken. A message's place in it is given by
    the maxima of its path, each taken below the one before: joining two pieces of path drops the end of the upper one that
    is not later than the lower one's first. That is associative, so paths double in length each round.
    Keys are as long as a path has such maxima: one entry where dates grow with the answers, as they mostly do.
    A path that has covered as many steps as its component has messages without reaching a root runs in a circle and is left out. Going round
    one adds nothing to a key, so no key has more entries than there are messages, and rounds are as many as the largest component has bits.
    """
    own = F.array(F.struct(F.coalesce("instant_us", F.lit(LATE)).alias("at"), F.col("message_id").alias("id")))
    paths = cut_lineage(links.select("message_id", F.col("parent").alias("up"), F.col("message_id").alias("top"), own.alias("key"), "size"))
    open_, done = paths.where("up is not null"), [paths.where("up is null")]
    steps = 1
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, [*done, open_])
        upper = known.select(F.col("message_id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("key").alias("_key"))
        joined = F.concat(F.filter("_key", lambda x: x > F.get("key", F.lit(0))), F.col("key"))
        steps *= 2
        met = open_.join(upper, "up").select("message_id", F.col("_up").alias("up"), F.col("_top").alias("top"), joined.alias("key"), "size")
        # only what moved is written again
        met = cut_lineage(met.where(F.col("up").isNull() | (F.col("size") > steps)))
        open_ = met.where("up is not null")
        done.append(met.where("up is null"))
    return reduce(DataFrame.unionByName, done).select("message_id", F.col("top").alias("root_id"), "key")


def conversations(messages: DataFrame, sources: DataFrame, deleted: Column | None = None) -> DataFrame:
    """(root_id, message_id, turn_no, speaker, role, instant_us, last_ord) of the kept conversations.

    role is owner for the first sender and correspondent for all others; last_ord is the read_ord of the row that has the turn's final text,
    null for a turn without any. Conversations are dropped if an identifier named in them has no row or was deleted, answers run in a circle,
    more than one message answers none, nobody but the first sender wrote in them, or no message has visible text. deleted marks rows that
    take a message back, if the log has such.
    """
    turns = cut_lineage(fold_messages(deliveries(messages, sources, deleted)))
    edges = cut_lineage(named_links(messages))
    labels = components(edges)
    part = labels.join(turns.withColumnRenamed("message_id", "node").withColumn("_row", F.lit(True)), "node", "left")
    present = F.col("_row")
    facts = part.groupBy("label").agg(
        F.count_if(present.isNull()).alias("missing"), F.count_if(present & F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNotNull()).alias("replies"),
        F.max("seen").alias("seen"), F.min("sender").alias("low"), F.max("sender").alias("high"), F.count("*").alias("size"),
    )
    sound = facts.where("missing = 0 and roots = 1 and replies > 0 and seen and low <> high").select("label", "size")
    kept = cut_lineage(part.join(sound, "label").select("label", "size", F.col("node").alias("message_id"), "sender", "parent", "instant_us", "last_ord"))
    drop_written(turns, edges)
    keyed = turn_keys(kept).join(kept.drop("parent"), "message_id")
    whole = keyed.groupBy("label").agg(F.count("*").alias("_n"), F.first("size").alias("_size")).where("_n = _size").select("label")
    keyed = keyed.join(whole, "label", "left_semi").withColumn("_day", F.floor(F.get("key", F.lit(0))["at"] / DAY))
    keyed = cut_lineage(keyed)
    days = keyed.groupBy("root_id", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("root_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("root_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_day = Window.partitionBy("root_id", "_day").orderBy("key")
    owners = kept.where("parent is null").select(F.col("message_id").alias("root_id"), F.col("sender").alias("_owner"))
    numbered = keyed.withColumn("_rank", F.row_number().over(in_day)).join(days, ["root_id", "_day"]).join(owners, "root_id")
    role = F.when(F.col("sender").eqNullSafe(F.col("_owner")), "owner").otherwise("correspondent")
    return numbered.select("root_id", "message_id", (F.col("_before") + F.col("_rank")).cast("bigint").alias("turn_no"), F.col("sender").alias("speaker"), role.alias("role"), "instant_us", "last_ord")


def conversation_texts(messages: DataFrame, sources: DataFrame, deleted: Column | None = None) -> DataFrame:
    """The turns with their subject and final text: text is body_text, body_html where that is blank. Bodies meet one join by row."""
    text = F.coalesce(F.when(F.trim("body_text") != "", F.col("body_text")), F.col("body_html"))
    bodies = messages.select(F.col("read_ord").alias("last_ord"), "subject", text.alias("text"))
    return conversations(messages, sources, deleted).join(bodies, "last_ord", "left").drop("last_ord")
