"""From mail sources to a published archive: listings, folders, index, pages, files and manifest as Parquet, and their JSON forms.

One shuffle on uid for de-duplication, one on the folder for listings, one on the token for the index; accounts and folders are small
aggregates. Results are written before they are read again, so nothing is worked out twice. Pages and files of messages that did not change are not
made again: those of a run are a part of their own, and the manifest tells which part holds a message. Paths may be of any file system Hadoop knows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions import identity, text as X
from postquarry.operators import filing, index, listing, manifest
from postquarry.plans.pages import files, pages
from postquarry.sources.datasource import read_mail
from postquarry.sources.mailbox import fingerprint
from postquarry.storage import exists, write_text


@dataclass
class Stats:
    added: int = 0
    updated: int = 0
    unchanged: int = 0
    gone: int = 0
    pruned: int = 0
    attachments: int = 0
    duplicates: int = 0
    folders: int = 0
    errors: tuple[str, ...] = ()

    def summary(self) -> str:
        return f"{self.added} added, {self.updated} updated, {self.unchanged} unchanged, {self.gone} gone, {self.duplicates} duplicates, {self.folders} folders, {len(self.errors)} errors"


def normalise(records: DataFrame) -> DataFrame:
    """Records with read_ord, box (normal folder), uid and epoch."""
    iso = F.when(F.col("date_local").isNotNull(), F.concat(F.date_format("date_local", "yyyy-MM-dd'T'HH:mm:ss"), offset_text(F.col("date_offset_s"))))
    body = F.coalesce(F.nullif("body_text", F.lit("")), F.col("body_html"))
    uid = identity.uid(F.col("message_id"), iso, F.col("date_raw"), F.col("sender.addr"), F.col("subject"), F.transform("to", lambda a: a["addr"]), body)
    return records.where("error is null").withColumns({
        "read_ord": F.struct("given", "source", "pos"), "box": X.normalize_folder(F.col("folder")), "uid": uid, "iso": iso,
        "epoch": F.coalesce(F.unix_seconds("date_ts"), F.lit(0)),
    })


def offset_text(seconds):
    sign = F.when(seconds < 0, "-").otherwise("+")
    minutes = F.floor(F.abs(seconds) / 60)
    return F.concat(sign, F.format_string("%02d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60))))


def placed_in_accounts(one: DataFrame, accounts: list[str] | None, by_account: bool) -> DataFrame:
    """one with account: given ones by any address of a message, else the ones that stand out, none if not wanted."""
    candidate = filing.account_candidate(F.col("box"), F.col("sender.addr"), F.col("headers"), F.transform("to", lambda a: a["addr"]))
    if not by_account:
        return one.withColumn("account", F.lit(None).cast("string"))
    if not accounts:
        return filing.assign_accounts(one.withColumn("candidate", candidate))
    delivered = [X.first_address(X.header_value(F.col("headers"), h)) for h in S.DELIVERY_HEADERS]
    people = F.concat(F.transform(F.concat("to", "cc"), lambda a: F.lower(a["addr"])), F.array(F.lower("sender.addr"), F.lower("reply_to.addr"), *delivered))
    return filing.explicit_accounts(one.withColumn("_people", people), "_people", accounts)


EMPTY = "uid string, hash string, nav string, folder string, first_seen string, last_built string"


def known_messages(spark: SparkSession, out: str, now: str) -> DataFrame:
    """The manifest of the last run; a lost one is recovered from the pages, whose newest part counts."""
    old = manifest.load(spark, f"{out}/manifest")
    if old is None and exists(spark, f"{out}/pages"):
        found = manifest.recover(spark.read.parquet(f"{out}/pages"), kept=["built"])
        one = found.groupBy("uid").agg(F.max_by(F.struct("hash", "nav", "folder"), "built").alias("m"), F.max("built").alias("built"))
        one.select("uid", "m.*", F.lit(now).alias("first_seen"), F.col("built").cast("string").alias("last_built")).write.mode("overwrite").parquet(f"{out}/work/recovered")
        old = spark.read.parquet(f"{out}/work/recovered")
    return old if old is not None else spark.createDataFrame([], EMPTY)


def current_pages(spark: SparkSession, out: str, name: str = "pages") -> DataFrame:
    """Pages (or files) of the archive: of each message those of the run that made it last."""
    made = manifest.load(spark, f"{out}/manifest").select("uid", F.col("last_built").alias("built"))
    return spark.read.parquet(f"{out}/{name}").withColumn("built", F.col("built").cast("string")).join(made, ["uid", "built"], "left_semi")


def build(
    spark: SparkSession, sources: list[str], out: str, now: str, accounts: list[str] | None = None, by_account: bool = True, prefix: str = "", prune: bool = False, force: bool = False,
    kind: str | None = None, limit: int = 0, by_year: bool = True, block_remote: bool = True,
) -> Stats:
    """Reads the sources and publishes to out. Refuses if nothing is read though something was published, unless pruning.

    limit ends reading after so many different messages. Pages and files are made for added and changed messages, and for those whose page is
    missing; those of messages that are gone are kept unless pruned.
    """
    order = F.create_map(*[x for i, p in enumerate(dict.fromkeys(sources)) for x in (F.lit(p), F.lit(i))])
    records = read_mail(spark, *sources, kind=kind)
    # sources count in the order they were given: the longest given path that a record's begins with is its own
    given = F.array_max(F.transform(F.filter(F.map_keys(order), lambda p: F.col("source").startswith(p)), lambda p: F.struct(F.length(p).alias("n"), order[p].alias("i"))))["i"]
    staged = f"{out}/work/records"
    records.withColumns({"given": F.coalesce(given, F.lit(len(sources))), "_failed": F.col("error").isNotNull()}).write.mode("overwrite").parquet(staged)
    read = spark.read.parquet(staged)
    errors = tuple(r[0] for r in read.where("_failed").select(F.concat_ws(": ", "source", "error")).limit(1000).collect())
    rows = normalise(read.drop("_failed"))
    rows = filing.first_uids(rows, limit) if limit else rows
    one = filing.dedupe_longest(rows)
    old = known_messages(spark, out, now)
    manifest.guard_empty(one, old, prune)
    placed = placed_in_accounts(one, accounts, by_account)
    path = X.place(F.col("account"), X.year_folder(F.col("date_local")) if by_year else None, F.col("box"), prefix)
    full = lambda a: X.full_address(a["name"], a["addr"])
    listed = F.transform("attachments", lambda a: F.concat_ws(":", a["filename"], a["size"].cast("string"), a["content_type"]))
    hashed = identity.content_hash(
        F.col("path"), F.col("subject"), full(F.col("sender")), F.col("iso"), F.array_join(F.transform("to", full), ","), F.array_join(F.transform("cc", full), ","),
        F.col("body_text"), F.col("body_html"), F.col("priority"), attachments=listed,
    )
    messages = listing.document_ids(placed.withColumn("path", path).withColumn("hash", hashed))
    messages = listing.neighbours(messages).withColumn("nav", F.concat_ws("|", "prev", "next"))
    messages.write.mode("overwrite").parquet(f"{out}/messages")
    messages = spark.read.parquet(f"{out}/messages")
    filing.slug_table(filing.folder_tree(messages)).write.mode("overwrite").parquet(f"{out}/folders")
    slugs = spark.read.parquet(f"{out}/folders")
    rows = messages.join(slugs.select("path", "slug"), "path").select(
        "slug", "idx", "uid", "subject", F.col("sender.name").alias("from_name"), F.col("sender.addr").alias("from_addr"), "epoch", "priority",
        listing.flags(F.col("has_attachments"), F.col("flagged"), F.col("unread")).alias("flags"), X.thread_key(F.col("references"), F.col("in_reply_to"), F.col("message_id"), F.col("uid")).alias("thread"), "size", "gid",
    )
    rows.repartitionByRange("slug", "idx").sortWithinPartitions("slug", "idx").write.mode("overwrite").partitionBy("slug").parquet(f"{out}/listing")
    people = F.transform(F.concat("to", "cc"), lambda a: F.concat_ws(" ", a["name"], a["addr"]))
    body = F.coalesce(F.nullif("body_text", F.lit("")), X.crude_text(F.col("body_html")))
    fields = {
        S.FIELD_SUBJECT: F.col("subject"), S.FIELD_SENDER: F.concat_ws(" ", "sender.name", "sender.addr", "organization"), S.FIELD_RECIPIENT: F.array_join(people, " "),
        S.FIELD_ATTACHMENT: F.array_join(F.transform("attachments", lambda a: a["filename"]), " "), S.FIELD_BODY: body,
    }
    index.write_index(index.postings(messages, "gid", fields), f"{out}/index")
    index.index_meta(spark.read.parquet(f"{out}/index")).write.mode("overwrite").parquet(f"{out}/index_meta")
    current = messages.select("uid", "hash", "nav", F.col("path").alias("folder"))
    made = None
    if exists(spark, f"{out}/pages"):
        made = spark.read.parquet(f"{out}/pages").select("uid", F.col("built").cast("string").alias("last_built")).join(old.select("uid", "last_built"), ["uid", "last_built"], "left_semi").select("uid").distinct()
    made = made if made is not None else old.select("uid").limit(0)
    actions = manifest.diff(current, old, force, pages=made)
    actions.write.mode("overwrite").parquet(f"{out}/work/actions")
    actions = spark.read.parquet(f"{out}/work/actions")
    fresh = messages.join(actions.where("action in ('added', 'updated')").select("uid"), "uid", "left_semi")
    pages(fresh, block_remote).write.mode("overwrite").parquet(f"{out}/pages/built={part_name(now)}")
    files(fresh).write.mode("overwrite").parquet(f"{out}/files/built={part_name(now)}")
    counts = manifest.stats(actions).first()
    rebuilt = actions.where("action in ('added', 'updated')").select("uid")
    told = manifest.next_manifest(current, old, part_name(now), prune, rebuilt=rebuilt)
    manifest.save(told, f"{out}/manifest", sources={p: {"fingerprint": fingerprint(p), "read": now} for p in sources})
    read_rows, kept = messages.agg(F.sum("copies"), F.count("*")).first()
    attachments = spark.read.parquet(f"{out}/files/built={part_name(now)}").count()
    return Stats(counts["added"], counts["updated"], counts["unchanged"], counts["gone"], counts["gone"] if prune else 0, attachments, (read_rows or 0) - kept, slugs.count(), errors)


def part_name(now: str) -> str:
    """A run's name as part of a path."""
    return "".join(c if c.isalnum() else "_" for c in now)


def page_html(spark: SparkSession, out: str, uid: str) -> str | None:
    """The page of a message, of the run that made it last."""
    row = current_pages(spark, out).where(F.col("uid") == uid).select("html").first()
    return row[0] if row else None


def search(spark: SparkSession, out: str, words: str, folder: str | None = None, prefix: str = "all", top: int = S.RESULTS) -> DataFrame:
    """Ranked hits over a published archive. The index's shards and the listing's folders are pruned."""
    docs = spark.read.parquet(f"{out}/listing")
    scope = F.col("slug") == folder if folder else None
    return index.search(spark.read.parquet(f"{out}/index"), docs, words, key="gid", epoch="epoch", scope=scope, top=top, prefix=prefix, shard_len=2)


def export_json(spark: SparkSession, out: str, title: str = "Archive", generator: str = "postquarry", built: str = "", news_host: str = "") -> None:
    """What clients read, written by the tasks: a JSON listing a folder in positional form, a JSON shard of the index for each start of words, the
    index's documents, and folders.json, which alone passes through the driver, a folder at a time."""
    rows = spark.read.parquet(f"{out}/folders")
    record = F.to_json(F.struct(*[F.col(c) for c in ("path", "name", "depth", "parent", "count", "unread", "slug")]))
    ordered = rows.withColumn("_k", X.folder_sort_key(F.col("path"))).orderBy("_k", "path").select("path", "depth", "count", record.alias("j"))
    accounts, folders, total = [], [], 0
    for r in ordered.toLocalIterator():
        folders.append(r["j"])
        accounts += [r["path"]] if r["depth"] == 0 else []
        total += r["count"]
    head = json.dumps({"title": title, "generator": generator, "built": built, "newsHost": news_host, "totalMessages": total, "accounts": accounts})
    write_text(spark, f"{out}/data/folders.json", f'{head[:-1]}, "folders": [{", ".join(folders)}]}}')
    listed = spark.read.parquet(f"{out}/listing")
    row = F.to_json(F.array(*[F.col(c).cast("string") for c in ("uid", "subject", "from_name", "from_addr", "epoch", "priority", "flags", "thread", "size")]))
    listed.select("slug", "idx", row.alias("value")).repartitionByRange("slug", "idx").sortWithinPartitions("slug", "idx").drop("idx").write.mode("overwrite").partitionBy("slug").text(f"{out}/data/msgs")
    docs = F.to_json(F.struct("gid", "uid", "slug", "idx"))
    listed.repartitionByRange("gid").sortWithinPartitions("gid").select(docs.alias("value")).write.mode("overwrite").text(f"{out}/data/search/docs")
    blocks = index.posting_blocks(spark.read.parquet(f"{out}/index")).withColumn("shard", X.shard_of(F.col("token"), 2))
    lists = blocks.select("shard", "token", "block", F.to_json(F.struct("token", "block", "entries")).alias("value"))
    lists.repartitionByRange("shard", "token", "block").sortWithinPartitions("shard", "token", "block").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(f"{out}/data/search/shards")
    meta = spark.read.parquet(f"{out}/index_meta").first().asDict()
    write_text(spark, f"{out}/data/search/meta.json", json.dumps(meta))
