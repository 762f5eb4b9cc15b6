"""De-duplication by uid, attribution to accounts, and placement in the account, year and folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions.text import first_address, header_value


def dedupe_longest(messages: DataFrame, uid: str = "uid", order: str = "read_ord", length: Column | None = None) -> DataFrame:
    """One row per uid: the copy with the longest body, the earliest among equals, in the place of the first arrival (slot).

    The copy is chosen by lengths alone and then fetched by its place in reading order, which is unique, so no body goes through the choice and only
    columns that are asked for through the join. Partial maxima are taken before the shuffle, so a uid with many copies is no hot spot. Rows without
    a uid are dropped.
    """
    body = length if length is not None else F.length(F.coalesce("body_text", F.lit(""))) + F.length(F.coalesce("body_html", F.lit("")))
    sized = messages.where(F.col(uid).isNotNull()).select(F.col(uid).alias("_uid"), F.col(order).alias("_o"), body.alias("_n"))
    longest = sized.groupBy("_uid").agg(F.max("_n").alias("_most"), F.min("_o").alias("slot"), F.count("*").alias("copies"))
    best = sized.join(longest, "_uid").where(F.col("_n").eqNullSafe(F.col("_most"))).groupBy("_uid").agg(F.min("_o").alias("_o"), F.first("slot").alias("slot"), F.first("copies").alias("copies"))
    kept = [c for c in messages.columns if c != uid]
    return messages.join(best, (F.col(order) == F.col("_o")) & (F.col(uid) == F.col("_uid"))).select(uid, *kept, "slot", "copies")


def first_uids(messages: DataFrame, n: int, uid: str = "uid", order: str = "read_ord") -> DataFrame:
    """Rows read until n different uids have been seen; copies after that are never read."""
    firsts = messages.groupBy(uid).agg(F.min(order).alias("_o")).orderBy("_o").limit(n)
    last = firsts.agg(F.max("_o")).first()[0]
    if last is None:
        return messages.limit(0)
    bound = F.struct(*[F.lit(v).alias(k) for k, v in last.asDict().items()]) if isinstance(last, Row) else F.lit(last)
    return messages.where(F.col(order) <= bound)


def account_candidate(folder: Column, sender: Column, headers: Column | None, to: Column) -> Column:
    """Mailbox a message was most likely filed in: its sender in folders of sent mail, else whom the delivering server names, else
    the first recipient, else the sender."""
    lower = lambda c: F.nullif(F.lower(F.coalesce(c, F.lit(""))), F.lit(""))
    top = F.regexp_extract(F.coalesce(folder, F.lit("")), "^([^/]*)", 1)
    named = [F.nullif(first_address(header_value(headers, h)), F.lit("")) for h in S.DELIVERY_HEADERS] if headers is not None else []
    first_to = F.get(F.filter(to, lambda a: F.coalesce(a, F.lit("")) != ""), F.lit(0))
    return F.coalesce(F.when(top.isin(S.SENT_LIKE), lower(sender)), *named, lower(first_to), lower(sender), F.lit(""))


def major_accounts(candidates: DataFrame, candidate: str = "candidate", order: str = "read_ord") -> DataFrame:
    """(candidate, n, first, total) of the accounts with at least a fiftieth of the messages, and three."""
    counts = candidates.groupBy(candidate).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where((F.col(candidate) != "") & (F.col("n") >= max(3, total // 50))).withColumn("total", F.lit(total))


def assign_accounts(candidates: DataFrame, candidate: str = "candidate", order: str = "read_ord") -> DataFrame:
    """candidates with account: with two or more major accounts each message goes to its own or to other recipients; with fewer all
    go to the most common candidate; without any candidate the recipient is unknown. Major accounts are less than fifty-one."""
    counts = candidates.where(F.col(candidate) != "").groupBy(candidate).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(51).collect()
    total = candidates.count()
    if not top:
        return candidates.withColumn("account", F.lit(S.UNKNOWN_ACCOUNT))
    major = [r[0] for r in top if r["n"] >= max(3, total // 50)]
    if len(major) <= 1:
        return candidates.withColumn("account", F.lit(top[0][0]))
    return candidates.withColumn("account", F.when(F.col(candidate).isin(major), F.col(candidate)).otherwise(S.OTHER_ACCOUNT))


def explicit_accounts(messages: DataFrame, addresses: str, accounts: list[str]) -> DataFrame:
    """messages with account: the first of the given accounts, as spelled, among a message's addresses, else other recipients."""
    account = F.coalesce(*[F.when(F.array_contains(addresses, a.lower()), a) for a in accounts], F.lit(S.OTHER_ACCOUNT))
    return messages.withColumn("account", account)


def with_ancestors(path: Column) -> Column:
    """A path and all paths above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def account_addresses(addresses: DataFrame, key: str = "read_ord") -> DataFrame:
    """(key, addrs): all different addresses of a message in lower case, sorted; messages without any have no row."""
    rows = addresses.where(F.coalesce("addr", F.lit("")) != "")
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(F.lower("addr"))).alias("addrs"))


def expanded_to(folders: DataFrame, target: str) -> DataFrame:
    """(path) of the folders that are open where a target is shown: itself and all above it."""
    return folders.select("path").where(F.array_contains(with_ancestors(F.lit(target)), F.col("path")))


def folder_tree(messages: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, depth, parent, count, unread): every folder that has messages or lies above one. Counts are of the folder itself."""
    own = messages.groupBy(path).agg(F.count("*").alias("count"), F.sum(F.col("unread").cast("int")).alias("unread"))
    every = own.select(F.explode(with_ancestors(F.col(path))).alias("path"), F.col(path).alias("_from"), "count", "unread")
    mine = F.col("path") == F.col("_from")
    tree = every.groupBy("path").agg(F.sum(F.when(mine, F.col("count")).otherwise(0)).alias("count"), F.sum(F.when(mine, F.coalesce("unread", F.lit(0))).otherwise(0)).alias("unread"))
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    return tree.select("path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), parent.alias("parent"), "count", "unread")


def branch_unread(messages: DataFrame, path: str = "path") -> DataFrame:
    """(path, unread): unread messages of a folder and all below it."""
    own = messages.groupBy(path).agg(F.sum(F.col("unread").cast("int")).alias("_n"))
    return own.select(F.explode(with_ancestors(F.col(path))).alias("path"), "_n").groupBy("path").agg(F.sum("_n").alias("unread"))


def number_slugs(bases: list[str]) -> list[str]:
    """Slugs in tree order; one that is taken gets -2, -3 and so on. A made slug may take a later folder's own."""
    taken: set[str] = set()
    out = []
    for base in bases:
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        out.append(slug)
    return out


def number_filenames(names: list[str]) -> list[str]:
    """Attachment names of one message, made different without regard to case; the number goes before the suffix."""
    taken: set[str] = set()
    out = []
    for name in names:
        n = 2
        made = name
        while made.lower() in taken:
            stem, dot, suffix = made.rpartition(".") if "." in made else (made, "", "")
            made = f"{stem}-{n}{dot}{suffix}"
            n += 1
        taken.add(made.lower())
        out.append(made)
    return out


def slug_table(folders: DataFrame) -> DataFrame:
    """folders with slug. The rule is sequential, so the folder dimension (not the messages) goes through one task."""
    from postquarry.functions.text import folder_sort_key, slugify

    keyed = folders.withColumns({"_key": folder_sort_key(F.col("path")), "_base": slugify(F.col("path"))}).orderBy("_key", "path")
    rows = [(r["path"], r["_base"]) for r in keyed.select("path", "_base").toLocalIterator()]
    slugs = number_slugs([b for _, b in rows])
    made = folders.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(rows, slugs)], "path string, slug string")
    return folders.join(made, "path")


def collapsed_years(folders: DataFrame) -> DataFrame:
    """(path, collapsed): year folders with children stay closed but for the newest under each parent."""
    year = F.col("name").rlike("^(19|20)[0-9]{2}$")
    parents = folders.select(F.col("parent").alias("path")).where("path is not null").distinct().withColumn("_has", F.lit(True))
    years = folders.join(parents, "path", "left").where(year & F.col("_has"))
    newest = Window.partitionBy("parent").orderBy(F.desc("name"), "path")
    return years.select("path", (F.row_number().over(newest) > 1).alias("collapsed"))


def hidden_rows(folders: DataFrame, collapsed: list[str]) -> DataFrame:
    """(path, hidden): whether a folder lies below a collapsed one."""
    above = with_ancestors(F.col("path"))
    closed = F.array(*[F.lit(x) for x in collapsed]).cast("array<string>")
    return folders.select("path", F.arrays_overlap(F.slice(above, 1, F.size(above) - 1), closed).alias("hidden"))
