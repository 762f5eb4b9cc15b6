"""Queries of the archive's own operators over whole tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions import identity, text as X
from postquarry.functions.compose import mailto
from postquarry.functions.html import sanitize_column, strip_tags_column, text_html_column
from postquarry.operators import filing, index, listing, manifest
from postquarry.tables import cut_lineage, new_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(key: str, values: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(str(k))} THEN {lit(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {other} END"


def subject_sql(x: str) -> str:
    bare = f"regexp_replace(coalesce({x},''), '(?i)^{WS}*(?:(?:re|fw|fwd|aw|sv|vs|antwort){WS}*(?:\\[\\d+\\])?{WS}*:{WS}*)+', '')"
    return f"trim(regexp_replace({bare}, '{WS}+', ' ', 'g'), ' ')"


def folder_sql(x: str) -> str:
    clean = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x},''), '^{WS}+', ''), '{WS}+$', ''), '^/+', ''), '/+$', '')"
    head = f"trim(split_part({clean}, '/', 1))"
    tail = f"CASE WHEN contains({clean}, '/') THEN substr({clean}, strpos({clean}, '/') + 1) ELSE '' END"
    named = case(f"lower({head})", S.FOLDER_ALIASES, head)
    return f"CASE WHEN {clean} = '' THEN 'Inbox' WHEN ({tail}) = '' THEN {named} ELSE {named} || '/' || ({tail}) END"


def id_sql(x: str) -> str:
    return f"regexp_replace(coalesce(nullif(regexp_extract(coalesce({x},''), '<([^>]*)>', 1), ''), coalesce({x},'')), '[<>\\s\\x{{a0}}]+', '', 'g')"


def fold_sql(x: str) -> str:
    return f"lower(strip_accents(translate(replace(coalesce({x},''), '…', '...'), 'ºª²³¹', 'oa231')))"


def whole_tokens_sql(x: str) -> str:
    raw = f"regexp_extract_all({fold_sql(x)}, '[a-z0-9][a-z0-9''._+\\-]*')"
    return f"list_filter(list_transform({raw}, lambda t: trim(t, '''._+-')), lambda t: length(t) BETWEEN 2 AND 60)"


def tokens_sql(x: str) -> str:
    pieces = "list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda p: length(p) BETWEEN 2 AND 40 AND p <> t)"
    return f"flatten(list_transform({whole_tokens_sql(x)}, lambda t: CASE WHEN regexp_matches(t, '[._+\\-]') THEN list_concat([t], {pieces}) ELSE [t] END))"


STOP = ", ".join(map(lit, S.STOPWORDS))
POSTINGS = f"""WITH fields AS (
  SELECT doc_id AS gid, unnest({tokens_sql('subject')}) AS token, 1 AS mask FROM documents
  UNION ALL SELECT doc_id, unnest({tokens_sql('source')}), 2 FROM documents
  UNION ALL SELECT doc_id, unnest({tokens_sql('text')}), 8 FROM documents),
postings AS (SELECT gid, token, bit_or(mask) AS mask FROM fields WHERE token NOT IN ({STOP}) GROUP BY gid, token)"""
EPOCH = "CAST(floor(epoch(posted_at)) AS BIGINT)"
SCORE = "60 * (mask & 1) + 40 * ((mask >> 1) & 1) + 15 * ((mask >> 2) & 1) + 6 * ((mask >> 3) & 1) + 12 * ((mask >> 4) & 1)"


def search_sql(terms: list[tuple[str, bool]], scope: str = "true") -> str:
    hit = [f"starts_with(token, {lit(t)})" if p else f"token = {lit(t)}" for t, p in terms]
    union = " UNION ALL ".join(f"SELECT gid, mask, {i} AS term FROM postings WHERE {h}" for i, h in enumerate(hit))
    return f"""{POSTINGS}, hits AS ({union}),
full_hits AS (SELECT gid, bit_or(mask) AS mask FROM hits GROUP BY gid HAVING count(DISTINCT term) = {len(terms)}),
scored AS (SELECT gid, mask, {EPOCH} AS epoch, {SCORE} + least(20.0, coalesce({EPOCH}, 0) / 86400.0 / 3650.0) AS score
  FROM full_hits JOIN documents ON gid = doc_id WHERE {scope})
SELECT gid, CAST(mask AS INTEGER) AS mask, round(score, 6) AS score FROM scored ORDER BY score DESC, coalesce(epoch, 0) DESC, gid LIMIT {S.RESULTS}"""


def doc_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "gid")
    return index.postings(docs, "gid", {1: F.col("subject"), 2: F.col("source"), 8: F.col("text")})


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    """What make() gives, made once in an application for the tables of a directory as they are now: archives and indexes are built once and queried often."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, d, name, state)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def written_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the documents, written by shard and sorted by token, so that a search reads the row groups of its terms."""

    def make() -> DataFrame:
        path = new_table(spark)
        index.write_index(doc_postings(spark, d), path, SHARD)
        return spark.read.parquet(path)

    return once(spark, d, "index", make)


SHARD = 2


def epoch_of(c: str) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def run_search(spark: SparkSession, d: str, words: str, scope: Column | None = None, **options) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("gid"), "source", epoch_of("posted_at").alias("epoch"))
    found = index.search(written_index(spark, d), docs, words, scope=scope, shard_len=SHARD, **options)
    return found.select("gid", "mask", F.round("score", 6).alias("score"))


@query(search_sql([("heavy", True), ("pump", True)]))
def search_two_terms(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "heavy pump")


@query(search_sql([("temp", True), ("serv", True)]))
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "temp serv")


@query(search_sql([("shared", True), ("queue", True)], "source = 'list-dev'"))
def search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "shared queue", scope=F.col("source") == "list-dev")


@query(search_sql([("the", True), ("queue", True)]))
def search_stopword_term(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "the queue")


@query(search_sql([("queue", True)]))
def search_stopword_dropped(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "the queue", drop_stopwords=True)


@query(search_sql([("queue", False), ("ledger", True)]))
def search_last_prefix(spark: SparkSession, d: str) -> DataFrame:
    return run_search(spark, d, "queue ledger", prefix="last")


@query(f"{POSTINGS} SELECT gid, token, CAST(mask AS INTEGER) AS mask FROM postings")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    return doc_postings(spark, d)


DELTA = "gid - coalesce(lag(gid) OVER (PARTITION BY token ORDER BY gid), 0)"


@query(f"{POSTINGS} SELECT gid, token, CAST({DELTA} AS BIGINT) AS delta FROM postings")
def postings_delta(spark: SparkSession, d: str) -> DataFrame:
    return index.deltas(doc_postings(spark, d)).select("gid", "token", "delta")


@query(f"{POSTINGS} SELECT gid, token, CAST(mask AS INTEGER) AS mask FROM postings")
def postings_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    coded = index.deltas(doc_postings(spark, d)).withColumn("pos", F.row_number().over(Window.partitionBy("token").orderBy("gid")))
    return index.undo_deltas(coded.select("token", "pos", "delta", "mask")).select("gid", "token", "mask")


@query(f"{POSTINGS} SELECT token, gid // {index.SPAN} AS block, string_agg(CAST(gid AS VARCHAR) || ':' || CAST(mask AS VARCHAR), ' ' ORDER BY gid) AS entries FROM postings GROUP BY ALL")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return index.posting_blocks(doc_postings(spark, d))


LENGTH = "CASE WHEN count(DISTINCT token) > 120000 THEN 3 WHEN count(DISTINCT token) > 12000 THEN 2 ELSE 1 END"


@query(f"{POSTINGS} SELECT count(DISTINCT token) AS tokens, count(*) AS entries, count(DISTINCT gid) AS docs, {LENGTH} AS shard_len FROM postings")
def index_meta(spark: SparkSession, d: str) -> DataFrame:
    return index.index_meta(doc_postings(spark, d))


@query(f"""{POSTINGS}, size AS (SELECT {LENGTH} AS n FROM postings)
SELECT coalesce(nullif(regexp_replace(left(token, n), '[^a-z0-9]', '_', 'g'), ''), '_') AS shard, count(DISTINCT token) AS tokens, count(*) AS entries FROM postings, size GROUP BY 1""")
def shard_table(spark: SparkSession, d: str) -> DataFrame:
    return index.shards(doc_postings(spark, d))


@query(f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM t")
def token_stream(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"""WITH w AS (SELECT read_ord, unnest({whole_tokens_sql('from_addr')}) AS token FROM messages)
SELECT token, piece, count(*) AS n FROM (SELECT token, unnest(list_filter(regexp_extract_all(token, '[a-z0-9]+'), lambda p: length(p) BETWEEN 2 AND 40 AND p <> token)) AS piece FROM w WHERE regexp_matches(token, '[._+\\-]')) GROUP BY ALL""")
def token_subparts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").groupBy(F.lower("from_addr").alias("a")).agg(F.count("*").alias("k"))
    tokens = rows.select("k", F.explode(X.whole_tokens(F.col("a"))).alias("token")).select("k", "token", F.explode(X.token_pieces(F.col("token"))).alias("piece"))
    return tokens.groupBy("token", "piece").agg(F.sum("k").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(t) AS INTEGER) AS emitted, CAST(least(len(t), {S.BODY_TOKENS}) AS INTEGER) AS taken, len(list_distinct(list_slice(t, 1, {S.BODY_TOKENS}))) AS kinds FROM t""")
def body_token_cap(spark: SparkSession, d: str) -> DataFrame:
    """The index's option of a bound on the tokens of a field."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    capped = F.slice("t", 1, S.BODY_TOKENS)
    return docs.select("doc_id", F.size("t").alias("emitted"), F.size(capped).alias("taken"), F.size(F.array_distinct(capped)).cast("bigint").alias("kinds"))


@query(f"{POSTINGS} SELECT CAST(mask AS INTEGER) AS mask, count(*) AS n FROM postings GROUP BY mask")
def field_mask(spark: SparkSession, d: str) -> DataFrame:
    return doc_postings(spark, d).groupBy("mask").agg(F.count("*").alias("n"))


@query(f"{POSTINGS} SELECT gid FROM postings WHERE token IN ('queue', 'ledger') GROUP BY gid HAVING count(DISTINCT token) = 2")
def term_intersection(spark: SparkSession, d: str) -> DataFrame:
    return index.matches(doc_postings(spark, d), "queue ledger", exact=True).select("gid")


@query(f"SELECT doc_id, len(list_filter({tokens_sql('text')}, lambda t: t NOT IN ({STOP}))) AS kept FROM documents")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    stop = F.array(*[F.lit(x) for x in S.STOPWORDS])
    kept = F.filter(X.tokenize(F.col("text")), lambda t: ~F.array_contains(stop, t))
    return table(spark, d, "documents").select("doc_id", F.size(kept).cast("bigint").alias("kept"))


@query("""SELECT doc_id, regexp_replace(replace(replace(replace(replace(coalesce(subject,''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(queue|the)', '<mark>\\1</mark>', 'gi') AS marked FROM documents""")
def highlight_subject(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.highlight(F.col("subject"), ["queue", "the"]).alias("marked"))


# ---- normalisers

@query(f"SELECT read_ord, {subject_sql('subject')} AS norm FROM messages")
def normalize_subject(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("read_ord", X.normalize_subject(F.col("subject")).alias("norm"))


LIST_SUBJECT = f"lower(regexp_replace(coalesce(subject,''), '(?i)^{WS}*(?:(?:re|fwd?|aw|sv){WS}*:{WS}*)+', ''))"


@query(f"SELECT read_ord, {LIST_SUBJECT} AS key, row_number() OVER (ORDER BY {LIST_SUBJECT}, read_ord) AS place FROM messages")
def list_subject_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").select("read_ord", X.list_subject(F.col("subject")).alias("key"))
    return listing.ranked(rows, [F.asc("key"), F.asc("read_ord")])


@query(f"SELECT folder, {folder_sql('folder')} AS norm, count(*) AS n FROM messages GROUP BY ALL")
def normalize_folder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").groupBy("folder").agg(F.count("*").alias("n")).select("folder", X.normalize_folder(F.col("folder")).alias("norm"), "n")


MAIL = f"""WITH mail AS (SELECT *, {id_sql('message_id')} AS mid, {folder_sql('folder')} AS box, CAST(floor(epoch(sent_at)) AS BIGINT) AS epoch,
  replace(coalesce(nullif(account,''), '{S.UNKNOWN_ACCOUNT}'), '/', '_') || '/' || coalesce(CAST(year(sent_at) AS VARCHAR), 'Undated') || '/' || ({folder_sql('folder')}) AS path,
  list_filter(list_transform(refs, lambda x: {id_sql('x')}), lambda x: x <> '') AS ids FROM messages),
keyed AS (SELECT *, CASE WHEN mid <> '' THEN substr(sha1('mid' || chr(0) || mid), 1, 20) ELSE coalesce(uid, 'r' || read_ord) END AS key,
  coalesce(nullif(ids[1], ''), nullif({id_sql('in_reply_to')}, ''), nullif(mid, ''), uid, 'r' || read_ord) AS thread FROM mail)"""
ONE = f"""{MAIL}, one AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(coalesce(body_text,'')) + length(coalesce(body_html,'')) DESC, read_ord) = 1)"""


def mail(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries with bare identifier, folder, place and thread; mail without an account is placed under the unknown one."""
    rows = table(spark, d, "messages")
    ids = F.filter(F.transform("refs", lambda x: X.clean_message_id(x)), lambda x: x != "")
    box = X.normalize_folder(F.col("folder"))
    account = F.coalesce(F.nullif("account", F.lit("")), F.lit(S.UNKNOWN_ACCOUNT))
    rows = rows.withColumns({"mid": X.clean_message_id(F.col("message_id")), "box": box, "epoch": epoch_of("sent_at"), "path": X.place(account, X.year_folder(F.col("sent_at")), box), "ids": ids})
    other = F.coalesce("uid", F.concat(F.lit("r"), F.col("read_ord").cast("string")))
    known = F.substring(F.sha1(F.concat(F.lit(b"mid\x00"), F.encode("mid", "utf-8"))), 1, 20)
    return rows.withColumns({"key": F.when(F.col("mid") != "", known).otherwise(other), "thread": X.thread_key(F.col("ids"), X.clean_message_id(F.col("in_reply_to")), F.col("mid"), other)})


def one_each(spark: SparkSession, d: str) -> DataFrame:
    """The archive's messages without repeated ones."""
    return filing.dedupe_longest(mail(spark, d).withColumnRenamed("uid", "given_uid"), "key").withColumnRenamed("key", "uid")


LISTED = ["uid", "read_ord", "slot", "copies", "account", "folder", "box", "path", "epoch", "sent_at", "subject", "from_addr", "mid", "thread", "priority", "unread", "flagged", "has_attachments", "size_bytes", "batch_id"]


def archive(spark: SparkSession, d: str) -> DataFrame:
    """What lists, trees and runs need of one_each, published once as a table without bodies; content is the hash of what pages show."""
    content = identity.content_hash(F.col("subject"), F.col("body_text"))
    return once(spark, d, "archive", lambda: cut_lineage(one_each(spark, d).select(*LISTED, content.alias("content"))))


@query(f"{MAIL} SELECT path, count(*) AS n FROM keyed GROUP BY path")
def place_path(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).groupBy("path").agg(F.count("*").alias("n"))


ORDER_KEY = "list_transform(string_split(box, '/'), lambda p: CASE WHEN regexp_full_match(p, '(19|20)[0-9]{2}') THEN '0' || CAST(9999 - CAST(p AS INTEGER) AS VARCHAR) WHEN list_contains([" + ", ".join(map(lit, S.FOLDER_ORDER)) + "], p) THEN '1' || CAST(list_position([" + ", ".join(map(lit, S.FOLDER_ORDER)) + "], p) AS VARCHAR) ELSE '2' || lower(p) END)"


@query(f"{MAIL} SELECT box, CAST(row_number() OVER (ORDER BY {ORDER_KEY}, box) AS INTEGER) AS place FROM (SELECT DISTINCT box FROM keyed)")
def folder_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    boxes = mail(spark, d).select("box").distinct().withColumn("_k", X.folder_sort_key(F.col("box")))
    # the folder dimension only
    return boxes.select("box", F.row_number().over(Window.orderBy("_k", "box")).alias("place"))


FILES = "regexp_replace(split_part(store_path, '/', -1) || suffix, '(?i)(\\.(gz|bz2|xz|lzma|z|mbox|mbx|mbs))+$', '')"
SUFFIXES = [".mbox", ".mbox.gz", ".mbx.xz", "", ".txt"]


@query(f"SELECT source_id, suffix, {folder_sql(FILES)} AS folder FROM sources, (SELECT unnest([{', '.join(map(lit, SUFFIXES))}]) AS suffix)")
def folder_from_filename(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sources").withColumn("suffix", F.explode(F.array(*[F.lit(x) for x in SUFFIXES])))
    return rows.select("source_id", "suffix", X.folder_from_filename(F.concat("store_path", "suffix")).alias("folder"))


@query(f"{MAIL} SELECT read_ord, mid, thread, CAST(len(ids) AS INTEGER) AS n FROM keyed")
def message_id_refs_thread_key(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).select("read_ord", "mid", "thread", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"))


@query(f"{MAIL} SELECT read_ord, key FROM keyed")
def uid_message_id(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).select("read_ord", "key")


SYN = f"sha1('syn' || chr(0) || coalesce(nullif(strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00'), ''), '') || chr(0) || lower(coalesce(source,'')) || chr(0) || lower({subject_sql('subject')}) || chr(0) || '' || chr(0) || substr(coalesce(text,''), 1, 4096) || chr(0))"


@query(f"SELECT doc_id, substr({SYN}, 1, 20) AS uid FROM documents")
def uid_synthetic(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    made = identity.uid(F.lit(""), iso, F.lit(""), F.col("source"), F.col("subject"), F.array().cast("array<string>"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", made.alias("uid"))


HASHED = " || ".join(f"coalesce({c},'') || chr(0)" for c in ("folder", "subject", "from_addr", "date_raw", "body_text", "body_html", "priority"))


@query(f"SELECT read_ord, substr(sha1({HASHED}), 1, 16) AS hash FROM messages")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    pieces = [F.col(c) for c in ("folder", "subject", "from_addr", "date_raw", "body_text", "body_html", "priority")]
    return table(spark, d, "messages").select("read_ord", identity.content_hash(*pieces).alias("hash"))


@query(f"""WITH a AS (SELECT read_ord, string_agg(coalesce(filename,'') || ':' || CAST(coalesce(size_bytes,0) AS VARCHAR) || ':' || coalesce(content_type,'') || chr(0), '' ORDER BY attachment_id) AS files FROM attachments GROUP BY read_ord)
SELECT m.read_ord, substr(sha1(coalesce(subject,'') || chr(0) || coalesce(files,'')), 1, 16) AS hash FROM messages m LEFT JOIN a ON m.read_ord = a.read_ord""")
def content_hash_attachments(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat_ws(":", X.text("filename"), F.coalesce("size_bytes", F.lit(0)).cast("string"), X.text("content_type"))
    files = table(spark, d, "attachments").groupBy("read_ord").agg(F.sort_array(F.collect_list(F.struct("attachment_id", one.alias("f")))).alias("_f"))
    rows = table(spark, d, "messages").select("read_ord", "subject").join(files, "read_ord", "left")
    return rows.select("read_ord", identity.content_hash(F.col("subject"), attachments=F.transform("_f", lambda x: x["f"])).alias("hash"))


# ---- de-duplication and accounts

@query(f"{ONE} SELECT key, read_ord, subject FROM one")
def dedupe_longest(spark: SparkSession, d: str) -> DataFrame:
    return one_each(spark, d).select(F.col("uid").alias("key"), "read_ord", "subject")


@query(f"{MAIL} SELECT count(*) AS read, count(DISTINCT key) AS kept, count(*) - count(DISTINCT key) AS duplicates FROM keyed")
def dedupe_stats(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).agg(F.count("*").alias("read"), F.count_distinct("key").alias("kept"), (F.count("*") - F.count_distinct("key")).alias("duplicates"))


@query(f"{MAIL}, firsts AS (SELECT key, min(read_ord) AS o FROM keyed GROUP BY key ORDER BY o LIMIT 100) SELECT read_ord, key FROM keyed WHERE read_ord <= (SELECT max(o) FROM firsts)")
def dedupe_limit(spark: SparkSession, d: str) -> DataFrame:
    return filing.first_uids(mail(spark, d), 100, "key").select("read_ord", "key")


CANDIDATES = f"""WITH tos AS (SELECT read_ord, arg_min(lower(addr), CAST(pos AS BIGINT) * 1000000000 + address_id) AS first_to FROM addresses WHERE header_kind = 'to' AND coalesce(addr,'') <> '' GROUP BY read_ord),
cand AS (SELECT m.read_ord, coalesce(CASE WHEN split_part({folder_sql('folder')}, '/', 1) IN ('Sent', 'Drafts', 'Unsent Messages', 'Templates') THEN nullif(lower(from_addr), '') END, first_to, nullif(lower(from_addr), ''), '') AS candidate
  FROM messages m LEFT JOIN tos ON m.read_ord = tos.read_ord)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    to = table(spark, d, "addresses").where("header_kind = 'to' and coalesce(addr, '') <> ''").groupBy("read_ord").agg(F.min_by("addr", F.struct("pos", "address_id")).alias("first_to"))
    rows = table(spark, d, "messages").select("read_ord", "from_addr", "folder").join(to, "read_ord", "left")
    found = filing.account_candidate(X.normalize_folder(F.col("folder")), F.col("from_addr"), None, F.array("first_to"))
    return rows.select("read_ord", found.alias("candidate"))


@query(f"{CANDIDATES} SELECT read_ord, candidate FROM cand")
def account_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d)


@query(f"{CANDIDATES} SELECT candidate, count(*) AS n FROM cand WHERE candidate <> '' GROUP BY candidate HAVING count(*) >= greatest(3, (SELECT count(*) // 50 FROM cand))")
def account_major(spark: SparkSession, d: str) -> DataFrame:
    return filing.major_accounts(candidates(spark, d)).select("candidate", "n")


@query(f"""{CANDIDATES}, c AS (SELECT candidate, count(*) AS n, min(read_ord) AS o FROM cand WHERE candidate <> '' GROUP BY candidate),
major AS (SELECT candidate FROM c WHERE n >= greatest(3, (SELECT count(*) // 50 FROM cand))), top AS (SELECT candidate FROM c ORDER BY n DESC, o LIMIT 1)
SELECT read_ord, CASE WHEN (SELECT count(*) FROM major) <= 1 THEN (SELECT candidate FROM top) WHEN candidate IN (SELECT candidate FROM major) THEN candidate ELSE 'Other Recipients' END AS account FROM cand""")
def account_single_dominant(spark: SparkSession, d: str) -> DataFrame:
    return filing.assign_accounts(candidates(spark, d)).select("read_ord", "account")


GIVEN = ["Jocasta_Wet0@lanternfield.example", "tindra_bra1@windrush.example"]


@query(f"""WITH a AS (SELECT read_ord, list(lower(addr)) AS l FROM addresses WHERE addr IS NOT NULL GROUP BY read_ord)
SELECT m.read_ord, CASE WHEN list_contains(l, {lit(GIVEN[0].lower())}) THEN {lit(GIVEN[0])} WHEN list_contains(l, {lit(GIVEN[1])}) THEN {lit(GIVEN[1])} ELSE 'Other Recipients' END AS account FROM messages m LEFT JOIN a ON m.read_ord = a.read_ord""")
def account_explicit(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "addresses").groupBy("read_ord").agg(F.collect_set(F.lower("addr")).alias("l"))
    rows = table(spark, d, "messages").select("read_ord").join(sets, "read_ord", "left")
    return filing.explicit_accounts(rows, "l", GIVEN).select("read_ord", "account")


@query(f"{MAIL} SELECT root, row_number() OVER (ORDER BY root) AS place FROM (SELECT DISTINCT split_part(path, '/', 1) AS root FROM keyed)")
def account_roots(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    roots = mail(spark, d).select(F.split("path", "/")[0].alias("root")).distinct()
    return roots.withColumn("place", F.row_number().over(Window.orderBy("root")).cast("bigint"))


@query("SELECT read_ord, array_to_string(list_sort(list(DISTINCT lower(addr))), ',') AS addrs FROM addresses WHERE coalesce(addr,'') <> '' GROUP BY read_ord")
def all_addresses(spark: SparkSession, d: str) -> DataFrame:
    return filing.account_addresses(table(spark, d, "addresses")).select("read_ord", F.array_join("addrs", ",").alias("addrs"))


# ---- tree

TREE = f"""{ONE}, own AS (SELECT path, count(*) AS n, sum(CAST(coalesce(unread, false) AS INTEGER)) AS u FROM one GROUP BY path),
above AS (SELECT path AS src, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path, n, u FROM own, (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(string_split(own.path, '/')))"""


@query(f"""{TREE} SELECT path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, CAST(sum(CASE WHEN src = path THEN n ELSE 0 END) AS BIGINT) AS count, CAST(sum(CASE WHEN src = path THEN u ELSE 0 END) AS BIGINT) AS unread FROM above GROUP BY path""")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return filing.folder_tree(archive(spark, d)).select("path", "depth", "count", "unread")


@query(f"{TREE} SELECT DISTINCT path FROM above")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).select("path").distinct().select(F.explode(filing.with_ancestors(F.col("path"))).alias("path")).distinct()


@query(f"{TREE} SELECT path, CAST(sum(u) AS BIGINT) AS unread FROM above GROUP BY path")
def tree_unread_rollup(spark: SparkSession, d: str) -> DataFrame:
    return filing.branch_unread(archive(spark, d)).select("path", F.coalesce("unread", F.lit(0)).alias("unread"))


@query(f"{ONE} SELECT account, coalesce(CAST(year(sent_at) AS VARCHAR), 'Undated') AS y, box, count(*) AS n FROM one GROUP BY ROLLUP (account, y, box)")
def tree_rollup_builtin(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).select("account", X.year_folder(F.col("sent_at")).alias("y"), "box").rollup("account", "y", "box").agg(F.count("*").alias("n"))


@query(f"""{TREE}, tree AS (SELECT DISTINCT path, split_part(path, '/', -1) AS name, regexp_replace(path, '/[^/]*$', '') AS parent FROM above),
years AS (SELECT * FROM tree WHERE regexp_full_match(name, '(19|20)[0-9]{{2}}') AND path IN (SELECT parent FROM tree WHERE contains(path, '/')))
SELECT path, row_number() OVER (PARTITION BY parent ORDER BY name DESC, path) > 1 AS collapsed FROM years""")
def tree_initial_collapse(spark: SparkSession, d: str) -> DataFrame:
    return filing.collapsed_years(filing.folder_tree(archive(spark, d)))


CLOSED = ["jocasta_wet0@lanternfield.example", "tindra_bra1@windrush.example/2005"]


@query(f"{TREE} SELECT DISTINCT path, starts_with(path, {lit(CLOSED[0] + '/')}) OR starts_with(path, {lit(CLOSED[1] + '/')}) AS hidden FROM above")
def tree_hidden_rows(spark: SparkSession, d: str) -> DataFrame:
    return filing.hidden_rows(filing.folder_tree(archive(spark, d)), CLOSED)


@query(f"{TREE}, tree AS (SELECT DISTINCT path FROM above) SELECT p.path, count(c.path) AS children FROM tree p LEFT JOIN tree c ON regexp_replace(c.path, '/[^/]*$', '') = p.path AND c.path <> p.path GROUP BY p.path")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    tree = filing.folder_tree(archive(spark, d))
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return tree.select("path").join(kids, "path", "left").select("path", F.coalesce("children", F.lit(0)).alias("children"))


TARGET = "jocasta_wet0@lanternfield.example/2005/Inbox"


@query(f"{TREE} SELECT DISTINCT path FROM above WHERE {lit(TARGET)} = path OR starts_with({lit(TARGET)}, path || '/')")
def tree_expand_to(spark: SparkSession, d: str) -> DataFrame:
    return filing.expanded_to(filing.folder_tree(archive(spark, d)), TARGET)


@query(f"{ONE} SELECT folder, n, row_number() OVER (ORDER BY coalesce(folder, ''), folder IS NULL) AS place FROM (SELECT folder, count(*) AS n FROM one GROUP BY folder)")
def info_by_folder(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = archive(spark, d).groupBy("folder").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(X.text("folder"), F.col("folder").isNull())).cast("bigint"))


@query(f"{ONE} SELECT count(*) AS total FROM one")
def total_listed(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).agg(F.count("*").alias("total"))


# ---- listings

NEWEST = "PARTITION BY path ORDER BY coalesce(epoch, 0) DESC, key DESC"
BITS = "CAST(coalesce(has_attachments, false) AS INTEGER) + 2 * CAST(coalesce(flagged, false) AS INTEGER) + 4 * CAST(coalesce(unread, false) AS INTEGER)"


@query(f"{ONE} SELECT key AS uid, path, CAST(row_number() OVER ({NEWEST}) - 1 AS INTEGER) AS idx, {BITS} AS flags, thread, size_bytes FROM one")
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = listing.listing(archive(spark, d))
    return rows.select("uid", "path", "idx", listing.flags(F.col("has_attachments"), F.col("flagged"), F.col("unread")).alias("flags"), "thread", "size_bytes")


PATH_KEY = ORDER_KEY.replace("string_split(box", "string_split(path")


@query(f"""{ONE}, f AS (SELECT path, count(*) AS n, {PATH_KEY} AS k FROM one GROUP BY path), o AS (SELECT path, coalesce(sum(n) OVER (ORDER BY k, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f)
SELECT key AS uid, CAST(start + row_number() OVER (PARTITION BY one.path ORDER BY coalesce(epoch, 0) DESC, key DESC) - 1 AS BIGINT) AS gid FROM one JOIN o ON one.path = o.path""")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return listing.document_ids(archive(spark, d)).select("uid", F.col("gid").cast("bigint").alias("gid"))


@query(f"{ONE} SELECT key AS uid, coalesce(lag(key) OVER w, '') AS prev, coalesce(lead(key) OVER w, '') AS next FROM one WINDOW w AS ({NEWEST})")
def prev_next(spark: SparkSession, d: str) -> DataFrame:
    return listing.neighbours(archive(spark, d)).select("uid", "prev", "next")


RANK = case("coalesce(priority,'')", S.PRIORITY_RANK, "0")


@query(f"{ONE} SELECT key AS uid, {RANK} AS rank, row_number() OVER (ORDER BY {RANK} DESC, coalesce(epoch, 0) DESC, key) AS place FROM one")
def list_sort_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = listing.ranked(archive(spark, d), listing.sort_order("priority"))
    return rows.select("uid", X.priority_rank(F.col("priority")).alias("rank"), "place")


@query(f"{ONE} SELECT key AS uid, coalesce(from_addr, '') AS sender, row_number() OVER (ORDER BY coalesce(from_addr, ''), coalesce(epoch, 0), key) AS place FROM one")
def list_sort_sender(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d).withColumn("from_name", F.lit(""))
    return listing.ranked(rows, listing.sort_order("sender", descending=False)).select("uid", X.text("from_addr").alias("sender"), "place")


@query(f"{ONE} SELECT key AS uid, coalesce(epoch, 0) AS epoch FROM one ORDER BY coalesce(epoch, 0) DESC, key LIMIT 50 OFFSET 100")
def list_page_window(spark: SparkSession, d: str) -> DataFrame:
    return listing.sort_list(archive(spark, d)).offset(100).limit(50).select("uid", F.coalesce("epoch", F.lit(0)).alias("epoch"))


@query(f"{ONE} SELECT key AS uid, thread, CAST(row_number() OVER (PARTITION BY thread ORDER BY coalesce(epoch, 0), key) AS INTEGER) AS member FROM one")
def threads_flat(spark: SparkSession, d: str) -> DataFrame:
    return listing.threads(archive(spark, d)).select("uid", "thread", "member")


@query(f"""{ONE}, g AS (SELECT thread, count(*) AS size, max(coalesce(epoch, 0)) AS newest, last(key ORDER BY coalesce(epoch, 0), key) AS newest_uid FROM one GROUP BY thread)
SELECT *, row_number() OVER (ORDER BY newest DESC, newest_uid) AS place FROM g""")
def threads_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Threads with their place in the list: the one written to last comes first."""
    return listing.ranked(listing.thread_groups(archive(spark, d)), [F.desc("newest"), F.asc("newest_uid")])


@query(f"""{ONE}, p AS (SELECT key, path, coalesce(unread, false) AS u, row_number() OVER ({NEWEST}) AS i FROM one),
n AS (SELECT key, path, i, min(CASE WHEN u THEN i END) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM p)
SELECT n.key AS uid, q.key AS next_unread FROM n LEFT JOIN p q ON n.path = q.path AND n.j = q.i""")
def next_unread(spark: SparkSession, d: str) -> DataFrame:
    return listing.next_unread(archive(spark, d)).select("uid", "next_unread")


@query(f"{ONE} SELECT key AS uid FROM one WHERE coalesce(unread, false)")
def unread_view(spark: SparkSession, d: str) -> DataFrame:
    return listing.unread_rows(archive(spark, d)).select("uid")


@query(f"{ONE} SELECT key AS uid FROM one WHERE coalesce(unread, false) AND key NOT IN (SELECT key FROM keyed WHERE coalesce(flagged, false))")
def read_marks_anti(spark: SparkSession, d: str) -> DataFrame:
    marks = mail(spark, d).where("coalesce(flagged, false)").select(F.col("key").alias("uid"))
    return listing.unread_rows(archive(spark, d), marks).select("uid")


@query(f"{MAIL} SELECT DISTINCT key AS uid FROM keyed WHERE coalesce(flagged, false) OR box = 'Sent'")
def read_mark_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = mail(spark, d).withColumn("uid", F.col("key"))
    return listing.mark_read(rows.where("coalesce(flagged, false)"), rows.where("box = 'Sent'"))


# ---- manifest: messages of even and of later batches stand for two runs

RUNS = f"""{ONE}, state AS (SELECT key AS uid, batch_id, read_ord, box AS folder, substr(sha1(coalesce(subject,'') || chr(0) || coalesce(body_text,'') || chr(0)), 1, 16) AS hash, coalesce(thread,'') AS nav FROM one),
now AS (SELECT * FROM state WHERE batch_id % 5 <> 0), was AS (SELECT uid, CASE WHEN batch_id % 7 = 1 THEN 'old' ELSE hash END AS hash, nav, folder, CAST(batch_id AS VARCHAR) AS first_seen FROM state WHERE batch_id % 4 <> 0)"""
ACTIONS = """actions AS (SELECT coalesce(n.uid, w.uid) AS uid, CASE WHEN n.uid IS NULL THEN 'gone' WHEN w.uid IS NULL THEN 'added' WHEN n.hash <> w.hash OR n.nav <> w.nav THEN 'updated' ELSE 'unchanged' END AS action
FROM now n FULL OUTER JOIN was w ON n.uid = w.uid)"""


def two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    state = archive(spark, d).select("uid", "batch_id", F.col("box").alias("folder"), F.col("content").alias("hash"), X.text("thread").alias("nav"))
    was = state.where("batch_id % 4 <> 0").withColumn("hash", F.when(F.col("batch_id") % 7 == 1, "old").otherwise(F.col("hash")))
    was = was.select("uid", "hash", "nav", "folder", F.col("batch_id").cast("string").alias("first_seen"), F.lit("then").alias("last_built"))
    return state.where("batch_id % 5 <> 0"), was


@query(f"{RUNS}, {ACTIONS} SELECT uid, action FROM actions")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return manifest.diff(*two_runs(spark, d))


@query(f"{RUNS}, {ACTIONS} SELECT uid FROM actions WHERE action = 'gone'")
def manifest_gone(spark: SparkSession, d: str) -> DataFrame:
    now, was = two_runs(spark, d)
    return was.join(now, "uid", "left_anti").select("uid")


@query(f"{RUNS} SELECT uid, hash, folder FROM now UNION ALL SELECT uid, hash, folder FROM was WHERE uid NOT IN (SELECT uid FROM now)")
def manifest_kept_union(spark: SparkSession, d: str) -> DataFrame:
    return manifest.next_manifest(*two_runs(spark, d), now="now").select("uid", "hash", "folder")


@query(f"{RUNS} SELECT n.uid, coalesce(first_seen, 'now') AS first_seen FROM now n LEFT JOIN was w ON n.uid = w.uid")
def first_seen_retained(spark: SparkSession, d: str) -> DataFrame:
    return manifest.next_manifest(*two_runs(spark, d), now="now", prune=True).select("uid", "first_seen")


@query(f"{RUNS}, {ACTIONS} SELECT count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'gone') AS gone, (SELECT count(*) - count(DISTINCT key) FROM keyed) AS duplicates FROM actions")
def build_stats(spark: SparkSession, d: str) -> DataFrame:
    copies = mail(spark, d).agg((F.count("*") - F.count_distinct("key"))).first()[0]
    return manifest.stats(manifest.diff(*two_runs(spark, d)), copies)


@query(f"{ONE} SELECT key AS uid FROM one WHERE key NOT IN (SELECT key FROM keyed WHERE coalesce(flagged, false))")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = mail(spark, d).where("coalesce(flagged, false)").select(F.col("key").alias("uid"))
    return archive(spark, d).join(pages, "uid", "left_anti").select("uid")


@query(f"{ONE} SELECT key AS uid, box AS folder, subject FROM one")
def manifest_recovery(spark: SparkSession, d: str) -> DataFrame:
    rows = archive(spark, d)
    meta = F.to_json(F.struct("uid", F.col("box").alias("folder"), F.lit("h").alias("hash"), "subject", F.lit("").alias("nav"), F.col("epoch").alias("date")))
    return manifest.recover(rows.select(manifest.page_html(meta, F.lit("<p>text</p>")).alias("html"))).select("uid", "folder", "subject")


@query(f"{ONE} SELECT key AS uid, subject, priority, coalesce(epoch, 0) AS epoch, substr(coalesce(body_text,''), 1, 1400) AS quote FROM one")
def page_meta_json(spark: SparkSession, d: str) -> DataFrame:
    made = F.to_json(F.struct("uid", "subject", "priority", F.coalesce("epoch", F.lit(0)).alias("epoch"), F.substring(X.text("body_text"), 1, S.QUOTE_CHARS).alias("quote")))
    back = F.from_json(made, "uid string, subject string, priority string, epoch bigint, quote string")
    return one_each(spark, d).select(back.alias("m")).select("m.*")


@query("SELECT address_id, coalesce(addr_name,'') AS n, coalesce(addr,'') AS a FROM addresses")
def record_codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "addresses").select("address_id", F.to_json(F.struct(F.col("addr_name").alias("n"), F.col("addr").alias("a"))).alias("j"))
    back = F.from_json("j", "n string, a string")
    return rows.select("address_id", back.alias("r")).select("address_id", X.text("r.n").alias("n"), X.text("r.a").alias("a"))


# ---- headers, labels and files

HAS = "list_transform(string_split({}, ','), lambda x: lower(trim(x)))"


@query(f"""{MAIL}, l AS (SELECT read_ord, {HAS.format("coalesce(box,'') || ',Important' || CASE WHEN coalesce(unread, false) THEN ',Unread' ELSE '' END")} AS l, box FROM keyed)
SELECT read_ord, CASE WHEN list_has_any(l, ['draft', 'drafts']) THEN 'Drafts' WHEN list_contains(l, 'sent') THEN 'Sent' WHEN list_has_any(l, ['trash', 'bin']) THEN 'Trash' WHEN list_has_any(l, ['spam', 'junk']) THEN 'Junk' WHEN list_contains(l, 'inbox') THEN 'Inbox' ELSE {folder_sql('box')} END AS folder FROM l""")
def gmail_labels_folder(spark: SparkSession, d: str) -> DataFrame:
    from postquarry.sources.labels import labels_folder

    labels = F.concat(X.text("box"), F.lit(",Important"), F.when(F.coalesce("unread", F.lit(False)), ",Unread").otherwise(""))
    return mail(spark, d).select("read_ord", labels_folder(labels).alias("folder"))


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'RO' WHEN 'F' THEN 'F' WHEN 'P' THEN 'O' ELSE '' END"


@query(f"SELECT o_orderkey, ({STATUS}) <> '' AND NOT contains({STATUS}, 'R') AS unread, contains({STATUS}, 'F') AS flagged FROM orders")
def status_flags(spark: SparkSession, d: str) -> DataFrame:
    status = X.mapping(F.col("o_orderstatus"), {"O": "RO", "F": "F", "P": "O"})
    return table(spark, d, "orders").select("o_orderkey", X.status_flags(status).alias("s")).select("o_orderkey", "s.*")


@query("SELECT o_orderkey, " + case("left(o_orderpriority, 1)", {k: v for k, v in S.PRIORITIES.items() if k.isdigit()}, "''") + " AS priority FROM orders")
def priority_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.priority_name(F.regexp_replace("o_orderpriority", "-", " ")).alias("priority"))


@query("SELECT o_orderkey, " + case("priority", S.PRIORITY_RANK, "0") + " AS rank FROM (SELECT o_orderkey, " + case("left(o_orderpriority, 1)", {"1": "Highest", "2": "High", "3": "Normal", "4": "Low", "5": "Lowest"}, "''") + " AS priority FROM orders)")
def priority_rank(spark: SparkSession, d: str) -> DataFrame:
    name = X.text(X.mapping(F.substring("o_orderpriority", 1, 1), {"1": "Highest", "2": "High", "3": "Normal", "4": "Low", "5": "Lowest"}))
    return table(spark, d, "orders").select("o_orderkey", X.priority_rank(name).alias("rank"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(replace(c_name, '#', '')) || '@mail.example' END AS addr FROM customer")
def delivery_header_lookup(spark: SparkSession, d: str) -> DataFrame:
    head = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    box = F.concat(F.lit("Box <"), F.replace(F.col("c_name"), F.lit("#"), F.lit("")), F.lit("@mail.example>"))
    mark = F.when(F.col("c_custkey") % 3 == 0, "undisclosed").otherwise(box)
    headers = F.array(head("Received", F.lit("by x")), head("DELIVERED-TO", mark), head("Delivered-To", F.lit("second@mail.example")))
    rows = table(spark, d, "customer").withColumn("headers", headers)
    return rows.select("c_custkey", X.first_address(X.header_value(F.col("headers"), "Delivered-To")).alias("addr"))



@query("SELECT address_id, coalesce(nullif(addr_name,''), nullif(addr,''), '(unknown)') AS display, CASE WHEN coalesce(addr_name,'') <> '' AND coalesce(addr,'') <> '' THEN '\"' || addr_name || '\" <' || addr || '>' WHEN coalesce(addr,'') <> '' THEN addr ELSE coalesce(addr_name,'') END AS whole FROM addresses")
def address_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "addresses").select("address_id", X.display(F.col("addr_name"), F.col("addr")).alias("display"), X.full_address(F.col("addr_name"), F.col("addr")).alias("whole"))


def rounded_sql(x: str, unit: int) -> str:
    """x / unit to the nearest whole number, halves to the even one."""
    whole, twice = f"(({x}) // {unit})", f"(2 * (({x}) % {unit}))"
    return f"({whole} + CASE WHEN {twice} > {unit} OR {twice} = {unit} AND {whole} % 2 = 1 THEN 1 ELSE 0 END)"


TENTHS = rounded_sql("CAST(size_bytes AS HUGEINT) * 10", 1048576)


@query(f"SELECT read_ord, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN {rounded_sql('size_bytes', 1024)} || ' KB' ELSE ({TENTHS} // 10) || '.' || ({TENTHS} % 10) || ' MB' END AS size FROM messages")
def size_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("read_ord", X.size_text(F.col("size_bytes")).alias("size"))


@query("SELECT DISTINCT uid, 'msg/' || substr(uid, 1, 2) || '/' || uid || '.html' AS page FROM messages WHERE uid IS NOT NULL")
def page_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("uid is not null").select("uid", X.page_path(F.col("uid")).alias("page")).distinct()


@query(f"SELECT DISTINCT source, coalesce(nullif(trim(regexp_replace({fold_sql('source')}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'folder') AS slug FROM documents")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select("source", X.slugify(F.col("source")).alias("slug"))


@query("SELECT read_ord, coalesce(CAST(year(sent_at) AS VARCHAR), 'Undated') AS y FROM messages")
def year_folder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("read_ord", X.year_folder(F.col("sent_at")).alias("y"))


@query()
def slug_collisions(spark: SparkSession, d: str) -> DataFrame:
    return filing.slug_table(filing.folder_tree(archive(spark, d)).select("path"))


@query()
def attachment_names_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Numbers per message; a message's few names are one small array, so nothing leaves its row."""
    named = F.udf(filing.number_filenames, "array<string>", useArrow=True)
    rows = table(spark, d, "attachments").groupBy("read_ord").agg(F.sort_array(F.collect_list(F.struct("attachment_id", X.text("filename").alias("f")))).alias("_f"))
    return rows.select("read_ord", F.posexplode(named(F.transform("_f", lambda x: x["f"]))).alias("place", "filename"))


MAGIC = {"gzip": "1F8B0800", "bzip2": "425A6839", "xz": "FD377A585A0000", "zip": "504B0304", "pst": "2142444E", "plain": "46726F6D20"}


@query("SELECT event_id, " + case("CAST(event_id % 6 AS VARCHAR)", {str(i): k for i, k in enumerate(MAGIC)}, "''") + " AS kind FROM events")
def magic_sniff(spark: SparkSession, d: str) -> DataFrame:
    head = X.mapping((F.col("event_id") % 6).cast("string"), {str(i): h for i, h in enumerate(MAGIC.values())})
    return table(spark, d, "events").select("event_id", X.magic_kind(F.unhex(head)).alias("kind"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS parsed FROM events")
def parse_rfc_date(spark: SparkSession, d: str) -> DataFrame:
    from postquarry.operators.instants import as_timestamp, resolve_instants

    written = F.concat(F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("read_ord"), F.lit(None).cast("int").alias("source_id"), written.alias("date_raw"))
    done = resolve_instants(rows, table(spark, d, "sources"))
    return done.select(F.col("read_ord").alias("event_id"), as_timestamp(F.col("instant_us")).alias("parsed"))


# ---- HTML and bodies

ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def crude_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace(coalesce({x},''), '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for a, b in ENTITIES:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\f\\x0b]+', ' ', 'g'), ' ')"


@query(f"SELECT read_ord, {crude_sql('body_html')} AS crude FROM messages WHERE body_html IS NOT NULL")
def crude_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("body_html is not null").select("read_ord", X.crude_text(F.col("body_html")).alias("crude"))


PREFIXES = ["https://", "javascript:", "mailto:", "data:", "/", "cid:", ""]


@query("SELECT doc_id, p, CASE WHEN p || coalesce(source,'') = '' OR p IN ('javascript:', 'data:') THEN NULL ELSE p || coalesce(source,'') END AS url FROM documents, (SELECT unnest([" + ", ".join(map(lit, PREFIXES)) + "]) AS p)")
def safe_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("p", F.explode(F.array(*[F.lit(p) for p in PREFIXES])))
    return rows.select("doc_id", "p", X.safe_url(F.concat("p", X.text("source"))).alias("url"))


@query("""WITH l AS (SELECT read_ord, unnest(string_split(replace(replace(body_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM messages WHERE body_text IS NOT NULL)
SELECT read_ord, CAST(least(5, length(replace(regexp_extract(line, '^((?: ?>)*)', 1), ' ', ''))) AS INTEGER) AS depth, count(*) AS n FROM l GROUP BY ALL""")
def quote_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("body_text is not null").select("read_ord", F.explode(F.split(F.regexp_replace("body_text", r"\r\n?", "\n"), "\n")).alias("line"))
    return rows.groupBy("read_ord", X.quote_depth(F.col("line")).alias("depth")).agg(F.count("*").alias("n"))


@query(r"""SELECT read_ord, md5(regexp_replace(body_text, '(?i)\b([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})', '<a href="mailto:\1">\1</a>', 'g')) AS digest FROM messages WHERE body_text IS NOT NULL""")
def linkify_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("body_text is not null").select("read_ord", F.md5(X.linkify_addresses(F.col("body_text")).cast("binary")).alias("digest"))


@query()
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("body_html is not null").select("read_ord", strip_tags_column()("body_html").alias("text"))


@query()
def sanitize_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("body_html is not null").select("read_ord", sanitize_column()("body_html").alias("s")).select("read_ord", "s.*")


@query()
def text_to_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where("body_text is not null").select("read_ord", text_html_column()("body_text").alias("html"))


def _mailto(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = one_each(spark, d)
        none = F.array().cast("array<string>")
        return rows.select("uid", mailto(kind, F.col("subject"), F.lit(""), F.col("from_addr"), F.col("body_text"), F.col("mid"), to=none, cc=none).alias("url"))

    run.__name__ = f"mailto_{kind}"
    return run


for _kind in ("reply", "forward", "replyall"):
    query()(_mailto(_kind))


# ---- mailboxes

def written_message(sender: Column, subject: Column, body: Column) -> Column:
    """RFC 822 bytes of a text message: the subject in encoded words, the body in base64; null sender and subject have no header."""
    # eleven characters are 44 bytes at most, so a word stays within 75 characters and no character is cut
    words = F.transform(F.regexp_extract_all(subject, F.lit("(?s).{1,11}"), F.lit(0)), lambda x: F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(x, "utf-8")), F.lit("?=")))
    head = F.concat(X.text(F.concat(F.lit("From: <"), sender, F.lit(">\n"))), X.text(F.concat(F.lit("Subject: "), F.array_join(words, "\n "), F.lit("\n"))))
    lines = F.regexp_replace(F.base64(F.encode(X.text(body), "utf-8")), r"(.{76})(?!\r?\n)", "$1\n")
    return F.encode(F.concat(head, F.lit("MIME-Version: 1.0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), lines), "utf-8")


STRIPPED = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x},''), '^{STRIPPED}', ''), '{STRIPPED}$', '')"


@query(f"SELECT read_ord, md5({strip_sql("regexp_replace(subject, '[\r\n\t]+', ' ', 'g')")}) AS subject_digest, lower(coalesce(from_addr,'')) AS sender, md5({strip_sql('body_text')}) AS body_digest FROM messages")
def mime_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every message is written as RFC 822 bytes and parsed again: subject, sender and body. Parsing puts subjects on one line."""
    from postquarry.sources.columns import parse_mime

    raw = written_message(F.col("from_addr"), F.col("subject"), F.col("body_text"))
    parsed = table(spark, d, "messages").select("read_ord", parse_mime(raw).alias("m"))
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return parsed.select("read_ord", digest("m.subject").alias("subject_digest"), F.lower("m.sender_addr").alias("sender"), digest("m.body_text").alias("body_digest"))


BOX = 64  # reading orders a packed mailbox covers
MBOX = f"""SELECT source_id, read_ord // {BOX} AS box, row_number() OVER (PARTITION BY source_id, read_ord // {BOX} ORDER BY read_ord) AS n, read_ord AS id,
md5(regexp_replace(regexp_replace(regexp_replace(coalesce(body_text,''), '\r\n?', chr(10), 'g'), '(^|\n)From ', '\1>From ', 'g'), '\n+$', '')) AS digest FROM messages"""


def packed_mailboxes(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, box, mailbox): the messages of a source whose reading orders lie together as one mailbox; lines that could divide are quoted."""
    body = F.regexp_replace(F.regexp_replace(X.text("body_text"), r"\r\n?", "\n"), r"(?m)^From ", ">From ")
    head = F.concat(F.lit("From x@y.example Mon Jan  1 00:00:00 2001\nX-Id: "), F.col("read_ord").cast("string"), F.lit("\n\n"))
    rows = table(spark, d, "messages").select("source_id", F.floor(F.col("read_ord") / BOX).alias("box"), "read_ord", F.concat(head, body, F.lit("\n\n")).alias("_m"))
    packed = rows.groupBy("source_id", "box").agg(F.sort_array(F.collect_list(F.struct("read_ord", "_m"))).alias("_l"))
    return packed.select("source_id", "box", F.array_join(F.transform("_l", lambda x: x["_m"]), "").alias("mailbox"))


def _unpacked(raw: Column) -> list[Column]:
    body = F.regexp_replace(F.regexp_replace(raw, r"^X-Id: [0-9]+\n\n", ""), r"\n+$", "")
    return [F.regexp_extract(raw, r"^X-Id: ([0-9]+)", 1).cast("bigint").alias("id"), F.md5(body.cast("binary")).alias("digest")]


@query(MBOX)
def mbox_split_sql(spark: SparkSession, d: str) -> DataFrame:
    """Mailboxes of many messages, split at their dividing lines by an expression alone."""
    pieces = F.split("mailbox", r"(?:^|(?<=\n\n))From [^\n]*\n")
    rows = packed_mailboxes(spark, d).select("source_id", "box", F.posexplode(pieces).alias("n", "raw")).where("n > 0")
    return rows.select("source_id", "box", F.col("n").cast("bigint").alias("n"), *_unpacked(F.col("raw")))


@query(MBOX)
def mbox_split_udtf(spark: SparkSession, d: str) -> DataFrame:
    """The same mailboxes through the splitter of the mailbox reader."""
    from postquarry.sources.columns import split_mailbox

    rows = packed_mailboxes(spark, d).select("source_id", "box", F.posexplode(split_mailbox(F.encode("mailbox", "utf-8"))).alias("n", "raw"))
    return rows.select("source_id", "box", (F.col("n") + 1).cast("bigint").alias("n"), *_unpacked(F.decode("raw", "utf-8")))
