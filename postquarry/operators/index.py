"""Inverted index: postings with field masks, shards, and ranked search.

Postings are (gid, token, mask). A search turns its terms into a filter on the shard, which prunes partitions of a written index, and
one on the token, which prunes row groups; hits of all terms meet in one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions.text import query_terms, shard_length, shard_of, text, tokenize


def postings(docs: DataFrame, key: str, fields: dict[int, Column], caps: dict[int, int] | None = None) -> DataFrame:
    """(key, token, mask): one row per document and token, masks of its fields joined; a cap counts a field's tokens before stopwords
    are dropped. Documents without tokens have no rows."""
    caps = caps or {}
    arrays = []
    for bit, c in fields.items():
        tokens = tokenize(c)
        tokens = F.slice(tokens, 1, caps[bit]) if bit in caps else tokens
        arrays.append((bit, F.array_distinct(tokens)))
    named = docs.select(key, *[a.alias(f"_f{bit}") for bit, a in arrays])
    parts = [named.select(key, F.explode(f"_f{bit}").alias("token"), F.lit(bit).alias("mask")) for bit, _ in arrays]
    if len(parts) == 1:
        merged = parts[0]
    else:
        # a second parameter of the function would be the place in the array
        masked = lambda bit: F.transform(f"_f{bit}", lambda t: F.struct(t.alias("token"), F.lit(bit).alias("mask")))
        every = F.explode(F.concat(*[masked(bit) for bit, _ in arrays]))
        rows = named.select(key, every.alias("_t")).select(key, "_t.*")
        merged = rows.groupBy(key, "token").agg(F.bit_or("mask").alias("mask"))
    return merged.where(~F.col("token").isin(S.STOPWORDS)).select(key, "token", "mask")


SPAN = 4096  # documents a block of a posting list covers, so that the list of a word most documents have is many blocks


def deltas(rows: DataFrame, key: str = "gid") -> DataFrame:
    """postings with delta: distance of a document from the one before in its token's list. Blocks hand over their last document."""
    rows = rows.withColumn("_block", F.floor(F.col(key) / SPAN))
    by_block = Window.partitionBy("token").orderBy("_block")
    ends = rows.groupBy("token", "_block").agg(F.max(key).alias("_last")).select("token", "_block", F.lag("_last").over(by_block).alias("_ahead"))
    before = F.lag(key).over(Window.partitionBy("token", "_block").orderBy(key))
    joined = rows.withColumn("_before", before).join(ends, ["token", "_block"])
    return joined.withColumn("delta", F.col(key) - F.coalesce("_before", "_ahead", F.lit(0))).drop("_block", "_before", "_ahead")


def undo_deltas(rows: DataFrame) -> DataFrame:
    """(token, pos, delta, mask) back to gid: sums within blocks of places, and the sums of the blocks before."""
    rows = rows.withColumn("_block", F.floor(F.col("pos") / SPAN))
    earlier = Window.partitionBy("token").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("token", "_block").agg(F.sum("delta").alias("_sum")).select("token", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"))
    inside = F.sum("delta").over(Window.partitionBy("token", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(sums, ["token", "_block"]).withColumn("gid", F.col("_ahead") + F.col("_in")).drop("_block", "_in", "_ahead")


def posting_blocks(rows: DataFrame, key: str = "gid") -> DataFrame:
    """(token, block, entries): the list of a token as text, document:mask by document, a row for every SPAN of documents that has any."""
    lists = rows.groupBy("token", F.floor(F.col(key) / SPAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct(key, "mask"))).alias("_l"))
    return lists.select("token", "block", F.array_join(F.transform("_l", lambda p: F.concat_ws(":", p[key].cast("string"), p["mask"].cast("string"))), " ").alias("entries"))


def index_meta(rows: DataFrame, key: str = "gid") -> DataFrame:
    facts = rows.agg(F.count_distinct("token").alias("tokens"), F.count("*").alias("entries"), F.count_distinct(key).alias("docs"))
    return facts.withColumn("shard_len", shard_length(F.col("tokens")))


def shards(rows: DataFrame) -> DataFrame:
    """(shard, tokens, entries) with the shard length that the vocabulary's size asks for."""
    tokens = rows.groupBy("token").agg(F.count("*").alias("n"))
    length = tokens.agg(shard_length(F.count("*"))).first()[0]
    return tokens.groupBy(shard_of(F.col("token"), length).alias("shard")).agg(F.count("*").alias("tokens"), F.sum("n").alias("entries"))


def write_index(rows: DataFrame, path: str, length: int = 2) -> None:
    sharded = rows.withColumn("shard", shard_of(F.col("token"), length))
    sharded.repartitionByRange("shard", "token").sortWithinPartitions("shard", "token").write.mode("overwrite").partitionBy("shard").parquet(path)


def matches(rows: DataFrame, query: str, key: str = "gid", prefix: str = "all", shard_len: int = 1, drop_stopwords: bool = False, exact: bool = False) -> DataFrame:
    """(key, mask) of documents that hold every term. A term of at least shard_len characters also matches as the start of a token
    (prefix="last": only the last term does). Stopwords are in no list, so they match only longer tokens, unless dropped."""
    terms = [t for t in query_terms(query) if not (drop_stopwords and t in S.STOPWORDS)]
    if not terms:
        return rows.select(key, "mask").where(F.lit(False))
    open_ = [not exact and len(t) >= shard_len and (prefix == "all" or i == len(terms) - 1) for i, t in enumerate(terms)]
    hit = [(F.col("token").startswith(t) if o else F.col("token") == t) for t, o in zip(terms, open_)]
    found = rows.where(reduce(lambda a, b: a | b, hit))
    if "shard" in rows.columns:
        found = found.where(F.col("shard").isin(sorted({(t + "_" * 9)[:shard_len] for t in terms})))
    which = F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)]))
    found = found.select(key, "mask", F.explode(which).alias("_term"))
    full = found.groupBy(key).agg(F.bit_or("mask").alias("mask"), F.count_distinct("_term").alias("_n"))
    return full.where(F.col("_n") == len(terms)).drop("_n")


def score(mask: Column, epoch: Column) -> Column:
    weights = ((S.FIELD_SUBJECT, 60), (S.FIELD_SENDER, 40), (S.FIELD_RECIPIENT, 15), (S.FIELD_ATTACHMENT, 12), (S.FIELD_BODY, 6))
    base = reduce(lambda a, b: a + b, [F.when(mask.bitwiseAND(bit) != 0, w).otherwise(0) for bit, w in weights])
    return base + F.least(F.lit(20.0), F.coalesce(epoch, F.lit(0)) / 86400 / 3650)


def search(rows: DataFrame, docs: DataFrame, query: str, key: str = "gid", epoch: str = "epoch", scope: Column | None = None, top: int = S.RESULTS, **options) -> DataFrame:
    """The best documents by fields and date. docs has key, epoch and what the scope asks for."""
    held = docs.where(scope) if scope is not None else docs
    hits = matches(rows, query, key, **options).join(held, key)
    ranked = hits.withColumn("score", score(F.col("mask"), F.col(epoch)))
    return ranked.orderBy(F.desc("score"), F.desc(F.coalesce(epoch, F.lit(0))), F.asc(key)).limit(top)
