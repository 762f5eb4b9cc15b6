"""Mixtures of sources with target weights, sized in tokens of a public tokenizer.

Each source is a stream of its documents in hashed order, repeated as often as needed and allowed, and cut into blocks of equal
size. Pfair scheduling gives block k of a source that has n of a mixture's N blocks the window from floor(k * N / n) to ceil((k + 1) * N / n),
in whole numbers; taking the earliest deadline among released blocks keeps every source less than one block from its share at every
moment, however long the mixture is. One task per mixture runs through its slots and streams them out, so none is held in the driver; blocks
grow with the total where a mixture would have more than MOST_SLOTS of them.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postquarry.tables import cut_lineage

MOST_TARGETS = 100_000
MOST_SLOTS = 1 << 24
STRIPE_BITS = 10


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file, read once in each Python worker and kept for its later tasks."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str):
    """Column function: number of tokens of a text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return count


def quotas(targets: list[dict], have: dict[str, int], total: int, default_repeats: int = 1) -> list[dict]:
    """Tokens each source gives to one mixture.

    Shares are taken relative to their sum; missing, negative and zero shares count as none, and of repeated targets the
    first by name order counts. A source gives at most max_repeats (default_repeats if null) times its tokens; what it can't
    give goes to the others by their weights, as far as they can.
    """
    first: dict[str, dict] = {}
    for t in sorted(targets, key=lambda t: (t["source"] or "", -(t["target_share"] or 0))):
        if t["source"] is not None and (t["target_share"] or 0) > 0:
            first.setdefault(t["source"], t)
    weights = {s: float(t["target_share"]) for s, t in first.items()}
    room = {s: have.get(s, 0) * max(0, default_repeats if t["max_repeats"] is None else t["max_repeats"]) for s, t in first.items()}
    given = dict.fromkeys(weights, 0)
    open_, left = {s for s in weights if room[s] > 0}, total
    while open_ and left > 0:
        part = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / part >= room[s]}
        if not full:
            for s in open_:
                given[s] = int(left * weights[s] / part)
            break
        for s in full:
            given[s] = room[s]
            left -= room[s]
        open_ -= full
    whole = sum(weights.values())
    return [{"source": s, "wanted": weights[s] / whole, "quota": given[s]} for s in sorted(weights)]


def pfair(blocks: dict[str, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, source, block) of every block: earliest deadline among the released, the heavier source first on ties."""
    total = sum(blocks.values())
    names = sorted(s for s, n in blocks.items() if n > 0)
    waiting = [(0, i, 0) for i in range(len(names))]
    count = [blocks[s] for s in names]
    released: list[tuple[int, int, int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(k + 1) * total // count[i]), -count[i], i, k))
        _, _, i, k = heapq.heappop(released)
        yield t, names[i], k
        if k + 1 < count[i]:
            heapq.heappush(waiting, (max(t + 1, (k + 1) * total // count[i]), i, k + 1))


SLOTS = "mix_name string, source string, _k bigint, slot bigint"


def schedule(plan: DataFrame, size: int = 50_000) -> DataFrame:
    """(mix_name, source, _k, slot) for plan (mix_name, source, _blocks): each mixture by one task, its slots streamed out in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"mix_name": [], "source": [], "_blocks": []}), *batches])
        for name, own in rows.groupby("mix_name", sort=True):
            slots = pfair({s: int(n) for s, n in zip(own["source"], own["_blocks"])})
            while part := list(itertools.islice(slots, size)):
                t, s, k = zip(*part)
                yield pd.DataFrame({"mix_name": name, "source": s, "_k": k, "slot": t})

    return plan.select("mix_name", "source", "_blocks").repartition("mix_name").mapInPandas(run, SLOTS)


def offsets(sized: DataFrame) -> DataFrame:
    """sized with _from: tokens of the source before the document in hashed order. Sources are cut into stripes of the order, so a
    large one is summed by many tasks."""
    rows = sized.withColumn("_h", F.xxhash64("doc_id")).withColumn("_stripe", F.shiftrightunsigned("_h", 64 - STRIPE_BITS).cast("int"))
    sums = rows.groupBy("source", "_stripe").agg(F.sum("tokens").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_stripe", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_stripe").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return rows.join(sums, ["source", "_stripe"]).withColumn("_from", F.col("_ahead") + F.col("_in")).drop("_h", "_stripe", "_in", "_ahead")


def mixture(
    documents: DataFrame, targets: DataFrame, vocabulary: str, total_tokens: int | None = None, block: int = 4096, default_repeats: int = 1, most_slots: int = MOST_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). drawn has mix_name, slot, source, place, doc_id, epoch, tokens, in the order slot, source, place; shares has mix_name,
    source, wanted, quota, tokens, uses, reached.

    vocabulary is the file of a public tokenizer. total_tokens is the size of each mixture, by default half of the tokens of its sources. A
    document begins in the block its first token falls into. block is the size of blocks in tokens, more where a mixture would have more than
    most_slots of them. Documents without text or source are never drawn.
    """
    spark = documents.sparkSession
    sized = documents.where("source is not null").select("doc_id", "source", token_counter(vocabulary)("text").alias("tokens"))
    sized = cut_lineage(sized.where("tokens > 0"))
    rows = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = spark.createDataFrame([(s,) for s in sorted({r["source"] for r in rows if r["source"]})], "source string")
    have = {r[0]: r[1] for r in sized.join(wanted, "source", "left_semi").groupBy("source").agg(F.sum("tokens")).collect()}
    plan = []
    for name in sorted({r["mix_name"] for r in rows if r["mix_name"] is not None}):
        own = [r for r in rows if r["mix_name"] == name]
        total = total_tokens or sum(have.get(s, 0) for s in {r["source"] for r in own}) // 2
        step = max(block, -(-total // most_slots))
        plan += [(name, q["source"], q["wanted"], q["quota"], have.get(q["source"], 0), step, -(-q["quota"] // step)) for q in quotas(own, have, total, default_repeats)]
    plan_df = spark.createDataFrame(plan, "mix_name string, source string, wanted double, quota bigint, _size bigint, _block bigint, _blocks bigint")
    slots = schedule(plan_df.where("_blocks > 0"))
    placed = offsets(sized).join(plan_df.where("quota > 0"), "source").where("_from < quota")
    last = F.floor((F.col("quota") - 1 - F.col("_from")) / F.col("_size")).cast("int")
    drawn = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    place = F.col("epoch").cast("bigint") * F.col("_size") + F.col("_from")
    drawn = drawn.withColumns({"place": place, "_k": F.floor(place / F.col("_block"))}).join(slots, ["mix_name", "source", "_k"])
    drawn = drawn.select("mix_name", "slot", "source", "place", "doc_id", "epoch", "tokens")
    reached = drawn.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), (F.max("epoch") + 1).alias("uses"))
    shares = plan_df.join(reached, ["mix_name", "source"], "left").select("mix_name", "source", "wanted", "quota", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"))
    whole = Window.partitionBy("mix_name")
    shares = shares.withColumn("reached", F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)))
    return drawn, shares


def mixture_texts(documents: DataFrame, targets: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The drawn rows with their texts."""
    drawn, _ = mixture(documents, targets, vocabulary, **options)
    return drawn.join(documents.select("doc_id", "text"), "doc_id")
