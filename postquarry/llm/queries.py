"""Queries of the text problems over the archive's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from postquarry.llm.contamination import leaks
from postquarry.llm.conversations import conversation_texts, conversations
from postquarry.llm.encoding import restore_fields
from postquarry.llm.mixing import mixture, mixture_texts
from postquarry.llm.personal import left_after_masking, masked, personal_data
from postquarry.llm.quoting import cut_bodies, passages
from postquarry.llm.truncation import truncated, truncation_rates
from postquarry.tables import table


VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# No key is written here. Without one in the environment each run of the driver has its own, so its replacements can be compared with no other's.
KEY = os.environ.get("MASKING_KEY") or secrets.token_hex(16)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "messages"), table(spark, d, "sources")).select("root_id", "message_id", "turn_no")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversation_texts(table(spark, d, "messages"), table(spark, d, "sources"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_restored(spark, d).select("rec_key", "field_name")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_fields(table(spark, d, "messages"), table(spark, d, "addresses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(table(spark, d, "messages"), table(spark, d, "addresses"), key=KEY)


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return masked(table(spark, d, "messages"), table(spark, d, "addresses"), key=KEY)


def p3_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return masked(table(spark, d, "messages"), table(spark, d, "addresses"), key=KEY, surrogates=True)


def p3_left(spark: SparkSession, d: str) -> DataFrame:
    """What masking leaves behind; must be empty."""
    return left_after_masking(table(spark, d, "messages"), table(spark, d, "addresses"), key=KEY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return passages(table(spark, d, "messages"))


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    return cut_bodies(table(spark, d, "messages")).select("read_ord", "new_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_drawn(spark: SparkSession, d: str) -> DataFrame:
    return mixture_texts(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored, "p2_found": p2_found, "p2_turns": p2_turns,
    "p3_found": p3_found, "p3_masked": p3_masked, "p3_surrogates": p3_surrogates, "p3_left": p3_left, "p4_found": p4_found, "p4_new_text": p4_new_text, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_drawn": p8_drawn, "p8_shares": p8_shares, "p9_found": p9_found, "p9_rates": p9_rates,
}
SQL: dict[str, str] = {}
