"""SQL names of the functions: after register(spark) they can be used in spark.sql."""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postquarry.functions import html as H
from postquarry.sources.mailbox import split_mbox
from postquarry.sources.mime import addresses, from_bytes, parse_date


def fold_text(x: str | None) -> str | None:
    """Full compatibility decomposition without accents, in lower case; text.fold is its quicker form for common letters."""
    return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()


def token_list(x: str | None) -> list[str]:
    import re

    out = []
    for m in re.finditer(r"[a-z0-9][a-z0-9'._+\-]*", fold_text(x) or ""):
        t = m[0].strip("'._+-")
        if 2 <= len(t) <= 60:
            out.append(t)
            if re.search(r"[._+\-]", t):
                out += [p for p in re.findall("[a-z0-9]+", t) if 2 <= len(p) <= 40 and p != t]
    return out


def parse_dates(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        dates = [parse_date(x) if x else None for x in batch]
        yield pd.DataFrame({
            "date_ts": pd.to_datetime([d for d in dates], utc=True), "date_local": pd.to_datetime([d.replace(tzinfo=None) if d else None for d in dates]),
            "date_offset_s": pd.array([int(d.utcoffset().total_seconds()) if d else None for d in dates], dtype="Int32"),
        })


class MboxMessages:
    def eval(self, content: bytes):
        for n, raw in enumerate(split_mbox(io.BytesIO(bytes(content or b"")))):
            yield n, raw


class MimeMessage:
    def eval(self, content: bytes):
        r = from_bytes(bytes(content or b""))
        if r is not None:
            sender = r.get("sender") or {}
            yield r.get("message_id"), r.get("subject"), sender.get("name"), sender.get("addr"), r.get("body_text"), r.get("body_html"), len(r.get("attachments") or ()), r.get("error")


def register(spark: SparkSession) -> None:
    spark.udf.register("mail_fold", H.column(fold_text, "string"))
    spark.udf.register("mail_tokenize", H.column(token_list, "array<string>"))
    spark.udf.register("mail_strip_tags", H.strip_tags_column())
    spark.udf.register("mail_sanitize", H.sanitize_column())
    spark.udf.register("mail_parse_addresses", H.column(lambda x: [(a["name"], a["addr"]) for a in addresses([x])] if x else [], "array<struct<name:string,addr:string>>"))
    spark.udf.register("mail_parse_date", F.pandas_udf(parse_dates, "date_ts timestamp, date_local timestamp_ntz, date_offset_s int"))
    spark.udtf.register("mbox_messages", F.udtf(MboxMessages, returnType="pos int, raw binary"))
    kind = "message_id string, subject string, sender_name string, sender_addr string, body_text string, body_html string, attachments int, error string"
    spark.udtf.register("mime_message", F.udtf(MimeMessage, returnType=kind))
