"""Parsing of message bytes that are already in a column, in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from postquarry.sources.mailbox import split_mbox
from postquarry.sources.mime import from_bytes


@F.pandas_udf("message_id string, subject string, sender_name string, sender_addr string, date_ts timestamp, body_text string, body_html string, attachments int, error string")
def parse_mime(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["message_id", "subject", "sender_name", "sender_addr", "date_ts", "body_text", "body_html", "attachments", "error"]
    for batch in batches:
        rows = []
        for raw in batch:
            r = (from_bytes(bytes(raw)) if raw is not None else None) or {}
            sender = r.get("sender") or {}
            rows.append((r.get("message_id"), r.get("subject"), sender.get("name"), sender.get("addr"), r.get("date_ts"), r.get("body_text"), r.get("body_html"), len(r.get("attachments") or ()), r.get("error")))
        out = pd.DataFrame(rows, columns=names)
        out["date_ts"] = pd.to_datetime(out["date_ts"], utc=True)
        yield out


@F.pandas_udf("array<binary>")
def split_mailbox(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Raw messages of a mailbox in order; null has none."""
    for batch in batches:
        yield pd.Series([list(split_mbox(io.BytesIO(bytes(raw)))) if raw is not None else [] for raw in batch], dtype=object)
