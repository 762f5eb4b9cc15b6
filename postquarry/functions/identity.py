"""Hashes that identify a message and its published form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions.text import normalize_subject, text

NUL = "\x00"


def _sha(parts: list[Column], length: int) -> Column:
    return F.substring(F.sha1(F.encode(F.concat(*parts), "utf-8")), 1, length)


def uid(message_id: Column, date: Column, date_raw: Column, sender_addr: Column, subject: Column, to_addrs: Column, body: Column) -> Column:
    """Hash of the identifier, or of the fields a mail system can't rewrite. date is ISO text with offset, null if unknown."""
    pieces = [
        F.coalesce(F.nullif(date, F.lit("")), text(date_raw)), F.lower(text(sender_addr)), F.lower(normalize_subject(subject)),
        F.array_join(F.array_sort(F.transform(F.coalesce(to_addrs, F.array().cast("array<string>")), lambda x: F.lower(x))), ","),
        F.substring(text(body), 1, S.UID_BODY_CHARS),
    ]
    made = _sha([F.lit("syn" + NUL), *[x for p in pieces for x in (p, F.lit(NUL))]], 20)
    return F.when(text(message_id) != "", _sha([F.lit("mid" + NUL), text(message_id)], 20)).otherwise(made)


def content_hash(*pieces: Column, attachments: Column | None = None) -> Column:
    """Hash of what is published of a message; attachments is an array of filename:size:type."""
    parts = [x for p in pieces for x in (text(p), F.lit(NUL))]
    if attachments is not None:
        ended = F.transform(F.coalesce(attachments, F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(NUL)))
        parts.append(F.array_join(ended, ""))
    return _sha(parts, 16)
