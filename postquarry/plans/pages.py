"""Message pages: rendered body, header and attachment blocks, and the embedded record the manifest can be recovered from."""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions import html as H
from postquarry.functions import text as X
from postquarry.operators.filing import number_filenames
from postquarry.operators.manifest import page_html

PAGE = "uid string, article string, blocked int, plain boolean, files array<struct<filename:string,href:string,size:bigint,content_type:string>>"


def size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.0f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def address_link(name: str | None, addr: str | None) -> str:
    shown = html.escape(name or addr or "(unknown)")
    return f'<a href="mailto:{html.escape(addr)}">{shown}</a>' if addr else shown


def address_list(people: list) -> str:
    return ", ".join(address_link(p["name"], p["addr"]) for p in people) or "(undisclosed recipients)"


def file_places(uid: str, given: list) -> list[tuple[str, str]]:
    """(name, path) of a message's files: names are made different, and every message has a directory of its own."""
    return [(n, f"attachments/{uid[:2]}/{uid}/{quote(n)}") for n in number_filenames([a["filename"] or "attachment" for a in given])]


def files(messages: DataFrame) -> DataFrame:
    """(uid, path, filename, content_type, size, payload): the attachments of messages under the paths their pages link to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, given in zip(batch["uid"], batch["names"]):
                rows += [(uid, k, path, name) for k, (name, path) in enumerate(file_places(uid, [{"filename": x} for x in given]))]
            yield pd.DataFrame(rows, columns=["uid", "_k", "path", "filename"])

    some = messages.where(F.size("attachments") > 0)
    named = some.select("uid", F.transform("attachments", lambda a: F.coalesce(a["filename"], F.lit(""))).alias("names")).mapInPandas(run, "uid string, _k int, path string, filename string")
    payloads = some.select("uid", F.posexplode("attachments").alias("_k", "a")).select("uid", "_k", F.col("a.content_type").alias("content_type"), F.col("a.size").alias("size"), F.col("a.payload").alias("payload"))
    return named.join(payloads, ["uid", "_k"]).drop("_k")


def render(row: dict, block_remote: bool = True) -> tuple:
    """(uid, article, images held back, plain text?, files) of a message. Links to its files by cid are resolved."""
    given = list(row["attachments"] if row["attachments"] is not None else [])
    files = [(n, path, int(a["size"] or 0), a["content_type"] or "") for (n, path), a in zip(file_places(row["uid"], given), given)]
    cids = {a["content_id"]: f[1] for a, f in zip(given, files) if a["content_id"]}
    if row["body_html"] and row["body_html"].strip():
        body, blocked = H.sanitize(row["body_html"], block_remote, cids)
        plain = False
    else:
        body, blocked, plain = H.body_html(None, row["body_text"])
    sender = row["sender"] or {"name": "", "addr": ""}
    lines = [("Subject", html.escape(row["subject"] or "")), ("From", address_link(sender["name"], sender["addr"])), ("Date", html.escape(row["date_raw"] or "")), ("To", address_list(list(row["to"] if row["to"] is not None else [])))]
    if row["cc"] is not None and len(row["cc"]):
        lines.append(("Cc", address_list(list(row["cc"]))))
    head = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in lines)
    listed = "".join(f'<li><a href="{html.escape(f[1])}">{html.escape(f[0])}</a> {size_text(f[2])}</li>' for f in files)
    article = f'<article><table class="headers">{head}</table><div class="body">{body}</div>{f"<ul>{listed}</ul>" if files else ""}</article>'
    return row["uid"], article, blocked, plain, files


def pages(messages: DataFrame, block_remote: bool = True) -> DataFrame:
    """(uid, page, html, blocked, plain, files) for messages of the archive's schema with uid, path, hash, nav and epoch."""
    light = F.transform("attachments", lambda a: F.struct(a["filename"].alias("filename"), a["size"].alias("size"), a["content_type"].alias("content_type"), a["content_id"].alias("content_id")))
    needed = messages.select("uid", "subject", "sender", "date_raw", "to", "cc", "body_text", "body_html", light.alias("attachments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([render(r, block_remote) for r in batch.to_dict("records")], columns=["uid", "article", "blocked", "plain", "files"])

    quoted = F.substring(F.coalesce(F.nullif("body_text", F.lit("")), X.crude_text(F.col("body_html"))), 1, S.QUOTE_CHARS)
    meta = F.to_json(F.struct(
        "uid", F.col("path").alias("folder"), "hash", "subject", "nav", F.col("epoch").alias("date"), F.struct(F.col("sender.name").alias("n"), F.col("sender.addr").alias("a")).alias("from"),
        F.transform("to", lambda a: F.struct(a["name"].alias("n"), a["addr"].alias("a"))).alias("to"), F.transform("cc", lambda a: F.struct(a["name"].alias("n"), a["addr"].alias("a"))).alias("cc"),
        "date_raw", "organization", "newsgroups", "message_id", "in_reply_to", "references", "priority", "unread", "flagged", "size", quoted.alias("quote"),
    ))
    made = needed.mapInPandas(run, PAGE)
    records = messages.select("uid", X.page_path(F.col("uid")).alias("page"), meta.alias("_meta"))
    return made.join(records, "uid").select("uid", "page", page_html(F.col("_meta"), F.col("article")).alias("html"), "blocked", "plain", "files")
