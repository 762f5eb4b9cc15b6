"""Outlook stores: MAPI items to records. Reading a file needs the optional pypff package or the readpst program."""

from __future__ import annotations

import datetime as dt
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

from postquarry.sources.mime import decode_bytes, from_bytes, safe_filename

FILENAME_TAGS, CONTENT_ID_TAG = (0x3707, 0x3704), 0x3712
ROOTS = {"top of personal folders", "top of outlook data file", "root - mailbox", "ipm_subtree", "root"}


def prop(item: object, name: str, default=None):
    """An item's property; the default where it is missing or can't be read."""
    try:
        value = getattr(item, name)
        return default if value is None else value
    except Exception:  # noqa: BLE001 - stores often have unreadable properties
        return default


def clean_address(value: str | None) -> str:
    """An SMTP address; directory names of the server are none."""
    value = (value or "").strip()
    return "" if value.upper().startswith(("EX:", "/O=")) or "@" not in value else value


def decode_body(raw: bytes | str | None) -> str:
    return (raw if isinstance(raw, str) else decode_bytes(raw or b"", "utf-8")).replace("\x00", "")


def rtf_text(raw: bytes | str | None) -> str:
    source = decode_body(raw)
    source = re.sub(r"\{\\\*[^{}]*\}|\{\\(?:fonttbl|colortbl|stylesheet)(?:[^{}]|\{[^{}]*\})*\}", "", source)
    source = re.sub(r"\\(?:par|line)\b ?", "\n", source)
    source = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), source)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?", "", source)).strip()


def attachments(item: object) -> list[dict]:
    out = []
    for a in prop(item, "attachments", []) or []:
        name, cid = prop(a, "name", ""), ""
        for record_set in prop(a, "record_sets", []) or []:
            for entry in prop(record_set, "entries", []) or []:
                tag = prop(entry, "entry_type", 0)
                value = prop(entry, "data_as_string", "")
                if tag in FILENAME_TAGS and value and not name:
                    name = value
                elif tag == CONTENT_ID_TAG:
                    cid = value
        data = prop(a, "data", None)
        if data is None and hasattr(a, "read_buffer"):
            data = a.read_buffer(prop(a, "size", 0))
        out.append({"filename": safe_filename(name or "") or "attachment.bin", "content_type": "application/octet-stream", "size": len(data or b""), "payload": data or b"", "content_id": cid})
    return out


def convert(item: object, folder: str, source: str, pos: int) -> dict | None:
    """The record of an item: its transport headers, and MAPI properties where they lack something; none for an empty item."""
    headers = prop(item, "transport_headers", "")
    record = from_bytes(headers.encode("utf-8", "replace") + b"\n\n", folder, source, pos) if headers else None
    record = record or from_bytes(b"X-Source: pst\n\n", folder, source, pos)
    sender = record["sender"]
    name, addr = prop(item, "sender_name", ""), clean_address(prop(item, "sender_email_address", ""))
    record["subject"] = record["subject"] or prop(item, "subject", "") or prop(item, "conversation_topic", "")
    record["sender"] = {"name": sender["name"] or name, "addr": sender["addr"] or addr}
    if record["date_ts"] is None:
        times = (prop(item, k) for k in ("delivery_time", "client_submit_time", "creation_time", "modification_time"))
        when = next((t for t in times if isinstance(t, dt.datetime)), None)
        if when is not None:
            when = when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)
            record |= {"date_ts": when, "date_local": when.replace(tzinfo=None), "date_offset_s": int(when.utcoffset().total_seconds())}
    record["body_text"] = decode_body(prop(item, "plain_text_body"))
    record["body_html"] = decode_body(prop(item, "html_body"))
    if not record["body_text"] and not record["body_html"]:
        record["body_text"] = rtf_text(prop(item, "rtf_body"))
    record["unread"] = not prop(item, "flags", 1) & 1
    record["priority"] = record["priority"] or {0: "Low", 2: "High"}.get(prop(item, "importance", 1), "")
    record["attachments"] = attachments(item)
    record["has_attachments"] = bool(record["attachments"])
    record["size"] = prop(item, "size", 0) or len(record["body_text"] or record["body_html"])
    empty = not (record["subject"] or record["sender"]["addr"] or record["sender"]["name"] or record["body_text"] or record["body_html"] or record["attachments"])
    return None if empty else record


def walk(folder: object, path: str, source: str) -> Iterator[dict]:
    """Items of a folder and those below, depth first; containers at the root give no name; an unreadable item is a record with error."""
    name = (prop(folder, "name", "") or "").strip()
    here = path if not name or (not path and name.lower() in ROOTS) else f"{path}/{name}".strip("/")
    for pos, item in enumerate(prop(folder, "messages", None) or prop(folder, "sub_messages", []) or []):
        try:
            record = convert(item, here or "Inbox", source, pos)
        except Exception as e:  # noqa: BLE001
            record = {"folder": here, "source": source, "pos": pos, "error": f"{type(e).__name__}: {e}"}
        if record is not None:
            yield record
    for sub in prop(folder, "folders", None) or prop(folder, "sub_folders", []) or []:
        yield from walk(sub, here, source)


def read(path: str) -> Iterator[dict]:
    try:
        import pypff
    except ImportError:
        yield from _read_by_program(path)
        return
    store = pypff.file()
    store.open(path)
    try:
        yield from walk(store.get_root_folder(), "", path)
    finally:
        store.close()


def _read_by_program(path: str) -> Iterator[dict]:
    if shutil.which("readpst") is None:
        raise RuntimeError("reading .pst files needs the pypff package (libpff-python) or the readpst program")
    from pathlib import Path

    from postquarry.sources.mailbox import eml_files, eml_folder, eml_folders, read_eml

    with tempfile.TemporaryDirectory() as folder:
        subprocess.run(["readpst", "-e", "-q", "-o", folder, path], check=True)
        root = Path(folder)
        for p in (p for below, _ in eml_folders(root) for p in eml_files(below)):
            if (record := read_eml(p.read_bytes(), eml_folder(p, root), f"{path}:{p.relative_to(root)}")) is not None:
                yield record
