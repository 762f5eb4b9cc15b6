"""Spark data source "mail": mailboxes, trees and containers read in parallel.

Plain mailboxes are cut into byte ranges (range_bytes) that find their first message themselves, directories of single messages into groups
of files; what is compressed or in a container is read by one task each. spark.read.format("mail") takes a path, several with paths (JSON
list), kind to force a kind, and unquote. A source or message file that fails gives a row with error; all else is read.
"""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from postquarry.schema import MESSAGE
from postquarry.sources import mailbox, pst

GROUP = 500  # message files a partition
RANGE_BYTES = 128 << 20  # bytes of a plain mailbox a partition


@dataclass
class Part(InputPartition):
    path: str
    kind: str
    files: list[str] = field(default_factory=list)  # members of a container, or a directory of message files
    start: int = 0
    end: int | None = None
    value: int = 0


class MailReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.kind, self.unquote = options.get("kind"), options.get("unquote", "false").lower() == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for path in self.paths:
            kind = self.kind or mailbox.detect(path)
            if kind in ("eml", "maildir"):
                out += [Part(path, kind, [folder], a, a + GROUP) for folder, n in mailbox.eml_folders(Path(path)) for a in range(0, n, GROUP)]
            elif kind == "mbox-archive" and zipfile.is_zipfile(path):
                out += [Part(path, kind, [m]) for m in mailbox.members(path)]
            elif kind == "mbox":
                out += [Part(path, kind, [], a, a + self.range_bytes) for a in range(0, max(1, Path(path).stat().st_size), self.range_bytes)]
            elif kind in ("mbox-compressed", "mbox-archive", "eml-file", "pst"):
                out.append(Part(path, kind))
            else:
                raise ValueError(f"unknown kind of source: {kind}")
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        try:
            for record in self.records(partition):
                yield tuple(record.get(n) for n in self.names)
        except Exception as e:  # noqa: BLE001 - other sources go on
            failed = {"source": partition.path, "error": f"{type(e).__name__}: {e}"}
            yield tuple(failed.get(n) for n in self.names)

    def message_file(self, path: Path, root: Path) -> dict | None:
        """The record of a file in a tree; none if it is no message or has neither headers nor subject."""
        try:
            raw = path.read_bytes()
            record = mailbox.read_eml(raw, mailbox.eml_folder(path, root), str(path)) if mailbox.looks_like_message(raw) else None
        except Exception as e:  # noqa: BLE001 - the directory's other files go on
            return {"source": str(path), "error": f"{type(e).__name__}: {e}"}
        return record if record and (record.get("error") or record["headers"] or record["subject"]) else None

    def records(self, part: Part) -> Iterator[dict]:
        if part.kind in ("eml", "maildir"):
            for path in mailbox.eml_files(part.files[0], part.start, part.end):
                if (record := self.message_file(path, Path(part.path))) is not None:
                    yield record
        elif part.kind == "eml-file":
            if (record := mailbox.read_eml(Path(part.path).read_bytes(), "Inbox", part.path)) is not None:
                yield record
        elif part.kind == "pst":
            yield from pst.read(part.path)
        elif part.kind == "mbox-archive":
            if part.files:
                with zipfile.ZipFile(part.path) as z:
                    for name in part.files:
                        with z.open(name) as f:
                            yield from mailbox.read_member(part.path, name, io.BufferedReader(f))
            else:
                found = False
                with tarfile.open(part.path) as t:
                    for info in t:
                        if info.isfile() and (mailbox.is_mailbox(info.name) or info.name.lower().endswith(".eml")):
                            found = True
                            yield from mailbox.read_member(part.path, info.name, io.BufferedReader(t.extractfile(info)))
                if not found:
                    raise RuntimeError(f"{part.path} holds no mailbox")
        else:
            with open(part.path, "rb") as f:
                unpack = mailbox.opener(f.peek(8)[:8])
                stream, start, end = (unpack(f), 0, None) if unpack else (f, part.start, part.end)
                if unpack and part.start:
                    return  # forced to be read as plain, but compressed: the first range reads it all
                yield from mailbox.read_mbox(stream, mailbox.folder_of_file(Path(part.path).name), part.path, self.unquote, start, end)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mail"

    def schema(self) -> StructType:
        return MESSAGE

    def reader(self, schema: StructType) -> MailReader:
        return MailReader(schema, dict(self.options))


def read_mail(spark: SparkSession, *paths: str, kind: str | None = None, unquote: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MailSource)
    reader = spark.read.format("mail").option("paths", json.dumps(list(paths))).option("unquote", str(unquote).lower()).option("range_bytes", range_bytes)
    return (reader.option("kind", kind) if kind else reader).load()
