"""Mail that keeps arriving: files are read as a stream and stored once by uid.

Every micro-batch is admitted against what is stored, so files may be delivered again and batches repeated without harm. Placement uses a global
aggregate over all mail, so it is worked out anew from the store after a batch, not in streaming state.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postquarry.storage import exists, names
from postquarry.sources.mailbox import folder_of_file, opener, read_eml, read_mbox

ROW = "uid_source string, folder string, message_id string, subject string, from_addr string, date_raw string, body_text string, body_html string, error string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            raw = bytes(content)
            unpack = opener(raw[:8])
            raw = unpack(io.BytesIO(raw)).read() if unpack else raw
            if path.lower().endswith((".eml", ".emlx")):
                found = [r for r in [read_eml(raw, "Inbox", path)] if r]
            else:
                found = list(read_mbox(io.BytesIO(raw), folder_of_file(path), path))
            rows += [(f"{path}#{r['pos']}", r["folder"], r.get("message_id"), r.get("subject"), (r.get("sender") or {}).get("addr"), r.get("date_raw"), r.get("body_text"), r.get("body_html"), r.get("error")) for r in found]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])


def parse_files(files: DataFrame) -> DataFrame:
    """Records of a binaryFile frame, with uid."""
    rows = files.select("path", "content").mapInPandas(_parse, ROW)
    made = F.sha1(F.encode(F.concat_ws("\x00", F.lit("syn"), *[F.coalesce(c, F.lit("")) for c in ("date_raw", "from_addr", "subject", "body_text")]), "utf-8"))
    known = F.sha1(F.encode(F.concat(F.lit("mid\x00"), F.col("message_id")), "utf-8"))
    return rows.withColumn("uid", F.substring(F.when(F.coalesce("message_id", F.lit("")) != "", known).otherwise(made), 1, 20))


def admit(batch: DataFrame, store: str) -> DataFrame:
    """Rows of the batch whose uid is new, one each: the copy with the longest body."""
    size = F.length(F.coalesce("body_text", F.lit(""))) + F.length(F.coalesce("body_html", F.lit("")))
    kept = [c for c in batch.columns if c != "uid"]
    best = F.max_by(F.struct(*kept), F.struct(size.alias("n"), F.col("uid_source").alias("s")))
    one = batch.where("error is null").groupBy("uid").agg(best.alias("_r")).select("uid", "_r.*")
    if not any(n.startswith("batch=") for n in names(batch.sparkSession, store)):
        return one
    return one.join(batch.sparkSession.read.parquet(store).select("uid"), "uid", "left_anti")


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts the stream over what is in folder now; a later call goes on where it ended. after(store, batch) may publish."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        # a repeated batch overwrites its own part only
        target = f"{store}/batch={number}"
        if not exists(batch.sparkSession, f"{target}/_SUCCESS"):
            admit(batch, store).write.mode("overwrite").parquet(target)
        if after is not None:
            after(batch.sparkSession.read.parquet(store), number)

    return parse_files(files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
