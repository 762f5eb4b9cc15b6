"""Change detection against the manifest of the last run, and the manifest's storage.

A manifest is a versioned Parquet directory; a pointer file that is replaced atomically names the current version.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postquarry.storage import names, read_text, write_text

VERSION = 1


def diff(current: DataFrame, manifest: DataFrame, force: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """(uid, action) over both: added, updated, unchanged or gone. current has uid, hash, nav.

    With pages (uid), a message whose page is missing counts as updated; force updates all that were known.
    """
    now = current.select("uid", F.col("hash").alias("_h"), F.col("nav").alias("_n"), F.lit(True).alias("_now"))
    then = manifest.select("uid", F.col("hash").alias("_mh"), F.col("nav").alias("_mn"), F.lit(True).alias("_then"))
    both = now.join(then, "uid", "full_outer")
    changed = ~F.col("_h").eqNullSafe(F.col("_mh")) | ~F.col("_n").eqNullSafe(F.col("_mn")) | F.lit(force)
    if pages is not None:
        both = both.join(pages.select("uid", F.lit(True).alias("_page")), "uid", "left")
        changed = changed | F.col("_page").isNull()
    action = F.when(F.col("_now").isNull(), "gone").when(F.col("_then").isNull(), "added").when(changed, "updated").otherwise("unchanged")
    return both.select("uid", action.alias("action"))


def stats(actions: DataFrame, duplicates: int | Column = 0) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(count("added"), count("updated"), count("unchanged"), count("gone"), F.lit(duplicates).alias("duplicates"))


def next_manifest(current: DataFrame, manifest: DataFrame, now: str, prune: bool = False, rebuilt: DataFrame | None = None) -> DataFrame:
    """(uid, hash, nav, folder, first_seen, last_built): current rows, and gone ones unless they are pruned. first_seen is kept, and last_built of
    rows that are the same, unless they are among those rebuilt (uid)."""
    old = manifest.select("uid", F.col("first_seen").alias("_first"), F.col("hash").alias("_mh"), F.col("nav").alias("_mn"), F.col("last_built").alias("_built"))
    same = F.col("hash").eqNullSafe(F.col("_mh")) & F.col("nav").eqNullSafe(F.col("_mn"))
    if rebuilt is not None:
        current = current.join(rebuilt.select("uid").distinct().withColumn("_again", F.lit(True)), "uid", "left")
        same = same & F.col("_again").isNull()
    rows = current.join(old, "uid", "left").select(
        "uid", "hash", "nav", "folder", F.coalesce("_first", F.lit(now)).alias("first_seen"), F.when(same, F.col("_built")).otherwise(now).alias("last_built")
    )
    if prune:
        return rows
    gone = manifest.join(current.select("uid"), "uid", "left_anti").select("uid", "hash", "nav", "folder", "first_seen", "last_built")
    return rows.unionByName(gone)


def guard_empty(current: DataFrame, manifest: DataFrame, prune: bool = False) -> None:
    """Refuses to go on where nothing was read although something was published before."""
    if not prune and current.isEmpty() and not manifest.isEmpty():
        raise RuntimeError("no message was read, but the archive has some; prune to empty it")


def save(rows: DataFrame, folder: str, sources: dict[str, dict] | None = None) -> str:
    """Writes the next version, sorted by uid, then moves the pointer to it. sources has what is told of each source, such as its fingerprint."""
    spark = rows.sparkSession
    numbers = [int(m[1]) for n in names(spark, folder) if (m := re.fullmatch(r"v(\d+)", n))]
    name = f"v{max(numbers, default=0) + 1}"
    rows.repartitionByRange("uid").sortWithinPartitions("uid").write.parquet(f"{folder}/{name}")
    known = (_pointer(spark, folder) or {}).get("sources", {})
    write_text(spark, f"{folder}/current.json", json.dumps({"version": VERSION, "data": name, "sources": known | (sources or {})}))
    return name


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    try:
        return json.loads(read_text(spark, f"{folder}/current.json") or "null")
    except ValueError:
        return None


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current manifest; none if there is none, it can't be read, or it is of another version."""
    pointer = _pointer(spark, folder)
    return spark.read.parquet(f"{folder}/{pointer['data']}") if pointer and pointer.get("version") == VERSION else None


def known_sources(spark: SparkSession, folder: str) -> dict[str, dict]:
    """What the last runs told of each source."""
    return (_pointer(spark, folder) or {}).get("sources", {})


META = "uid string, folder string, hash string, subject string, nav string, date bigint"
_META = r'(?s)<script[^>]*id="message-meta"[^>]*>(.*?)</script>'


def page_html(meta: Column, article: Column | None = None) -> Column:
    """A page with its record embedded; < is escaped, so no subject can end the script."""
    safe = F.replace(meta, F.lit("<"), F.lit("\\u003c"))
    return F.concat(F.lit('<script type="application/json" id="message-meta">'), safe, F.lit("</script>"), article if article is not None else F.lit(""))


def recover(pages: DataFrame, html: str = "html", kept: list[str] | None = None) -> DataFrame:
    """Records embedded in pages, with columns kept of the pages; pages without a readable one are skipped."""
    found = F.from_json(F.regexp_extract(html, _META, 1), META)
    return pages.select(found.alias("m"), *(kept or [])).where("m.uid is not null").select("m.*", *(kept or []))
