"""Message identifiers: the bare form and the hash that serves as uid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_id(c: Column, fold: bool = True) -> Column:
    """The text in the first pair of brackets, or all of it; no brackets or white space; null if nothing is left."""
    inside = F.nullif(F.regexp_extract(c, "<([^<>]*)>", 1), F.lit(""))
    bare = F.regexp_replace(F.coalesce(inside, c), r"(?U)[<>\s]", "")
    return F.nullif(F.lower(bare) if fold else bare, F.lit(""))


def uid_of_id(bare: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit(b"mid\x00"), F.encode(bare, "utf-8"))), 1, 20)
