"""Folders from label lists as a column function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions.text import normalize_folder


def labels_folder(labels: Column) -> Column:
    """Folder of a comma-separated label list; labels in double quotes may hold commas."""
    raw = F.regexp_extract_all(labels, F.lit('(?:^|,)\\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    names = F.filter(F.transform(raw, lambda x: F.trim(F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"')))), lambda x: x != "")
    low = F.transform(names, lambda x: F.lower(x))
    states = F.array(*[F.lit(x) for x in [*S.LABEL_STATES, *S.LABEL_FOLDERS]])
    own = F.get(F.filter(names, lambda x: ~F.array_contains(states, F.lower(x))), F.lit(0))
    out = F.when(own.isNotNull(), normalize_folder(own)).otherwise("Archive")
    for folder in reversed(S.LABEL_PRIORITY):
        keys = [k for k, v in S.LABEL_FOLDERS.items() if v == folder]
        out = F.when(reduce(lambda a, b: a | b, [F.array_contains(low, k) for k in keys]), folder).otherwise(out)
    return out
