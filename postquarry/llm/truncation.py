"""Texts cut off by field limits or in transfer.

Intact texts are cut artificially to give positive cases; hashed logistic regression over closing characters, the shape of the
last line and sentence, and the number of texts of the same source and length then scores every text. Only training uses a
bounded sample (sample_size texts, the ones of lowest hash); lengths are counted over all texts and all are scored. The closing is looked
for in the last LAST_LINES and LAST_SENTENCE characters: a longer line or sentence counts as one that long.

The number of texts of equal length enters as one of BUCKETS steps, so each text is scored once for every step where it is read. Texts that are
cut at every step or at none need no count; only the others are joined with the counts, as numbers, without their text.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
SLOTS = 40
BUCKETS = 7  # steps of the number of other texts of equal length: 0, 1, 2-3, 4-7, and so on, the last open
LAST_LINES, LAST_SENTENCE = 2000, 600
_MARK = re.compile(r"(?:\s*(?:\[[^\[\]\n]{0,60}\]|\([^()\n]{0,60}\)|<[^<>\n/]{1,30}>|\*{1,3} ?[^*\n]{1,40}\*{1,3}|\.{3,}|…))+\ufffd?$")
_SENTENCE = re.compile(r"[.!?…]+[\"'”»)\]]*\s+|\n\s*\n")
_BULLET = re.compile(r"^\s*(?:[*•‣–—+-]|\d{1,3}[.)])\s+")
_LINK = re.compile(r"(?:https?://|www\.|mailto:)\S+$", re.I)
_FILE = re.compile(r"[\w-]+\.[a-z0-9]{2,5}$", re.I)
_TAGS = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*\s*>)+$")
_QUOTE = re.compile(r"^(?:\s*[>|])+ ?")


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-ZÀ-ÞА-Я]", "A", word))))[:8]


def _char(c: str) -> str:
    return "a" if c.isalpha() else "9" if c.isdigit() else c


def _bucket(n: int) -> int:
    return n if n < 5 else min(12, 4 + n.bit_length())


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def bucket(same_length: int) -> int:
    return min(BUCKETS - 1, same_length.bit_length())


def features(text: str, same_length: int) -> list[int]:
    """Slots of the hashed features; same_length is the number of other texts of the source with this length."""
    fixed, counted = closing_features(text)
    return fixed + counted[bucket(same_length)]


def closing_features(text: str) -> tuple[list[int], list[list[int]]]:
    """(slots of the features of the closing, slots to add for each step of the number of texts of equal length)."""
    end = _TAGS.sub("", text.rstrip())
    broken = end.endswith("\ufffd")
    end = end.rstrip("\ufffd")
    mark = _MARK.search(end)
    core = end[: mark.start()] if mark else end
    lines = core[-LAST_LINES:].split("\n")
    last = _QUOTE.sub("", lines[-1]) if lines else ""
    before = lines[-2].strip() if len(lines) > 1 else ""
    apart = len(lines) > 1 and not before.strip("> |")
    tail = core[-LAST_SENTENCE:]
    starts = [m.end() for m in _SENTENCE.finditer(tail)]
    sentence = tail[starts[-1] :] if starts and starts[-1] < len(tail) else tail
    words, line_words = sentence.split(), last.split()
    word = words[-1] if words else ""
    closing = (core[-1:] or " ") if not mark else "~" + (core[-1:] or " ")
    kind = _char(closing[-1])
    form = (
        "bullet" if _BULLET.match(last) else "link" if _LINK.search(last) else "file" if _FILE.search(last) and " " not in last.strip()
        else "short" if len(line_words) <= 8 and apart else "line" if apart else "run"
    )
    ended = kind in ".!?…)]}\"'”»。"
    m = "m" if mark else "b" if broken else "-"
    found = [
        f"c:{m}{kind}", f"f:{form}", f"cf:{m}{kind}{form}", f"e:{m}{ended}{form}", f"n:{m}{ended}{_bucket(len(words))}",
        f"l:{form}{_bucket(len(line_words))}{ended}{m}", f"s:{_shape(word)}{m}", f"w:{word.lower()}{m}{ended}", f"t:{word[-3:].lower()}{m}{ended}",
        f"i:{words[0].lower() if words else ''}{m}{ended}", f"j:{form}{line_words[0].lower() if line_words else ''}{ended}",
        f"k:{form}{_shape(line_words[0]) if line_words else ''}{ended}", f"p:{' '.join(words[:2]).lower()}{m}{ended}", f"q:{' '.join(words[-2:]).lower()}{m}{ended}",
        f"z:{form}{' '.join(_shape(x) for x in line_words[:3])}", f"a:{form}{' '.join(line_words[-2:]).lower()}{ended}", f"h:{sentence.lower()[:80]}",
        f"g:{ended}{m}", f"b:{m}{len(word)}{ended}",
        f"o:{'upper' if sentence[:1].isupper() else 'lower'}{ended}{form}", f"sp:{len(text) - len(end) > 0}{ended}", f"u:{sum(map(str.isdigit, last)) > 2}{form}{ended}",
    ]
    counted = [[_slot(f"y:{k}{m}{ended}"), _slot(f"x:{k}{form}")] for k in range(BUCKETS)]
    return [_slot(x) for x in found], counted


def note(body: str, rng: random.Random) -> str:
    """A made-up note of an omission: dots, or some words of the text in brackets or between stars, in the line or on one of its own."""
    if rng.random() < 0.5:
        return rng.choice(["...", "…", " ...", " …", "[...]", " [...]", "[…]"])
    words = re.findall(r"[^\W\d_]{2,}", body[:4000]) or ["x"]
    few = " ".join(rng.choice(words).lower() for _ in range(rng.randint(1, 4)))
    dots = rng.choice(["", "", "... "])
    left, right = rng.choice([("[", "]"), ("[", "]"), ("(", ")"), ("<", ">"), ("** ", " **"), ("*", "*")])
    return rng.choice([" ", " ", "\n", "\n\n"]) + left + dots + few + dots[::-1] + right


def cut(text: str, rng: random.Random) -> str | None:
    """The text cut inside a word or sentence, or None where it has no such place."""
    body = text.rstrip()
    for _ in range(12):
        at = rng.randrange(min(len(body) - 1, 40), len(body)) if len(body) > 60 else 0
        if at <= 0:
            return None
        piece = body[:at]
        line = _QUOTE.sub("", piece[piece.rfind("\n") + 1 :])
        rest = body[at : at + 60]
        full = body[body.rfind("\n", 0, at) + 1 :].split("\n", 1)[0]
        # only inside running text: list entries, headings and short closing lines are complete wherever they stop
        if _BULLET.match(line) or len(full.split()) < 6 or not rest.strip() or len(line.strip()) < 2:
            continue
        if piece.rstrip()[-1:] in ".!?…:;)\"'”»":
            continue
        if rng.random() < 0.06:
            return piece + "\ufffd" + rng.choice(["", "", "…", "..."])
        return piece + (note(body, rng) if rng.random() < 0.45 else "")
    return None


def _matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), SLOTS), 1 << BITS, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, seed: int = 7) -> np.ndarray:
    w = np.zeros((1 << BITS) + 1)
    square = np.full_like(w, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 128):
            part = order[a : a + 128]
            slots, at = np.unique(x[part], return_inverse=True)
            p = 1 / (1 + np.exp(-np.clip(w[x[part]].sum(1), -30, 30)))
            grad = np.bincount(at.ravel(), np.repeat((p - y[part]) / len(part), x.shape[1]), len(slots)) + 1e-5 * w[slots]
            square[slots] += grad**2
            w[slots] -= 0.2 * grad / np.sqrt(square[slots])
            w[-1] = 0
    return w


def train(texts: list[tuple[str, int]], seed: int = 11) -> np.ndarray:
    """Weights from (text, same_length). The originals are the negative cases; those the first fit takes for cut are left out
    of the second, as some are."""
    rng = random.Random(seed)
    pos = []
    for text, _ in texts:
        for _ in range(2):
            if (c := cut(text, rng)) is not None:
                # a cut at a limit is shared by others of the source
                pos.append(features(c, rng.choice([0, 0, 0, 1, 2, 4, 9, 20, 50])))
    neg = [features(t, n) for t, n in texts]
    if not pos or not neg:
        return np.zeros((1 << BITS) + 1)
    x, y = _matrix(pos + neg), np.array([1.0] * len(pos) + [0.0] * len(neg))
    w = np.zeros(1)
    for most in (-3.0, -1.5, -1.0):
        w = _fit(x, y)
        score = w[_matrix(neg)].sum(1)
        sure = [r for r, s in zip(neg, score) if s < most]
        x, y = _matrix(pos + sure), np.array([1.0] * len(pos) + [0.0] * len(sure))
    return w


def length_counts(documents: DataFrame) -> DataFrame:
    """(source, _n, _same): how many different texts of a source have a length besides one; only where there are others."""
    whole = documents.where(F.length(F.trim("text")) > 0)
    told = whole.select("source", F.length("text").alias("_n"), F.xxhash64("text").alias("_h")).distinct()
    return told.groupBy("source", "_n").agg((F.count("*") - 1).cast("int").alias("_same")).where("_same > 0")


def truncated(documents: DataFrame, sample_size: int = 4000, threshold: float = -0.5) -> DataFrame:
    """(doc_id, source, score) of texts that stop inside a word or a sentence. Null and blank texts are none."""
    # hashes spread evenly, so a bound on them keeps what each task sends near its part of the sample
    n = documents.select("doc_id").count()
    order = F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 1)
    bound = min((1 << 63) - 1, (1 << 63) * 2 * sample_size // max(n, 1))
    pool = documents.select("source", "text", order.alias("_o")).where((F.col("_o") <= bound) & (F.length(F.trim("text")) > 0))
    picked = [tuple(r) for r in pool.orderBy("_o", "text").limit(sample_size).select("source", "text").collect()]
    sizes = {(r[0], r[1]): r[2] for r in length_counts(documents).join(
        F.broadcast(documents.sparkSession.createDataFrame(sorted({(s, len(t)) for s, t in picked}, key=str), "_s string, _l int")),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_n") == F.col("_l")),
    ).select("source", "_n", "_same").collect()}
    sample = [(t, sizes.get((s, len(t)), 0)) for s, t in picked]
    seen = {t: n for t, n in sample}
    weights = train(sorted(seen.items()))

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [closing_features(t) for t in texts]
            fixed = weights[_matrix([f for f, _ in found])].sum(1) if found else []
            yield pd.Series([(base + weights[np.array(counted)].sum(1)).tolist() for base, (_, counted) in zip(fixed, found)], dtype=object)

    whole = documents.where(F.length(F.trim("text")) > 0)
    scored = whole.select("doc_id", "source", F.length("text").alias("_n"), scores("text").alias("_s")).where(F.array_max("_s") > threshold)
    counts = length_counts(documents).withColumnRenamed("source", "_c")
    key = F.col("source").eqNullSafe(F.col("_c")) & (scored["_n"] == counts["_n"])
    steps = F.length(F.regexp_replace(F.bin(F.coalesce("_same", F.lit(0)).cast("bigint")), "^0$", ""))
    score = F.get("_s", F.least(steps, F.lit(BUCKETS - 1)))
    return scored.join(counts, key, "left").select("doc_id", "source", score.alias("score")).where(F.col("score") > threshold)


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) over all texts that aren't blank; a null source is one of its own."""
    found = truncated(documents).groupBy("source").agg(F.count("*").alias("cut")).withColumnRenamed("source", "_s")
    texts = documents.where(F.length(F.trim("text")) > 0).groupBy("source").agg(F.count("*").alias("texts"))
    rates = texts.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return rates.select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("rate"))
