"""Text decoded with the wrong character encoding: found and restored.

Words with characters beyond ASCII, or with signs of lost ones, are nodes of a graph whose edges encode, decode or unescape them, or give lost
characters up. A best-first search led by the plausibility of the characters (cost) and the length of the way takes the cheapest text it can
reach; visited states are kept by hash. A field is garbled if the search gains enough over its words, and nothing else makes it so. Words
repeat a great deal, so results are cached in each Python worker.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings text may have been read with, and those it may have been written in.
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "mac-roman", "cp437", "cp850", "koi8-r", "cp866"]
WRITTEN_IN = ["utf-8", "cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850"]
# Russian letters with their usual frequency in per mille.
RUSSIAN = {
    "о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 44, "к": 35, "м": 32,
    "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19, "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10,
    "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 1, "ё": 3,
}
_LOWER = "a-zß-öø-ÿšžłœ"
_UPPER = "A-ZÀ-ÖØ-ÞŠŽŁŒ"
_LETTER = f"{_LOWER}{_UPPER}а-яёА-ЯЁ"
_USUAL = f"\x00-\x7f{_LETTER}\xa0¡¿«»ªº°§£€©®‘’“”„‚–—…·•×№\ue000"
COSTS = [
    (re.compile("�"), 4.0),
    (re.compile("[\x80-\x9f]"), 4.0),
    (re.compile(f"[^{_USUAL}�\x80-\x9f]"), 2.0),
    (re.compile(f"(?<=[{_LETTER}])[^{_USUAL}�\x80-\x9f]|[^{_USUAL}�\x80-\x9f](?=[{_LETTER}])"), 1.5),
    (re.compile(f"(?<=[{_LETTER}])[¡¿ªº°£€©®„‚•№§×]|[°£€©®•·×](?=[{_LETTER}])"), 3.0),
    (re.compile(f"(?<=[{_LETTER}])[«»“”–—…·](?=[{_LETTER}])"), 2.0),
    (re.compile("(?<=[ÃÂÐÑâĂГРÔ√├┬Γ])[\xa0°§«»“”‘’–—…·•£€©®]"), 2.0),
    (re.compile("[ÃÂÅ][œžšŸŒŠŽ]"), 2.0),
    # English contractions (any not; pronouns with is), amounts and quotes whose sign became a letter
    (re.compile("(?<=[a-z]n)[íÆ´]t\\b"), 3.0),
    (re.compile("\\b(?:[Ii]t|[Tt]hat|[Ww]hat|[Tt]here|[Hh]ere|[Hh]e|[Ss]he|[Ll]et|[Ww]ho)[íÆ´]s\\b"), 3.0),
    (re.compile("(?<![^\\W\\d])[À-ÖØ-ÞА-ЯЁа-яё](?=\\d)"), 2.5),
    (re.compile("‚(?=[À-Þ])"), 3.0),
    (re.compile("\\b[ÿìî](?=[a-z]{2})"), 1.5),
    (re.compile("¿(?=[^\\W\\d])"), 1.3),
    (re.compile("(?<=[A-Z])[À-ÖØ-Þ](?=[a-z])|[À-ÖØ-Þ]{2}(?=[a-z])"), 2.0),
    (re.compile("[‘’](?=[А-Яа-я])|(?<=[А-Яа-я])[‘’“]"), 1.0),
    (re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-ÞŠŽŁŒ]"), 2.5),
    (re.compile("(?<=[à-öø-ÿ])[à-öø-ÿ]"), 1.0),
    (re.compile("(?<=[À-ÖØ-Þ])[À-ÖØ-Þ]"), 1.0),
    (re.compile("[À-ÖØ-ÞŠŽŁŒ](?=[à-öø-ÿ])"), 0.7),
    (re.compile("(?<=[а-яё])[А-ЯЁ]"), 1.5),
    (re.compile("(?<=[А-ЯЁ])[А-ЯЁ]"), 0.15),
    (re.compile("[а-яёА-ЯЁ](?=[A-Za-zÀ-ÿ])|[A-Za-zÀ-ÿ](?=[а-яёА-ЯЁ])"), 2.0),
    (re.compile("&(?:#\\d{2,5}|#x[0-9A-Fa-f]{2,4}|[A-Za-z]{2,8});"), 1.5),
    # a question mark in place of a letter or sign, before the last letters of a word
    (re.compile(f"(?<=[{_LETTER}])\\?(?=[a-z]{{1,2}}(?![\\w=]))"), 2.5),
    (re.compile("\ue000"), 1.0),
]
_ANY = re.compile("|".join(f"(?:{p.pattern})" for p, _ in COSTS))
CYRILLIC = re.compile("[а-яёА-ЯЁ]")
# characters lost for good: replacements, controls that no encoding explains, and question marks within words. GIVEN_UP stands for one of them
LOST = re.compile(f"[\ufffd\x80-\x9f]|(?<=[{_LETTER}])\\?(?=[a-z])")
QUESTIONED = re.compile(f"(?<=[{_LETTER}])\\?(?=[a-z]{{1,2}}(?![\\w=]))")
GIVEN_UP = "\ue000"
_SPACES = re.compile("[\n\r\t]")
BEYOND = re.compile(r"[^ \t\r\n\x0b\x0c]*(?:[^\x00-\x7f]|&#?\w{2,8};)[^ \t\r\n\x0b\x0c]*")
# STEP: what the first decoding costs, MORE: each further one; MARGIN: what a field must gain; PLAIN: text that costs less ends a search; MOST_STATES: texts and
# byte strings one search looks at, after which the best one found counts
STEP, MORE, MARGIN, PLAIN, MOST_STATES = 0.35, 1.5, 1.2, 0.25, 2000
_LOG = {c: 0.12 * (math.log2(1000 / n) - 4.45) for c, n in RUSSIAN.items()}


def cost(text: str) -> float:
    """How implausible the characters of the text are beside each other; about 0 for ordinary writing."""
    total = 0.0
    if not text.isascii() or "&" in text or "?" in text:
        if _ANY.search(text):
            for pattern, weight in COSTS:
                if found := pattern.findall(text):
                    total += weight * len(found)
        for c in CYRILLIC.findall(text):
            total += _LOG[c.lower()]
    return total


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    if codec in ("cp1252", "cp1250", "cp1251", "iso8859-15"):
        # bytes the code page leaves open were often passed through as control characters
        try:
            return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(codec) for c in text)
        except UnicodeEncodeError:
            pass
    return None


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _price_of(hops: int) -> float:
    """What a way of so many decodings costs: text is rarely decoded wrongly more than once."""
    return STEP * min(hops, 1) + MORE * max(0, hops - 1)


def _promise(raw: bytes) -> float:
    """What bytes may cost as text: if they read as UTF-8, which hardly happens by chance, what that costs, else no more than plain text."""
    read = _decode(raw, "utf-8")
    return PLAIN if read is None else min(PLAIN, cost(read))


def _hope(text: str, price: float) -> float:
    """What a text may cost in the end: no more than plain text if its own bytes read as UTF-8 once more."""
    again = (raw for c in READ_AS if (raw := _encode(text, c)))
    return PLAIN if price > PLAIN and not text.isascii() and any(_decode(raw, "utf-8") is not None for raw in again) else price


def search(text: str) -> tuple[str, float, str]:
    """(cheapest reachable text, its cost, path to it).

    States are texts and byte strings. The queue is led by what a state costs or promises to cost, plus the price of the way to it. The
    search ends where every state in the queue is led by more than the best text, its way and one more decoding cost, where a plain text was found
    and none is led by less, or after MOST_STATES.
    """
    own = cost(text)
    best = (own, own, text, "")
    seen, queue, n = {hash((str, text))}, [(own, 0, 0, text, "")], 0
    while queue and len(seen) < MOST_STATES:
        led, _, hops, state, path = heapq.heappop(queue)
        if best[3] and led >= best[0] + (0 if best[1] < PLAIN else MORE):
            break
        if isinstance(state, bytes):
            edges = [(f"decode {c}", _decode(state, c)) for c in WRITTEN_IN]
        else:
            edges = [(f"encode {c}", _encode(state, c)) for c in READ_AS]
            if "&" in state:
                edges.append(("unescape", html.unescape(state)))
            if LOST.search(state):
                edges.append(("lose", LOST.sub(GIVEN_UP, state)))
        for name, new in edges:
            # a text and its bytes may share a plain hash
            if not new or (key := hash((type(new), new))) in seen:
                continue
            seen.add(key)
            n += 1
            way = f"{path} > {name}"
            if isinstance(new, bytes):
                heapq.heappush(queue, (_promise(new) + _price_of(hops + 1), n, hops, new, way))
                continue
            # few senders wrote in these
            price = cost(new) + (0.3 if name in ("decode mac-roman", "decode cp437", "decode cp850") else 0.0)
            whole = price + _price_of(hops + 1)
            if whole < best[0]:
                best = (whole, price, new, way)
                if price < PLAIN and name == "decode utf-8" and not hops:
                    return new, price, way[3:]
            hope = _hope(new, price) if name == "decode utf-8" else price
            heapq.heappush(queue, (hope + _price_of(hops + 1), n, hops + 1, new, way))
    return best[2], best[1], best[3][3:]


@lru_cache(maxsize=200_000)
def word_result(word: str) -> tuple[float, str, float, str]:
    """(cost, restored word, its cost, path). A word that costs no more than a step has no cheaper way; those with Cyrillic letters, which
    may cost less than nothing, are searched together."""
    price = cost(word)
    if price <= STEP:
        return price, word, price, ""
    return price, *search(word)


def repair(text: str | None) -> tuple[bool, str | None, str]:
    """(found, restored text, paths): null and plain ASCII text is never found; what can't be restored stays as it is."""
    found, swap, paths = repaired_words(text)
    return found, BEYOND.sub(lambda m: swap.get(m[0], m[0]), text) if swap else text, paths


def _given_back(word: str, new: str) -> str:
    """The restored word with the characters that were given up as they stood."""
    if GIVEN_UP not in new:
        return new
    lost = iter(LOST.findall(word))
    return re.sub(GIVEN_UP, lambda _: next(lost, "\ufffd"), new)


def _candidates(text: str) -> set[str]:
    """Words that could be garbled: those of BEYOND, and with question marks for letters if any word shows that surely."""
    # not str.split(): a no-break space may be half of a garbled letter
    questioned = "?" in text and bool(QUESTIONED.search(text))
    return {w for w in _SPACES.sub(" ", text).split(" ") if not w.isascii() or "&" in w and BEYOND.fullmatch(w) or questioned and "?" in w and LOST.search(w)}


def repaired_words(text: str | None) -> tuple[bool, dict[str, str], str]:
    """(found, restored words by garbled ones, paths): the words are those of BEYOND."""
    if not text:
        return False, {}, ""
    # an inverted question mark opens a question where the text has the one that ends it
    asks = "?" in text
    stem = {w: w.lstrip("¿") if asks else w for w in _candidates(text)}
    words = {x for x in stem.values() if x and (not x.isascii() or "&" in x or "?" in x)}
    if not words:
        return False, {}, ""
    results = {w: word_result(w) for w in words}
    gains = {w: r[0] - r[2] for w, r in results.items() if r[3]}
    cyrillic = [w for w in words if CYRILLIC.search(w)]
    before = sum(results[w][0] for w in cyrillic)
    if before >= MARGIN and before > 0.06 * sum(map(len, cyrillic)):
        # single words of swapped Cyrillic say little; together they do
        joint = "\n".join(cyrillic)
        before = cost(joint)
        after, price, path = search(joint)
        pieces = after.split("\n")
        if path and before - price >= MARGIN and len(pieces) == len(cyrillic):
            for w, new in zip(cyrillic, pieces):
                results[w] = (results[w][0], new, cost(new), path)
            gains = {w: r[0] - r[2] for w, r in results.items() if r[3]} | {"": before - price}
    elif cyrillic:
        gains = {w: g for w, g in gains.items() if g >= MARGIN}
    if sum(g for g in gains.values() if g > 0) < MARGIN:
        return False, {}, ""
    garbled = [w for w, r in results.items() if r[0] > STEP and "\ufffd" not in w and not w.isascii()]
    if len(garbled) > 1 and not cyrillic:
        # several readings of a word may be plain; all words together mostly have one, often that of the most words
        alone = sum(results[w][2] for w in garbled)
        for path, _ in Counter(results[w][3] for w in garbled if results[w][3]).most_common():
            pieces = [follow(w, path) for w in garbled]
            if None not in pieces and sum(map(cost, pieces)) <= alone + PLAIN:
                break
        else:
            after, price, path = search("\n".join(garbled))
            pieces = after.split("\n") if path and price <= alone + PLAIN else []
        if len(pieces) == len(garbled):
            for w, new in zip(garbled, pieces):
                results[w] = (results[w][0], new, cost(new), path)
    ways = Counter(r[3] for r in results.values() if r[3])
    restored = {w: _given_back(w, r[1]) for w, r in results.items() if r[3]}
    if ways:
        common = ways.most_common(1)[0][0]
        for w, r in results.items():
            # words too plain to tell by themselves follow the field's usual path where that costs nothing
            if w not in restored and (new := follow(w, common)) and cost(new) <= r[0]:
                restored[w] = _given_back(w, new)
    swap = {w: w[: len(w) - len(x)] + restored[x] for w, x in stem.items() if x in restored and restored[x] != x}
    return True, swap, "; ".join(ways)


def follow(text: str, path: str) -> str | None:
    """The text after the steps of a path, or None where a step can't be taken."""
    state: str | bytes | None = text
    for step in path.split(" > "):
        name, _, codec = step.partition(" ")
        if state is None:
            return None
        state = html.unescape(state) if name == "unescape" else LOST.sub(GIVEN_UP, state) if name == "lose" else _encode(state, codec) if name == "encode" else _decode(state, codec)
    return state if isinstance(state, str) else None


RESULT = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("path", T.StringType())])


@F.pandas_udf(RESULT)
def repair_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([repair(x) for x in batch], columns=["found", "restored", "path"])


def suspect(c: Column) -> Column:
    """Whether a text could be garbled at all: most rows end here, in the JVM."""
    return F.coalesce(c.rlike(r"[^\x00-\x7F]|&#?\w{2,8};|[A-Za-z]\?[a-z]"), F.lit(False))


def fields(messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """(rec_key, field_name, text) of the fields in question; null and plain fields are left out."""
    parts = [
        messages.select(F.col("read_ord").alias("rec_key"), F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("subject", "body_text")
    ] + [addresses.select(F.col("address_id").alias("rec_key"), F.lit("addr_name").alias("field_name"), F.col("addr_name").alias("text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(suspect(F.col("text")))


def restore_fields(messages: DataFrame, addresses: DataFrame) -> DataFrame:
    """(rec_key, field_name, text, restored, path) of garbled fields. Where nothing better can be reached restored equals text."""
    rows = fields(messages, addresses).withColumn("_r", repair_udf("text")).where("_r.found")
    return rows.select("rec_key", "field_name", "text", "_r.restored", "_r.path")
