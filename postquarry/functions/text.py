"""Normalisers of the message record as column functions; all of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from postquarry import schema as S


def mapping(key: Column, values: dict) -> Column:
    """values[key], null for other keys."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def text(c: Column | str) -> Column:
    """The column with null as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def normalize_subject(c: Column) -> Column:
    return squeeze(F.regexp_replace(text(c), r"(?iuU)^\s*(?:(?:re|fw|fwd|aw|sv|vs|antwort)\s*(?:\[\d+\])?\s*:\s*)+", ""))


def list_subject(c: Column) -> Column:
    """The form subjects are sorted by in lists; it knows fewer prefixes than normalize_subject."""
    return F.lower(F.regexp_replace(text(c), r"(?iuU)^\s*(?:(?:re|fwd?|aw|sv)\s*:\s*)+", ""))


def normalize_folder(c: Column) -> Column:
    """The archive's name for the first segment; the rest stays as it is; nothing becomes Inbox."""
    clean = F.regexp_replace(F.regexp_replace(text(c), r"(?U)^\s+|\s+$", ""), "^/+|/+$", "")
    head = F.regexp_replace(F.regexp_extract(clean, "^([^/]*)", 1), r"(?U)^\s+|\s+$", "")
    head = F.coalesce(mapping(F.lower(head), S.FOLDER_ALIASES), head)
    tail = F.regexp_extract(clean, "^[^/]*/(.+)$", 1)
    return F.when(clean == "", "Inbox").otherwise(F.when(tail == "", head).otherwise(F.concat(head, F.lit("/"), tail)))


def clean_message_id(c: Column) -> Column:
    inside = F.nullif(F.regexp_extract(text(c), "<([^>]*)>", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(inside, text(c)), r"(?U)[<>\s]+", "")


def parse_references(c: Column) -> Column:
    found = F.regexp_extract_all(text(c), F.lit("<([^>]+)>"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))


def first_address(c: Column) -> Column:
    return F.lower(F.regexp_extract(text(c), S.EMAIL, 0))


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name in any case; empty if there is none."""
    hit = F.filter(headers, lambda h: F.lower(h["k"]) == name.lower())
    return text(F.get(hit, F.lit(0))["v"])


def thread_key(refs: Column, in_reply_to: Column, message_id: Column, uid: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(F.get(refs, F.lit(0))), given(in_reply_to), given(message_id), uid)


def display(name: Column, addr: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(addr, F.lit("")), F.lit("(unknown)"))


def full_address(name: Column, addr: Column) -> Column:
    n, a = text(name), text(addr)
    return F.when((n != "") & (a != ""), F.concat(F.lit('"'), n, F.lit('" <'), a, F.lit(">"))).otherwise(F.when(a != "", a).otherwise(n))


def year_folder(local: Column) -> Column:
    return F.coalesce(F.year(local).cast("string"), F.lit(S.UNDATED))


def place(account: Column | None, year: Column | None, folder: Column, prefix: str = "") -> Column:
    parts = [F.lit(prefix.strip("/"))] if prefix.strip("/") else []
    parts += [F.nullif(F.replace(account, F.lit("/"), F.lit("_")), F.lit(""))] if account is not None else []
    return F.concat_ws("/", *parts, *([year] if year is not None else []), folder)


def folder_sort_key(path: Column) -> Column:
    """Sorts newest years first, then the archive's folders in their order, then others by name, at every depth."""
    order = {x: i for i, x in enumerate(S.FOLDER_ORDER)}

    def key(part: Column) -> Column:
        year, known = part.rlike("^(19|20)[0-9]{2}$"), mapping(part, order)
        rank = F.when(year, 0).when(known.isNotNull(), 1).otherwise(2)
        number = F.when(year, -F.when(year, part).cast("int")).otherwise(F.coalesce(known, F.lit(0)))
        return F.struct(rank.alias("c"), number.alias("n"), F.when(rank == 2, F.lower(part)).otherwise("").alias("s"))

    return F.transform(F.split(path, "/"), key)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one character, and those that fold to several, by compatibility decomposition: all letters of Latin, Greek and
    Cyrillic scripts, and whatever else gives something a token may hold."""
    one, to, many = [], [], {}
    scripts = {*range(0xA0, 0x0590), *range(0x1E00, 0x2200)}
    for cp in [*range(0xA0, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(cp)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c or unicodedata.combining(c) or folded and cp not in scripts and not any(x.isascii() and (x.isalnum() or x in "'._+-") for x in folded):
            continue
        if len(folded) == 1:
            one.append(c)
            to.append(folded)
        else:
            many[c] = folded
    return "".join(one), "".join(to), many


@lru_cache(maxsize=1)
def _marks() -> str:
    """Class of the characters that combine with the one before."""
    marks = [c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in marks if not unicodedata.combining(chr(c + 1))]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]+"


# Signs of several letters that mail really has; they are replaced at once, the others only in texts that have such.
COMMON_SIGNS = ["…", "™", "ﬁ", "ﬂ", "ﬀ", "¼", "½", "¾", "№", "ĳ"]


@lru_cache(maxsize=1)
def _rare_signs() -> str:
    """Class of few ranges that holds all other signs of several letters, and beyond U+2100 what lies between them."""
    ranges: list[list[int]] = []
    for cp in sorted(ord(c) for c in _folding()[2] if c not in COMMON_SIGNS):
        if ranges and cp - ranges[-1][1] <= (0x400 if ranges[-1][1] >= 0x2100 else 1):
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def fold(c: Column) -> Column:
    """Lower case without accents, signs of several letters written out. What no token may hold may stay as it is."""
    one, to, many = _folding()
    out = text(c)
    for sign in COMMON_SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(many[sign]))
    held = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    written = F.array_join(F.transform(F.split(out, ""), lambda x: F.coalesce(F.try_element_at(held, x), x)), "")
    out = F.when(out.rlike(_rare_signs()), written).otherwise(out)
    plain = F.translate(out, one, to)
    return F.lower(F.when(plain.rlike(r"[\p{M}\p{Cn}]"), F.regexp_replace(plain, _marks(), "")).otherwise(plain))


def whole_tokens(c: Column) -> Column:
    raw = F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9][a-z0-9'._+\-]*"), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(t, r"^['._+\-]+|['._+\-]+$", ""))
    return F.filter(bare, lambda t: F.length(t).between(2, 60))


def token_pieces(t: Column) -> Column:
    """Pieces of 2 to 40 characters of a token with inner signs; none of others."""
    parts = F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda p: F.length(p).between(2, 40) & (p != t))
    return F.when(t.rlike(r"[._+\-]"), parts).otherwise(F.array().cast("array<string>"))


def tokenize(c: Column) -> Column:
    """Tokens in order of the text: each of 2 to 60 characters, and after one with inner signs its pieces. Null gives none."""
    return F.flatten(F.transform(whole_tokens(c), lambda t: F.concat(F.array(t), token_pieces(t))))


def query_terms(query: str) -> list[str]:
    """Terms of a query: folded like the index, without pieces, repeats kept."""
    folded = "".join(x for x in unicodedata.normalize("NFKD", query.lower()) if not unicodedata.combining(x))
    return [t for m in re.finditer(r"[a-z0-9][a-z0-9'._+\-]*", folded) if len(t := m[0].strip("'._+-")) > 1]


def shard_of(token: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(token, F.lit(1), n), "[^a-z0-9]", "_"), F.lit("")), F.lit("_"))


def shard_length(tokens: Column) -> Column:
    return F.when(tokens > 120_000, 3).when(tokens > 12_000, 2).otherwise(1)


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("folder"))


def size_text(n: Column) -> Column:
    """Size for people; null stays null. Halves go to the even digit, as Python's formats round, in whole numbers."""

    def rounded(x: Column, unit: int) -> Column:
        whole, rest = F.floor(x / unit), F.lit(2) * (x % unit)
        return whole + ((rest > unit) | ((rest == unit) & (whole % 2 == 1))).cast("bigint")

    kb, tenths = rounded(n, 1024).cast("string"), rounded(n.cast("bigint") * 10, 1048576)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def page_path(uid: Column) -> Column:
    return F.concat(F.lit("msg/"), F.substring(uid, 1, 2), F.lit("/"), uid, F.lit(".html"))


def priority_name(c: Column) -> Column:
    """Name of a priority header's value; empty for normal and unknown ones."""
    word = F.lower(F.regexp_extract(F.trim(text(c)), r"^(\S+)", 1))
    return text(mapping(word, S.PRIORITIES))


def priority_rank(name: Column) -> Column:
    return F.coalesce(mapping(name, S.PRIORITY_RANK), F.lit(0))


def status_flags(c: Column) -> Column:
    """Struct of unread (a status is given and doesn't say read) and flagged of the Status and X-Status headers' letters."""
    return F.struct(((text(c) != "") & ~text(c).contains("R")).alias("unread"), text(c).contains("F").alias("flagged"))


def folder_from_filename(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(text(c), "([^/]*)$", 1), r"(?i)(\.(gz|bz2|xz|lzma|z|mbox|mbx|mbs))+$", "")
    return normalize_folder(stem)


def safe_filename(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(F.replace(text(c), F.lit("\\"), F.lit("/")), "([^/]*)$", 1), r"[^A-Za-z0-9._\- ]+", "_")
    return F.substring(F.regexp_replace(name, "^[ .]+|[ .]+$", ""), 1, S.FILENAME_CHARS)


def safe_url(c: Column) -> Column:
    """The address if its scheme is harmless or missing, else null."""
    schemes = ["http", "https", "mailto", "ftp", "news", "nntp", "tel", "cid"]
    bare = F.regexp_replace(F.regexp_replace(text(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"(?U)^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^\s*([a-zA-Z][a-zA-Z0-9+.\-]*)\s*:", 1))
    return F.when((bare != "") & ((scheme == "") | scheme.isin(schemes)), bare)


def quote_depth(line: Column) -> Column:
    """How many marks of a quote a line begins with, at most five."""
    marks = F.regexp_extract(text(line), "^((?: ?>)*)", 1)
    return F.least(F.length(F.replace(marks, F.lit(" "), F.lit(""))), F.lit(5))


def crude_text(c: Column) -> Column:
    """Text of HTML by patterns alone, with the five basic entities and numbered quotes resolved."""
    out = F.regexp_replace(F.regexp_replace(text(c), r"(?is)<script\b.*?</script\s*>", " "), r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\f\x0b]+", " "))


def linkify_addresses(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?i)\b([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,})", '<a href="mailto:$1">$1</a>')


def highlight(c: Column, words: list[str]) -> Column:
    """Marks the words, after escaping what HTML reads as markup."""
    out = text(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return F.regexp_replace(out, f"(?iu)({'|'.join(map(re.escape, words))})", "<mark>$1</mark>") if words else out


def magic_kind(content: Column) -> Column:
    """What a file's first bytes say it is."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("2142444E"), "pst").when(head.startswith("504B"), "zip").when(head.startswith("1F8B"), "gzip").when(head.startswith("425A68"), "bzip2")
        .when(head.startswith("FD377A585A00"), "xz").otherwise("plain")
    )


def looks_like_message(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return head.rlike(r"(?im)^(?:From |Received:|From:|Date:|Subject:|Message-ID:|MIME-Version:|To:|Return-Path:|X-)")
