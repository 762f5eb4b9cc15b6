"""Addresses that open a reply or forward in a mail program."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postquarry import schema as S
from postquarry.functions.text import text


def encoded(c: Column) -> Column:
    """Percent encoding that leaves letters, digits and _.-~ and writes a space as %20."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def mailto(kind: str, subject: Column, sender_name: Column, sender_addr: Column, body: Column, message_id: Column, reply_to: Column | None = None, to: Column | None = None, cc: Column | None = None) -> Column:
    """mailto address for kind reply, replyall or forward; empty where a reply has no one to go to."""
    given = lambda c: F.nullif(text(c), F.lit(""))
    target = F.coalesce(*([given(reply_to)] if reply_to is not None else []), text(sender_addr))
    known = text(subject).rlike(r"(?iU)^\s*fwd?:" if kind == "forward" else r"(?iU)^\s*re:")
    title = F.when(known, text(subject)).otherwise(F.concat(F.lit("Fwd: " if kind == "forward" else "Re: "), text(subject)))
    lines = F.split(F.regexp_replace(text(body), r"\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    quoted = F.array_join(F.transform(F.slice(lines, 1, S.QUOTE_LINES), lambda x: F.concat(F.lit("> "), x)), "\n")
    who = F.coalesce(given(sender_name), given(sender_addr), F.lit("someone"))
    letter = F.concat(F.lit("\n\n"), who, F.lit(" wrote:\n"), quoted)
    letter = F.when(F.length(letter) > S.QUOTE_CHARS, F.concat(F.substring(letter, 1, S.QUOTE_CHARS), F.lit("\n[… quoted text truncated …]"))).otherwise(letter)
    parts = [F.lit("?subject="), encoded(title), F.lit("&body="), encoded(letter)]
    people = target
    if kind == "replyall":
        others = F.filter(to, lambda a: (a != "") & (a != target))
        people = F.array_join(F.concat(F.array_compact(F.array(F.nullif(target, F.lit("")))), others), ",")
        parts += [F.when(F.size(cc) > 0, F.concat(F.lit("&cc="), encoded(F.array_join(cc, ",")))).otherwise("")]
    if kind != "forward":
        parts += [F.when(text(message_id) != "", F.concat(F.lit("&in-reply-to="), encoded(F.concat(F.lit("<"), message_id, F.lit(">"))))).otherwise("")]
    address = F.replace(F.replace(encoded(people), F.lit("%40"), F.lit("@")), F.lit("%2C"), F.lit(","))
    out = F.concat(F.lit("mailto:"), address, *parts)
    return out if kind == "forward" else F.when(target == "", "").otherwise(out)
