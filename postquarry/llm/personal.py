"""Personal data in free text: found, and replaced by typed placeholders or by surrogates of the same kind and form.

Names are known from the archive's own address book (all of it is aggregated) and from the places names stand in; addresses, numbers and
streets from their forms. One entity has one replacement in all texts and different ones differ: names of the vocabulary are dealt surrogates
in one pass over all of it that resolves collisions, numbers go through a keyed permutation of their digits, and whatever else is replaced
gets a keyed hash of 65 bits or more of the normalised entity.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postquarry.llm.encoding import BEYOND, repaired_words

KINDS = ("email", "phone", "idnum", "street", "person")
MOST_NAMES = 2_000_000
_S = r"(?:[ \xa0\t]{1,8})"  # wrapped lines are widened to spaces before anything is looked for
_WRAP = re.compile(r"\r?\n(?:[ \t]*(?:[>|]|[A-ZÀ-ÞŠŽŁ]{1,3}>)){0,4}[ \t]?")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = rf"(?:@|{_S}?[(\[{{<]{_S}?at{_S}?[)\]}}>]{_S}?|{_S}at{_S}|{_S}AT{_S})"
_DOT = rf"(?:\.|{_S}?[(\[{{<]{_S}?dot{_S}?[)\]}}>]{_S}?|{_S}dot{_S}|{_S}DOT{_S})"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@{_LABEL}(?:\.{_LABEL})+")
DISGUISED = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+(?<=[A-Za-z])")
# every disguised address has one of these words; cheap to look for
_DISGUISE = re.compile(r"\b(?:at|AT|dot|DOT)\b")
_PLAIN_AT = re.compile(rf"^[A-Za-z0-9][\w.+-]*{_S}(?:at|AT){_S}{_LABEL}(?:\.{_LABEL})+$")
PHONE = re.compile(
    rf"(?<![\w.+/@-])(?:\+33{_S}\d(?:{_S}\d\d){{4}}|\+44{_S}(?:\(0\))?\d{{2}}{_S}\d{{4}}{_S}\d{{4}}|\+44{_S}(?:\(0\))?\d{{4}}{_S}\d{{3}}{_S}\d{{3}}|\+1{_S}\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}|\+49{_S}\d{{2,4}}{_S}\d{{4,6}}-\d{{2,4}}|"
    rf"\+\d{{1,3}}(?:[ \xa0.-]{{0,4}}\(0\))?(?:[ \xa0.-]{{0,6}}\d){{7,12}}|00\d{{10,13}}|\(\d{{3}}\){_S}?\d{{3}}-\d{{4}}|\(0\d{{1,4}}\){_S}?\d{{3,6}}(?:[ \xa0-]{{1,6}}\d{{3,4}})?|"
    rf"\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|0\d(?:\.\d\d){{4}}|0\d(?:{_S}\d\d){{4}}|0\d{{4}}{_S}\d{{6}}|0\d{{3}}{_S}\d{{3}}{_S}\d{{4}}|0\d{{2}}{_S}\d{{4}}{_S}\d{{4}})"
    rf"(?:{_S}(?:ext|x|Durchw)\.?{_S}?\d{{1,5}})?(?![\w@]|[.-]\d)"
)
IDNUM = re.compile(
    rf"(?<![\w.+/@-])(?:[A-Z]{{2}}\d{{7}}|[A-Z]{{2}}{_S}\d\d{_S}\d\d{_S}\d\d{_S}[A-D]|[A-Z]{{2}}\d{{6}}[A-D]|\d{{3}}-\d\d-\d{{4}}|\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|\d{{8}}-?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]|"
    r"\d{3}\.\d{3}\.\d{3}-\d\d|\d{3}-\d{3}-\d{3} \d\d|\d{11}|\d{9})(?![\w@]|[.-]\d)"
)
# Words that name numbers of persons, and words that name other numbers.
_PERSONAL = re.compile(
    r"passport|passeport|reisepass|pasaporte|passaporte|паспорт|\bids?\b|identity|national|ausweis|insurance|\bssn\b|social security|sécurité sociale|seguridad social|segurança social|tax|steuer|fiscal|\bdni\b|\bnif\b|\bnie\b|\bcpf\b|"
    r"contribuinte|\bинн\b|снилс|налог|удостоверени|form for|payroll|versicherung|person", re.I
)
_OTHER = re.compile(r"(?:ticket|invoice|part(?:{0} no\.?)?|build|order|parcel|serial|rechnung|bestellung|auftrag|facture|commande|factura|pedido|fatura|счёт|заказ|версия|version|release|case|no|nr|№|#)[.:#]?[ \xa0]{{0,8}}$".format(""), re.I)
_CAP = r"[A-ZÀ-ÞŠŽŁА-Я][\w’'-]+"
_HOUSE_FIRST = re.compile(
    rf"(?<![\w.,/-])\d{{1,4}}[a-z]?,?{_S}(?:{_CAP}{_S}){{1,3}}(?:Street|St\.|Road|Rd\.|Lane|Close|Court|Avenue|Ave\.|Rise|Row|Terrace|Drive|Way|Place|Square|Gardens|Crescent|Hill|Walk|Mews|Yard|Boulevard)\b|"
    rf"(?<![\w.,/-])\d{{1,4}}(?:{_S}?(?:bis|ter))?,?{_S}(?:rue|impasse|avenue|allée|quai|boulevard|place|chemin|ruelle|cours|passage|square|route)\b{_S}(?:(?:de|du|des|la|le|les|l'|d'){_S}?){{0,3}}{_CAP}"
)
_ROAD_FIRST = re.compile(
    rf"\b[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|STRASSE|STRAßE|GASSE|WEG|PLATZ){_S}\d{{1,4}}{_S}?[a-z]?\b|\b{_CAP}{_S}(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee){_S}\d{{1,4}}\b|"
    rf"\b(?:Calle|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|C/|Rua|Travessa|Praça|Av\.|Largo|Estrada|Alameda)(?:{_S}(?:de|del|la|las|los|da|das|do|dos|el)){{0,3}}(?:{_S}{_CAP}){{1,4}},?{_S}(?:n\.?º{_S}?)?\d{{1,4}}|"
    rf"\b(?:Am|Im|Zum|Zur|An der|Auf der|In der){_S}{_CAP}{_S}\d{{1,3}}{_S}?[a-z]?\b(?![.:])|"
    rf"(?:\bул\.|\bулица|\bпр\.|\bпроспект|\bпереулок|\bпер\.){_S}(?:{_CAP}{_S}?){{1,3}},?{_S}(?:д\.{_S}?)?\d{{1,4}}"
)
WORD = re.compile(r"[^\W\d_][\w’'-]*")
_CLOSE = re.compile(r"(?:^|[\s.,(<\"“„«>-])$")
# Greetings and other places where a name follows, by language.
_BEFORE = re.compile(
    r"(?:\b(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|M|Sr|Sra|Dra|Doña|Don)\.?[ \xa0]{1,8}|^[ \t]*(?:Dear|Hi|Hello|Hey|Morning|Good morning|Hallo|Liebe/r|Liebe|Lieber|Guten Tag|Bonjour|Cher/chère|Cher|Chère|Salut|Hola|Buenos días|Querid[oa]|Olá|"
    r"Car[oa]|Bom dia|Здравствуйте|Привет|Уважаем\w+)[, ][ \xa0]{0,3})([A-ZÀ-ÞŠŽŁА-Я][^\W\d_][\w’'-]*)", re.M
)
_NOT_NAMES = {"sir", "madam", "sirs", "customer", "customers", "list", "support", "damen", "herren", "kunden", "kollegen", "there", "again", "all", "readers", "team", "everyone", "friends", "colleagues", "alle", "zusammen", "tous", "todos", "všem"}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    norm: str


def _view(text: str) -> str:
    """The text with line ends and marks of quotes widened to spaces, at equal length."""
    return _WRAP.sub(lambda m: " " * len(m[0]), text)


def find(text: str | None, names: frozenset[str]) -> list[Entity]:
    """Entities in order of their place, without overlaps. Null and empty texts have none."""
    if not text:
        return []
    view = _view(text)
    out: list[Entity] = []
    taken = bytearray(len(view))

    def add(a: int, b: int, kind: str, norm: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append(Entity(a, b, kind, norm))

    mails = EMAIL.finditer(view) if "@" in view else ()
    for pattern in (mails, DISGUISED.finditer(view) if _DISGUISE.search(view) else ()):
        for m in pattern:
            s = m[0]
            if "@" not in s and _PLAIN_AT.match(s) and not re.search(r"[\d_]|\w\.\w", s.split()[0]):
                continue  # two words around "at" before a dotted word
            if "@" not in s and not re.search(r"\.|dot|DOT", s[s.lower().rfind("at") :]):
                continue
            bare = re.sub(r"\s+", "", re.sub(_DOT, ".", re.sub(_AT, "@", s, count=1)))
            add(m.start(), m.end(), "email", bare.lower())
    if any(map(str.isdigit, view)):
        for m in PHONE.finditer(view):
            if not any(taken[m.start() : m.end()]):
                add(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0]))
        for m in IDNUM.finditer(view):
            before = view[max(0, m.start() - 60) : m.start()]
            if _OTHER.search(before) and not _PERSONAL.search(before[-24:]):
                continue
            # bare runs of digits need a word that makes them a person's
            if m[0].isdigit() and not _PERSONAL.search(before + view[m.end() : m.end() + 30]):
                continue
            add(m.start(), m.end(), "idnum", re.sub(r"[\s.-]", "", m[0]).lower())
        for m in (*_HOUSE_FIRST.finditer(view), *_ROAD_FIRST.finditer(view)):
            add(m.start(), m.end(), "street", re.sub(r"[\s,]+", " ", m[0]).lower())
    spans: list[tuple[int, int]] = []
    for m in WORD.finditer(view):
        w = m[0]
        if w[0].isupper() and (w.lower() in names or w[-2:] in ("'s", "’s") and w[:-2].lower() in names):
            spans.append((m.start(), m.end() - 2 * (w.lower() not in names)))
    for m in _BEFORE.finditer(text):
        if m[1].lower() not in _NOT_NAMES:
            spans.append(m.span(1))
    spans.sort()
    k = 0
    while k < len(spans):
        a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] >= b and re.fullmatch(r"(?:,?[ \xa0]{1,8}|-)(?:[A-Z]\.[ \xa0]{1,4})?", view[b : spans[k + 1][0]]):
            raw = text[b : spans[k + 1][0]]
            if "\n" in raw and (raw.count("\n") > 1 or not text[text.rfind("\n", 0, a) + 1 : a].strip(" \t>|")):
                break  # a name alone on its line ends there
            # "SURNAME, Given" is one name; others with a comma between are a list
            if "," in raw and not text[a:b].isupper():
                break
            k += 1
            b = max(b, spans[k][1])
        if (first := re.search(r"(?<!\w)[A-ZÀ-ÞŠŽ]\.[ \xa0]{1,4}$", view[max(0, a - 6) : a])) and len(view[a:b]) > 1:
            # the letter may end a number
            a -= 0 if any(taken[a - len(first[0]) : a]) else len(first[0])
        parts = sorted(x.lower() for x in WORD.findall(view[a:b]))
        add(a, b, "person", " ".join(parts))
        k += 1
    return sorted(out, key=lambda e: e.start)


# ---- replacements

_SYLLABLES = {"latin": ("ba be di do fa ga ka la le lo ma mi na ne no pa ra re ri ro sa se ta te ti va ve zo".split(), "n r l s".split()), "cyrillic": ("ба ве ди до га ка ла ле ма ми на но па ра ре ро са та ти ва зо".split(), "н р л с".split())}
_ROAD_KINDS = {"Street", "Road", "Lane", "Close", "Court", "Avenue", "Rise", "Row", "Terrace", "Flat", "Calle", "Avenida", "Rua", "Plaza"}
# syllables of surrogates that no table keeps apart: even 21 ** 15 is more than 2 ** 65
LONG = 16


def _digest(key: bytes, kind: str, norm: str, turn: int) -> bytes:
    return hmac.new(key, f"{kind}\0{norm}\0{turn}".encode(), hashlib.sha256).digest()


def placeholder(e: Entity, key: bytes) -> str:
    return f"[{e.kind.upper()}_{_digest(key, e.kind, e.norm, 0)[:12].hex()}]"


def permuted(digits: str, key: bytes, tweak: str) -> str:
    """Another string of as many digits: a keyed permutation (Feistel rounds on both halves), so different ones stay different."""
    if len(digits) < 2:
        shift = _digest(key, "digit", tweak, 0)[0]
        return str((int(digits) + shift) % 10) if digits else ""
    half = len(digits) // 2
    a, b = digits[:half], digits[half:]
    for turn in range(10):
        c = (int(a) + int.from_bytes(_digest(key, "digits", f"{tweak}\0{len(digits)}\0{b}", turn)[:16], "big")) % 10 ** len(a)
        a, b = b, str(c).zfill(len(a))
    return a + b


def _new_digits(norm: str, key: bytes) -> str:
    """The digits that stand for a number's own, by its normalised form alone: one number is the same in all ways of writing, and as many
    digits and the same letters come out. Long numbers keep two digits of their prefix."""
    digits, letters = re.sub(r"\D", "", norm), re.sub(r"\d", "0", norm)
    kept = 2 if norm == digits and len(digits) >= 10 else 0
    return digits[:kept] + permuted(digits[kept:], key, letters + digits[:kept])


def _refill(shape: str, digits: str) -> str:
    """The shape with other digits; other characters stay."""
    new = iter(digits)
    return re.sub(r"\d", lambda m: next(new), shape)


def _syllabic(raw: bytes, cyrillic: bool, count: int, feminine: bool) -> str:
    syllables, ends = _SYLLABLES["cyrillic" if cyrillic else "latin"]
    n = int.from_bytes(raw, "big")
    parts = []
    for _ in range(count):
        n, r = divmod(n, len(syllables))
        parts.append(syllables[r])
    return "".join(parts)[:-1] + ("а" if cyrillic else "a") if feminine else "".join(parts) + ends[n % len(ends)]


def _made_name(word: str, key: bytes, turn: int, count: int) -> str:
    """A lower-case name of so many syllables in the word's script, with the usual ending of its gender."""
    # names in -a, -e, -ne or -ie are mostly women's, others get a closing consonant
    return _syllabic(_digest(key, "name", word, turn), bool(re.search("[а-яё]", word)), count, word[-1:] in "aeéаяё")


@lru_cache(maxsize=2)
def made_names(names: frozenset[str], key: bytes) -> dict[str, str]:
    """The vocabulary's surrogates, all different and none a name of it. A word whose surrogate is taken draws again, longer after some draws."""
    out: dict[str, str] = {}
    taken = set(names)
    for word in sorted(names):
        turn = 0
        while (made := _made_name(word, key, turn, min(3 + turn // 8, LONG - 1))) in taken:
            turn += 1
        taken.add(made)
        out[word] = made
    return out


def _name_like(word: str, made: dict[str, str], key: bytes) -> str:
    """The surrogate of a word in its letter case. Words outside the vocabulary get long ones, which no word of it has."""
    new = made.get(word.lower()) or _made_name(word.lower(), key, 0, LONG)
    return new.upper() if word.isupper() and len(word) > 1 else new.capitalize()


def _new_street(source: str, view: str, norm: str, key: bytes) -> str:
    """The address with other digits and roads of two made-up words; the word for the kind of road stays where there is another."""
    raw = _digest(key, "street", norm, 0)
    caps = list(re.finditer(_CAP, view))
    own = [m for m in caps if m[0] not in _ROAD_KINDS] or caps
    cyrillic = bool(re.search("[А-Яа-яЁё]", view))
    roads = [_syllabic(raw[k : k + 16], cyrillic, LONG // 2, False).capitalize() for k in (0, 16)]
    out, at = [], 0
    for k, m in enumerate(own):
        out += [source[at : m.start()], " ".join(roads) if len(own) == 1 else roads[k % 2]]
        at = m.end()
    digits = re.sub(r"\D", "", source)
    return _refill("".join(out) + source[at:], permuted(digits, key, norm))


def surrogate(e: Entity, source: str, view: str, made: dict[str, str], key: bytes) -> str:
    """source: the entity as written; view: the same without line ends and marks of quotes."""
    if e.kind == "email":
        return f"u{_digest(key, e.kind, e.norm, 0)[:16].hex()}@mail.example"
    if e.kind in ("phone", "idnum"):
        return _refill(source, _new_digits(e.norm, key))
    if e.kind == "street":
        return _new_street(source, view, e.norm, key)
    out, at = [], 0
    for m in WORD.finditer(view):
        if len(m[0]) > 1:
            out += [source[at : m.start()], _name_like(m[0], made, key)]
            at = m.end()
    return "".join(out) + source[at:]


class Repaired:
    """A text with wrongly decoded words repaired, and the places of the original its spans stand for."""

    def __init__(self, text: str):
        swap = {} if text.isascii() else repaired_words(text)[1]
        self.blocks, out, at, shift = [], [], 0, 0
        for m in BEYOND.finditer(text) if swap else ():
            old, new = m[0], swap.get(m[0], m[0])
            if new == old:
                continue
            # letters within a word keep their places; very long words change as one
            codes = SequenceMatcher(None, old, new, False).get_opcodes() if len(old) <= 200 else [("replace", 0, len(old), 0, len(new))]
            a = m.start()
            self.blocks += [(a + shift + j, a + shift + l, a + i, a + k) for tag, i, k, j, l in codes if tag != "equal"]
            out += [text[at:a], new]
            at, shift = m.end(), shift + len(new) - len(old)
        self.text = "".join(out) + text[at:]
        self._starts = [b[0] for b in self.blocks]

    def place(self, p: int, end: bool = False) -> int:
        """The original's place of a span's start or end; within a changed block, the block's."""
        k = bisect_right(self._starts, p) - 1
        if k < 0:
            return p
        a, b, old_a, old_b = self.blocks[k]
        if p == a and (end or b > a):
            return old_a
        return old_b + p - b if p >= b else old_b if end else old_a


def replaced(text: str | None, names: frozenset[str], key: bytes, surrogates: bool = False, made: dict[str, str] | None = None) -> tuple[str | None, list[str]]:
    """(the text with every entity replaced and all else unchanged, the kinds replaced); entities are looked for in the repaired text. What
    replaces an entity depends on it, the key and the vocabulary alone, never on the text. made: surrogates of the vocabulary, if at hand."""
    if not text:
        return text, []
    repaired = Repaired(text)
    entities = find(repaired.text, names)
    if not entities:
        return text, []
    if surrogates:
        made, view = made_names(names, key) if made is None else made, _view(repaired.text)
    out, at, kinds = [], 0, set()
    for e in entities:
        source = repaired.text[e.start : e.end]
        new = surrogate(e, source, view[e.start : e.end], made, key) if surrogates else placeholder(e, key)
        # a keyed permutation may lead a number to itself, which still counts as replaced
        kinds.add(e.kind)
        out += [text[at : max(at, repaired.place(e.start))], new]
        at = max(at, repaired.place(e.end, end=True))
    return "".join(out) + text[at:], sorted(kinds)


def replace(text: str | None, names: frozenset[str], key: bytes, surrogates: bool = False, made: dict[str, str] | None = None) -> str | None:
    return replaced(text, names, key, surrogates, made)[0]


# ---- tables

def known_names(addresses: DataFrame, least: int = 2) -> frozenset[str]:
    """Lower-case words of display names that at least so many addresses carry; organisations in brackets don't count.

    The vocabulary is checked before it is sent to the tasks. Words of less than three letters are left out.
    """
    bare = F.regexp_replace(F.regexp_replace("addr_name", r"[(\[].*?[)\]]|<[^>]*>|\S+@\S+", " "), r"[,\"]", " ")
    names = addresses.where("addr_name is not null").select(F.lower("addr").alias("addr"), bare.alias("n")).distinct()
    # real names have at most three words; longer ones are lists and groups
    words = names.select(F.explode(F.filter(F.split(F.trim("n"), r"\s+"), lambda x: x.rlike(r"^[\p{L}’'-]{3,}$"))).alias("w"), F.size(F.split(F.trim("n"), r"\s+")).alias("k")).where("k <= 3")
    counts = words.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = counts.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} different names; raise least")
    return frozenset(r[0] for r in rows)


def text_fields(messages: DataFrame) -> DataFrame:
    body = messages.select("read_ord", F.lit("body_text").alias("field_name"), F.col("body_text").alias("text"))
    subject = messages.select("read_ord", F.lit("subject").alias("field_name"), F.col("subject").alias("text"))
    return body.unionByName(subject).where("text is not null and text <> ''")


def replaced_fields(messages: DataFrame, addresses: DataFrame, key: str, surrogates: bool) -> DataFrame:
    """(read_ord, field_name, text, kinds) of the fields with text: all entities replaced, and the kinds of entities that were."""
    if len(key) < 8:
        raise ValueError("a key of at least eight characters is needed; whoever knows it can tell who is meant")
    names, secret = known_names(addresses), key.encode()
    shared = messages.sparkSession.sparkContext.broadcast((names, made_names(names, secret) if surrogates else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, made = shared.value
        for batch in batches:
            done = [replaced(x, known, secret, surrogates, made) for x in batch["text"]]
            yield pd.DataFrame({"read_ord": batch["read_ord"], "field_name": batch["field_name"], "text": [t for t, _ in done], "kinds": [k for _, k in done]})

    return text_fields(messages).mapInPandas(run, "read_ord bigint, field_name string, text string, kinds array<string>")


def personal_data(messages: DataFrame, addresses: DataFrame, key: str) -> DataFrame:
    """(read_ord, field_name, pii_kind): one row for each kind of entity that a field had surrogates made for."""
    return replaced_fields(messages, addresses, key, surrogates=True).select("read_ord", "field_name", F.explode("kinds").alias("pii_kind"))


def masked(messages: DataFrame, addresses: DataFrame, key: str, surrogates: bool = False) -> DataFrame:
    """(read_ord, field_name, text) with all entities replaced. The key decides the replacements; keep it secret."""
    return replaced_fields(messages, addresses, key, surrogates).select("read_ord", "field_name", "text")


def left_after_masking(messages: DataFrame, addresses: DataFrame, key: str) -> DataFrame:
    """(read_ord, field_name, pii_kind): what a second search finds in the masked texts; empty if masking is complete."""
    rows = masked(messages, addresses, key)
    shared = messages.sparkSession.sparkContext.broadcast(known_names(addresses))

    @F.pandas_udf("array<string>")
    def again(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sorted({e.kind for e in find(Repaired(x).text, shared.value)}) for x in batch], dtype=object)

    return rows.select("read_ord", "field_name", F.explode(again("text")).alias("pii_kind"))
