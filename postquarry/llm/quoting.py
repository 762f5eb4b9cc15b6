"""E-mail bodies reduced to what their sender newly wrote.

Every line is labelled new, quoted, signature or disclaimer by a linear-chain model: hashed features of a line (prefix, punctuation,
shape, position, neighbours) give its scores, learned transitions join them, and Viterbi decoding picks the best sequence. Training
labels come from unmistakable marks in a bounded sample of bodies (sample_size bodies of lowest hash). Lines still labelled new are
compared with the message they answer, whose text gives away quotes without any mark.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postquarry.functions.identifiers import bare_id

NEW, QUOTE, SIGNATURE, DISCLAIMER = range(4)
KINDS = {QUOTE: "quote", SIGNATURE: "signature", DISCLAIMER: "disclaimer"}
BITS = 15

PREFIX = re.compile(r"^\s{0,3}(?:[>|]|[A-ZÀ-ÞŠŽŁ]{1,3}>)")
ATTRIBUTION = re.compile(
    r"(?:\b(?:wrote|writes|said|schrieb|schreibt|écrit|escribió|escreveu|escribio|a écrit)\b|пиш[её]т|написала?|\bsaid on\b).{0,80}:\s*$|^\s*\* .{3,60}\[\d{4}-\d\d-\d\d.{0,9}\]:\s*$", re.I
)
STRICT = re.compile(
    r"^\s*(?:[A-ZÀ-ÞŠŽŁ][\w’'.-]*(?: [A-ZÀ-ÞŠŽŁ]?[\w’'.-]*){0,3} wrote:|\S+@\S+ said on [\d-]+:|\* .{3,60}\[\d{4}-\d\d-\d\d.{0,9}\]:|(?:on|am|le|el|em|в) .*\d.*(?:wrote|schrieb|écrit|escribió|escreveu|писала?).*:)\s*$", re.I
)
INDENT = re.compile(r"^(?: {4}|\t) *\S")
RULE = re.compile(r"^\s*([-_=*~#])\1{1,}\s*$|^\s*-{2,}\s*$")
FORWARD = re.compile(
    r"^\s*-{3,}\s*[\w' .-]{3,40}\s*-{3,}\s*$|^\s*(?:begin forwarded message|anfang der weitergeleiteten|début du message|inicio del mensaje)\b.*:?\s*$", re.I
)
HEADER = re.compile(r"^\s*\*?(?:from|von|de|от|sent|gesendet|envoyé|envoye|enviado(?: el)?|subject|betreff|objet|asunto|assunto|to|an|à|para|cc|date|datum|fecha|дата|тема|кому)\*?\s?:\s", re.I)
FROM = re.compile(r"^\s*\*?(?:from|von|de|от)\*?\s?:\s", re.I)
# Closing phrases, device lines and words of legal notices in the languages of the mail.
CLOSING = re.compile(
    r"^\s*(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|thanks)|best|cheers|thanks|thank you|yours(?: \w+)?|sincerely|viele grüße|danke und gruß|mit freundlichen grüßen|herzliche grüße|"
    r"liebe grüße|beste grüße|gruß|grüße|cordialement|bien à (?:toi|vous)|amicalement|merci|à bientôt|bises|salutations|saludos|un abrazo|abrazos|un saludo|atentamente|gracias|abraços|um abraço|"
    r"obrigad[oa]|atenciosamente|cumprimentos|с уважением|всего доброго|спасибо|с приветом|до связи|удачи)\s*[,.!–-]?\s*$", re.I
)
DEVICE = re.compile(
    r"^\s*(?:sent (?:from|via|with) |gesendet (?:von|mit) |von (?:unterwegs|meinem) |envoyé (?:depuis|de) |enviado (?:desde|do|da|de|pelo) |отправлено (?:с|из)\b|mobile mail\b|get outlook)", re.I
)
LEGAL = [
    "confidential", "privileged", "addressee", "intended for the named", "named recipient", "in error", "not permitted", "no contract", "liability", "attachments for virus", "registered office",
    "unless stated otherwise", "opinions in this mail", "vertraulich", "genannten empfänger", "rechtlich geschützt", "unbefugte", "weitergabe", "löschen sie", "haftung", "confidentiel", "réservé à son",
    "sans accord", "par erreur", "l'intégrité du message", "décline toute", "détruire", "confidencial", "exclusivamente", "se dirige solo", "por error", "prohibida", "no responde", "bórrelo",
    "destinatario", "destinatário", "por engano", "proibida", "não responde", "конфиденциальн", "адресат", "разглашени",
]
NOTICE = re.compile(r"^\s*(?:\*+\s*)?(?:notice|disclaimer|confidentiality|hinweis|avis|aviso|внимание)\b\s*:?", re.I)
PHONE = re.compile(r"(?:\+|\(|\b0|\b\d)[\d ().\-/]{6,}\d|\b(?:tel|tél|phone|fax|mob|mobile|cell|t|тел)\.?:?\s*\+?[\d(]", re.I)
MAIL = re.compile(r"[\w.+-]+@[\w-]+\.\w+")
_NAME = r"(?:[A-ZÀ-ÞŠŽŁА-Я]|[^\x00-\x7f])[^\s,;:!?|@<>()\[\]0-9/]*"  # a wrongly decoded name is still one
NAME_LINE = re.compile(rf"^\s*(?:(?:Dr|Prof|Mr|Mrs|Ms)\. )?{_NAME}(?:[ ,]+(?:{_NAME}|[A-Z]\.|de|von|van|da|di)){{0,3}}\s*$")
POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?s\.?|n\.?b\.?|ps)\b\s*[:.)–-]", re.I)
WORD = re.compile(r"[^\W\d_]+")
MARKUP = [
    (re.compile(r"(?is)<(script|style|head|title)\b.*?</\1\s*>|<!--.*?-->"), " "),
    (re.compile(r"(?i)\s*<br\s*/?>\s*"), "\n"),
    (re.compile(r"(?i)</?(?:p|div|tr|li|h[1-6]|table|ul|ol|pre|body|html|hr)\b[^>]*>"), "\n"),
]
_BLOCK = re.compile(r"(?is)<(/?)(blockquote|div)\b([^>]*)>|<hr\b[^>]*>")
_EARLIER = re.compile(r"""(?i)\bclass\s*=\s*["']?[^"'>]*(?:quote|earlier|reply|forward|cite|original)""")
_SIGNED = re.compile(r"""(?i)\bclass\s*=\s*["']?[^"'>]*\bsig""")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in LEGAL:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


def legal_count(text: str) -> int:
    """Phrases of legal notices in the text; of nested ones the longest counts."""
    last = -1
    n = 0
    for end, size in _automaton().iter(text.lower()):
        if end - size + 1 > last:
            n += 1
        last = end
    return n


def html_lines(source: str) -> str:
    """Text of HTML with a line for each block, > before what a quoting block holds (blockquote, a class that says so, what follows a
    rule at once), and a delimiter before a block classed as signature."""
    pattern, by = MARKUP[0]
    source = pattern.sub(by, source)
    out: list[str] = []
    stack: list[tuple[str, bool]] = []
    at, ruled = 0, False
    for m in [*_BLOCK.finditer(source), None]:
        piece = source[at : m.start()] if m else source[at:]
        piece = re.sub(r"[\r\n]+", " ", piece)
        for pattern, by in MARKUP[1:]:
            piece = pattern.sub(by, piece)
        piece = html.unescape(re.sub(r"<[^<>]*>", "", piece)).replace("\xa0", " ")
        depth = sum(q for _, q in stack)
        out += ["> " * depth + bare if (bare := line.strip()) else "" for line in piece.split("\n")]
        if m is None:
            break
        at, tag = m.end(), (m[2] or "hr").lower()
        ruled = ruled and not piece.strip()
        if tag == "hr":
            ruled = True
        elif m[1]:
            while stack and stack.pop()[0] != tag:
                pass
            out.append("")
        else:
            stack.append((tag, tag == "blockquote" or bool(_EARLIER.search(m[3])) or ruled))
            ruled = False
            out += ["", "-- "] if _SIGNED.search(m[3]) and not source[at:].lstrip().startswith("--") else [""]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """(first, behind last) of every run of lines that aren't blank."""
    out, start = [], None
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def _short(lines: list[str]) -> bool:
    return len(lines) <= 7 and all(len(x) < 75 for x in lines)


def _card(lines: list[str]) -> bool:
    """Whether a short block names somebody with rank, group, number, address or mail."""
    if not 1 <= len(lines) <= 7 or any(len(x) > 75 for x in lines):
        return False
    if len(lines) == 1:
        parts = re.split(r"\s[|•/]\s", lines[0])
        return len(parts) >= 3 and bool(NAME_LINE.match(parts[0]))
    if not NAME_LINE.match(lines[0]) or lines[0].rstrip().endswith(","):
        return False
    rest = lines[1:]
    if any(x.rstrip().endswith((".", "?", "!", ":")) and len(x.split()) > 5 for x in rest):
        return False
    return any(PHONE.search(x) or MAIL.search(x) for x in rest) or all(x.strip()[:1].isupper() or x.strip()[:1].isdigit() for x in rest) and len(" ".join(rest).split()) >= 2


def _legal(block: list[str]) -> bool:
    text = " ".join(block)
    n = legal_count(text)
    return n >= 2 or n == 1 and bool(NOTICE.match(block[0]) or text.isupper())


def seed_labels(lines: list[str]) -> list[int]:
    """Labels from marks alone; the model's training labels."""
    labels = [NEW] * len(lines)
    signed = cut = False
    flush = any(x.strip() and not INDENT.match(x) for x in lines)
    for a, b in paragraphs(lines):
        block = lines[a:b]
        if cut == QUOTE:
            # what follows a forwarded text without its marks is the forwarder's own
            own, ruled = not PREFIX.match(block[0]), bool(RULE.match(block[0])) and b - a > 1 and not HEADER.match(block[1])
            rest = block[1:] if ruled else block
            kind = DISCLAIMER if _legal(rest) else SIGNATURE if _card(rest) or ruled and _short(rest) else QUOTE
            labels[a:b] = [kind if own else QUOTE] * (b - a)
            continue
        if flush and all(INDENT.match(x) for x in block):
            labels[a:b] = [QUOTE] * (b - a)
            continue
        i = a
        while i < b:
            line = lines[i]
            follow = lines[i + 1] if i + 1 < b else ""
            later = next((x for x in lines[i + 1 : i + 4] if x.strip()), "")
            if PREFIX.match(line) and not (re.match(r"\s*> [a-z] in the ", line) and not signed and i > a):
                labels[i] = QUOTE
            elif (FORWARD.match(line) or re.match(r"^\s*_{20,}\s*$", line)) and HEADER.match(later) or FROM.match(line) and HEADER.match(follow):
                labels[i:b] = [QUOTE] * (b - i)
                cut = QUOTE
                break
            elif ATTRIBUTION.search(line) and (PREFIX.match(later) or INDENT.match(later)):
                labels[i] = QUOTE
            elif i == a and STRICT.match(line):
                labels[i:b] = [QUOTE] * (b - i)
                break
            elif DEVICE.match(line) and len(line) < 70:
                labels[i], signed = SIGNATURE, True
            elif RULE.match(line) and follow.strip():
                rest = lines[i + 1 : b]
                legal = legal_count(" ".join(rest)) >= 1 and len(" ".join(rest).split()) > 6
                labels[i:b] = [DISCLAIMER if legal and not _card(rest) else SIGNATURE] * (b - i)
                signed = True
                break
            elif CLOSING.match(line) and (i + 1 >= b or NAME_LINE.match(follow)) and len(block) <= 40:
                signed = True
                i += 2
                continue
            i += 1
        if any(labels[a:b]):
            continue
        if _legal(block):
            labels[a:b], signed = [DISCLAIMER] * (b - a), True
        elif _card(block) and a > 0:
            labels[a:b], signed = [SIGNATURE] * (b - a), True
        elif signed and not CLOSING.match(block[0]) and not POSTSCRIPT.match(block[0]) and len(" ".join(block).split()) > 3:
            labels[a:b] = [QUOTE] * (b - a)
    return labels


@lru_cache(maxsize=400_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _look(line: str) -> str:
    bare = line.strip()
    if not bare:
        return "blank"
    if PREFIX.match(line):
        return "prefix"
    if INDENT.match(line):
        return "indent"
    first, last, size = bare[0], bare[-1], len(line)
    if first in "-_=*~#":
        if FORWARD.match(line):
            return "forward"
        if RULE.match(line):
            return "rule" + first + str(min(4, len(bare) // 8))
    elif last == ":" and FORWARD.match(line):
        return "forward"
    if ":" in line[:16] and size < 120 and HEADER.match(line):
        return "header"
    if last == ":":
        if STRICT.match(line):
            return "strict"
        if ATTRIBUTION.search(line):
            return "attribution"
    if size < 70:
        if DEVICE.match(line):
            return "device"
        if size < 45:
            if CLOSING.match(line):
                return "closing"
            if NAME_LINE.match(line):
                return "name"
        if ("@" in line or any(map(str.isdigit, line))) and (PHONE.search(line) or MAIL.search(line)):
            return "contact"
        if last not in ".?!:" and len(line.split()) <= 6:
            return "short"
    return "text"


# kinds of lines that delimit passages
MARKS = {"prefix", "indent", "forward", "strict", "attribution", "device"}


def units(lines: list[str], hide: bool = False) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Runs of lines of one kind within a paragraph, and the features of each. A run gets one label. With hide the features don't show the
    delimiters that seed labels are read from: those lines look like text."""
    looks = [_look(x) for x in lines]
    plain = (lambda look: "text" if look.rstrip("/") in MARKS or look.startswith("rule") else look) if hide else (lambda look: look)
    blocks = paragraphs(lines)
    flush = any(k not in ("blank", "indent") for k in looks)
    spans, out = [], []
    cut, signed, after, n = False, False, 0, len(lines)
    behind = 0
    for k, (a, b) in enumerate(blocks):
        if a > behind:
            spans.append((behind, a))
            out.append([_slot("blank"), _slot(f"bc{cut}")])
        behind = b
        block = lines[a:b]
        text = " ".join(block)
        legal = min(4, legal_count(text)) if b - a > 1 or len(text) > 20 else 0
        card = _card(block) or looks[a].startswith("rule") and b - a > 1 and _card(block[1:])
        upper, first, size = text.isupper(), plain(looks[a]), min(8, b - a)
        after += signed
        i = a
        while i < b:
            look, line = looks[i], lines[i]
            e = i + 1
            if look in ("text", "prefix", "indent", "short"):
                while e < b and looks[e] == look:
                    e += 1
            near = looks[e] if e < b else looks[blocks[k + 1][0]] if k + 1 < len(blocks) else "end"
            before = looks[i - 1] if i > a else "start" if not k else looks[blocks[k - 1][1] - 1] + "/"
            cut = cut or (look == "forward" or look.startswith("rule_") and len(line.strip()) > 18) and near == "header" or look == "header" and before != "header" and near == "header"
            at, last = i - a, lines[e - 1].rstrip()[-1:]
            kind = look
            if hide:
                look, near, before = plain(look), plain(near), plain(before)
            f = [
                "1", f"l:{look}", f"lb:{look}{before}", f"ln:{look}{near}", f"c:{cut}{look}", f"s:{signed}{min(after, 3)}{look}", f"g:{legal}{upper}{look}", f"gs:{legal}{card}{signed}", f"k:{card}{look}",
                f"kb:{card}{size}{min(at, 3)}", f"p:{min(k, 3)}{look}", f"t:{i * 4 // n}", f"r:{'a' if line[:1].isalnum() else line.strip()[:1]}", f"e:{'a' if last.isalnum() else last}{look}",
                f"n:{min(9, len(line.split()))}{signed}{look}", f"sc:{signed}{cut}{card}{legal > 0}{look in ('text', 'short')}", f"u:{signed}{min(after, 3)}{size > 1}{legal > 1}{look}", f"x:{line.lstrip()[:12].lower()}",
                f"bf:{first}{card}{min(legal, 2)}{size}", f"bg:{first}{min(legal, 2)}{cut}{signed}{look}", f"bh:{first}{card}{min(legal, 2)}{cut}", f"bi:{first}{flush}{look}",
            ]
            if look not in ("prefix", "text", "indent"):
                f += [f"w:{w.lower()}" for w in WORD.findall(line)[:4]]
            spans.append((i, e))
            out.append([_slot(x) for x in f])
            if kind == "closing" and (near in ("name", "end") or e >= n) or kind == "device":
                signed = True
            i = e
        signed = signed or bool(card) or legal >= 2
    if behind < n:
        spans.append((behind, n))
        out.append([_slot("blank"), _slot(f"bc{cut}")])
    return spans, out


class Model:
    """Averaged structured perceptron: weights of features by label, and of transitions between labels."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros(((1 << BITS), 4)) if emission is None else emission
        self.transition = np.zeros((4, 4)) if transition is None else transition

    def decode(self, features: list[list[int]]) -> list[int]:
        if not features:
            return []
        e = self.emission
        flat = [x for f in features for x in f]
        starts = np.cumsum([0, *[len(f) for f in features[:-1]]])
        scores = np.add.reduceat(e[flat], starts, axis=0).tolist()
        t = self.transition.tolist()
        best, back = scores[0], []
        for s in scores[1:]:
            row, from_ = [], []
            for y in range(4):
                k = max(range(4), key=lambda x: best[x] + t[x][y])
                from_.append(k)
                row.append(best[k] + t[k][y] + s[y])
            best = row
            back.append(from_)
        y = max(range(4), key=best.__getitem__)
        path = [y]
        for from_ in reversed(back):
            y = from_[y]
            path.append(y)
        return path[::-1]

    @staticmethod
    def fit(examples: list[tuple[list[list[int]], list[int]]], epochs: int = 4, seed: int = 3) -> "Model":
        m, n = Model(), 0
        total_e, total_t = np.zeros_like(m.emission), np.zeros_like(m.transition)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                features, gold = examples[k]
                n += 1
                guess = m.decode(features)
                if guess == gold:
                    continue
                for i, (f, g, y) in enumerate(zip(features, gold, guess)):
                    if g != y:
                        m.emission[f, g] += 1
                        total_e[f, g] += n
                        m.emission[f, y] -= 1
                        total_e[f, y] -= n
                    if i and (gold[i - 1], g) != (guess[i - 1], y):
                        m.transition[gold[i - 1], g] += 1
                        total_t[gold[i - 1], g] += n
                        m.transition[guess[i - 1], y] -= 1
                        total_t[guess[i - 1], y] -= n
        return Model(m.emission - total_e / (n + 1), m.transition - total_t / (n + 1))


def train(bodies: list[str]) -> Model:
    examples = []
    for body in bodies:
        lines = lines_of(body)
        if any(x.strip() for x in lines):
            labels = seed_labels(lines)
            for i, line in enumerate(lines):
                # blank lines go with the line before, so that blocks hang together
                labels[i] = labels[i] if line.strip() else labels[i - 1] if i else NEW
            # every other body shows no delimiters, so that the model learns what passages look like without them
            spans, features = units(lines, hide=len(examples) % 2 == 1)
            examples.append((features, [labels[a] for a, _ in spans]))
    return Model.fit(examples)


def runs(text: str, width: int = 6) -> set[int]:
    """Hashes of all runs of words of the text, without prefixes and layout."""
    w = WORD.findall(re.sub(r"(?m)^(?:\s*(?:[>|]|[A-Z]{1,3}>) ?)+", "", text).lower())
    return {hash(tuple(w[i : i + width])) for i in range(len(w) - width + 1)}


@lru_cache(maxsize=64)
def _answered_runs(text: str) -> set[int]:
    """Runs of an answered text; answers to one message stand together after the join, so few are kept."""
    return runs(html_lines(text) if text.lstrip()[:1] == "<" else text)


def label(text: str, model: Model, answered: str | Sequence[str] | None = None) -> tuple[list[str], list[int]]:
    """Lines of a body and their labels. Paragraphs labelled new that mostly repeat a delivery of the answered message are quotes."""
    lines = lines_of(text)
    spans, features = units(lines)
    labels = [y for (a, b), y in zip(spans, model.decode(features)) for _ in range(a, b)]
    texts = [answered] if isinstance(answered, str) else [] if answered is None else answered
    if len(texts):
        for a, b in paragraphs(lines):
            if labels[a] == NEW and len((piece := " ".join(lines[a:b])).split()) >= 8:
                own = runs(piece)
                if own and any(len(own & _answered_runs(x)) >= 0.6 * len(own) for x in texts if x):
                    labels[a:b] = [QUOTE] * (b - a)
    return lines, labels


def newly_written(lines: list[str], labels: list[int]) -> str:
    kept = [x for x, y in zip(lines, labels) if y == NEW]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n")


def with_answered(messages: DataFrame) -> DataFrame:
    """(read_ord, body_text, body_html, answered): answered has the different texts of the deliveries of the message a row answers, in
    order; null where there is none. Identifiers nobody answers, which unrelated mail may share, meet no join."""
    refs = F.col("refs")
    last = F.get(refs, F.size(refs) - 1)
    parent = F.coalesce(bare_id(F.col("in_reply_to")), bare_id(last))
    rows = messages.where("body_text is not null or body_html is not null")
    rows = rows.select("read_ord", "body_text", "body_html", parent.alias("_parent"))
    open_ = rows.where("_parent is not null")
    wanted = open_.select("_parent").distinct()
    text = F.coalesce(F.when(F.trim("body_text") != "", F.col("body_text")), F.col("body_html"))
    bodies = messages.select(bare_id(F.col("message_id")).alias("_parent"), text.alias("_text")).where("_parent is not null and _text is not null")
    bodies = bodies.join(wanted, "_parent", "left_semi").groupBy("_parent").agg(F.sort_array(F.collect_set("_text")).alias("answered"))
    kept = ["read_ord", "body_text", "body_html", "answered"]
    joined = open_.join(bodies, "_parent", "left").select(kept)
    return joined.unionByName(rows.where("_parent is null").select("read_ord", "body_text", "body_html", F.lit(None).cast("array<string>").alias("answered")))


def cut_bodies(messages: DataFrame, sample_size: int = 3000) -> DataFrame:
    """(read_ord, new_text, kinds): what the sender newly wrote, and the kinds of passages taken out of body_text or body_html.

    new_text is from body_text, from body_html where that is blank; rows without any body are left out, blank ones have empty
    new_text and no kinds.
    """
    body = F.coalesce(F.when(F.trim("body_text") != "", F.col("body_text")), F.col("body_html"))
    pool = messages.select(body.alias("b")).where("b is not null and trim(b) <> ''")
    # hashes spread evenly over the different bodies, so a bound on them keeps what each task sends near its part of the sample
    hashed = pool.select("b", F.shiftrightunsigned(F.xxhash64("b"), 1).alias("h"))
    n = hashed.agg(F.approx_count_distinct("h")).first()[0]
    bound = min((1 << 63) - 1, (1 << 63) * 2 * sample_size // max(n, 1))
    sample = [r[0] for r in hashed.where(F.col("h") <= bound).distinct().orderBy("h", "b").limit(sample_size).collect()]
    model = train([html_lines(b) if b.lstrip()[:1] == "<" else b for b in sample])
    emission, transition = model.emission.astype(np.float32), model.transition

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(emission, transition)
        for batch in batches:
            out = []
            for read_ord, text, markup, answered in zip(batch["read_ord"], batch["body_text"], batch["body_html"], batch["answered"]):
                new, kinds = None, set()
                for x in (text, html_lines(markup) if markup else None):
                    if x and x.strip():
                        lines, labels = label(x, m, answered)
                        kinds |= {KINDS[y] for y, line in zip(labels, lines) if y and line.strip()}
                        new = newly_written(lines, labels) if new is None else new
                out.append((read_ord, new or "", sorted(kinds)))
            yield pd.DataFrame(out, columns=["read_ord", "new_text", "kinds"])

    return with_answered(messages).mapInPandas(run, "read_ord bigint, new_text string, kinds array<string>")


def passages(messages: DataFrame, sample_size: int = 3000) -> DataFrame:
    """(read_ord, cut_kind): one row for each kind of passage a delivery has."""
    return cut_bodies(messages, sample_size).select("read_ord", F.explode("kinds").alias("cut_kind"))
