"""Documents that hold passages of held-out evaluation items.

Wu-Manber multi-pattern search over words: every run of five words of an item's own sentences is a pattern (a whole sentence where it is
shorter), blocks are two words, the shift table skips places where no pattern can end, the last block's bucket selects patterns and a
direct comparison confirms them. What it finds is then aligned sentence by sentence. Items are few (their number and size
are checked before they are sent to the tasks); documents are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, BLOCK = 5, 2
MOST_BYTES = 64 << 20  # of item text that may go to every task
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_MARKS = re.compile("[\u0300-\u036f]+")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+")


def words(text: str) -> list[str]:
    """Words of the text without case, accents, markup and layout."""
    text = _TAG.sub(" ", text).replace("\xad", "")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "ss"))
        text = _MARKS.sub("", text)
    return _WORD.findall(text.lower())


def sentences_of(text: str | None) -> tuple[tuple[str, ...], ...]:
    """Words of each sentence; one of a single word counts with the sentence after it, the last one with the one before."""
    out: list[tuple[str, ...]] = []
    carried: tuple[str, ...] = ()
    for piece in _END.split(text or ""):
        if w := carried + tuple(words(piece)):
            carried = w if len(w) == 1 else ()
            out += [w] if len(w) > 1 else []
    return (*out[:-1], out[-1] + carried) if out else (carried,) if carried else ()


class Table:
    """Shift table and buckets of runs of one length, by the run's words."""

    def __init__(self, width: int, runs: dict[tuple[str, ...], list[tuple[int, int]]]):
        self.width, self.skip = width, width - BLOCK + 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple, list[tuple[int, int]]]] = defaultdict(dict)
        for run, places in runs.items():
            for e in range(BLOCK, width + 1):
                block = run[e - BLOCK : e]
                self.shift[block] = min(self.shift.get(block, width), width - e)
            self.buckets[run[-BLOCK:]][run] = places

    def scan(self, text: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(place in the text, (sentence, place in it) of the run) of every run found."""
        shift, buckets, skip, back = self.shift, self.buckets, self.skip, self.width - 1
        at, n = back, len(text)
        while at < n:
            block = (text[at - 1], text[at])
            if step := shift.get(block, skip):
                at += step
                continue
            if held := buckets[block].get(tuple(text[at - back : at + 1])):
                yield at - back, held
            at += 1


class Patterns:
    """Tables of the items' sentences.

    Items of equal words are one, with all their identifiers. Sentences that items begin with are an instruction where shared_by different
    items or more begin so, unless an item has nothing else. Sentences of less than RUN words are patterns only where an item could be given away by them
    alone; else they are looked up in texts that hold a longer one.
    """

    def __init__(self, items: list[tuple[int, str]], shared_by: int = 3, share: float = 0.5):
        equal: dict[tuple, list[int]] = defaultdict(list)
        for i, t in items:
            equal[sentences_of(t)].append(i)
        begun: Counter[tuple] = Counter(s[:k] for s in equal for k in range(1, len(s) + 1))
        self.ids: list[list[int]] = []
        self.sentences: list[tuple[str, ...]] = []
        self.item_of: list[int] = []
        self.size: list[int] = []
        self.count: list[int] = []
        self.short: list[list[int]] = []
        runs: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for s, ids in equal.items():
            k = next((k for k in range(len(s)) if begun[s[: k + 1]] < shared_by), 0)
            own = s[k:]
            if (size := sum(map(len, own))) < RUN:
                continue
            item = len(self.ids)
            self.ids.append(ids)
            self.size.append(size)
            self.count.append(len(own))
            alone = sum(len(x) for x in own if len(x) < RUN) >= share * size
            self.short.append([] if alone else [len(self.sentences) + j for j, x in enumerate(own) if len(x) < RUN])
            for x in own:
                width = min(RUN, len(x))
                if width == RUN or alone:
                    for at in range(len(x) - width + 1):
                        runs[width][x[at : at + width]].append((len(self.sentences), at))
                self.sentences.append(x)
                self.item_of.append(item)
        self.places_of: list[dict[str, int]] = []
        for s in self.sentences:
            places: dict[str, int] = {}
            for j, x in enumerate(s):
                places[x] = places.get(x, 0) | 1 << j
            self.places_of.append(places)
        self.kinds = [frozenset(s) for s in self.sentences]
        self.most = [self.allowed(s) for s in self.sentences]
        self.tables = [Table(width, found) for width, found in sorted(runs.items(), reverse=True)]

    def occurrences(self, text: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Sentence number -> (place in it, place in the text) of every run found.

        A sentence of which more words are missing anywhere in the text than may differ is left out at once.
        """
        found: dict[int, list[tuple[int, int]] | None] = {}
        kinds, most, held = self.kinds, self.most, set(text)
        for table in self.tables:
            for at, runs in table.scan(text):
                for k, a in runs:
                    if k not in found:
                        found[k] = None if len(kinds[k] - held) > most[k] else []
                    if (places := found[k]) is not None:
                        places.append((a, at))
        return {k: places for k, places in found.items() if places is not None}

    def taken(self, k: int, places: list[tuple[int, int]], text: list[str]) -> int:
        """Words of sentence k that the text has in order, near the best supported place; 0 if too many differ."""
        s = self.sentences[k]
        covered = {a + j for a, _ in places for j in range(min(RUN, len(s)))}
        if len(covered) == len(s) and len({p - a for a, p in places}) == 1:
            return len(s)
        best, places_of, full = 0, self.places_of[k], (1 << len(s)) - 1
        for start in {p - a for a, p in places}:
            # longest common subsequence, a bit for each word of the sentence
            row = full
            for y in text[max(0, start - 3) : start + len(s) + 3]:
                if at := row & places_of.get(y, 0):
                    row = (row + at) | (row - at)
            best = max(best, len(s) - (row & full).bit_count())
            if best == len(s):
                break
        return best if len(s) - best <= self.allowed(s) else 0

    @staticmethod
    def allowed(sentence: Sequence[str], changes: float = 0.17) -> int:
        """How many words of a sentence may differ; none of a short one."""
        return max(1, round(changes * len(sentence))) if len(sentence) >= RUN else 0

    def leaked(self, text: str, share: float = 0.5, least_sentences: int = 2) -> list[tuple[int, int, float]]:
        """(item, sentences, share of its words) of items of which the text holds enough."""
        w = words(text)
        by_item: dict[int, dict[int, list]] = {}
        for k, places in self.occurrences(w).items():
            by_item.setdefault(self.item_of[k], {})[k] = places
        out = []
        for i, hits in by_item.items():
            need = min(least_sentences, self.count[i])
            # no alignment can reach the share if even the touched sentences are too short or too few
            short = self.short[i]
            if len(hits) + len(short) < need or sum(len(self.sentences[k]) for k in [*hits, *short]) < share * self.size[i]:
                continue
            got = [n for k, places in hits.items() if (n := self.taken(k, places, w))]
            got += [len(self.sentences[k]) for k in short if self.holds(w, self.sentences[k])]
            if len(got) >= need and sum(got) >= share * self.size[i]:
                out += [(item, len(got), sum(got) / self.size[i]) for item in self.ids[i]]
        return out

    @staticmethod
    def holds(text: list[str], sentence: tuple[str, ...]) -> bool:
        n = len(sentence)
        return any(x == sentence[0] and tuple(text[at : at + n]) == sentence for at, x in enumerate(text))


_built: dict[str, Patterns] = {}


def built(digest: str, items: list[tuple[int, str]], share: float) -> Patterns:
    """The tables of the items, made once in each Python worker and kept for its later tasks."""
    if digest not in _built:
        _built.clear()
        _built[digest] = Patterns(items, share=share)
    return _built[digest]


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, least_sentences: int = 2) -> DataFrame:
    """(doc_id, item_id, sentences, share): documents that hold at least the share of an item's words in two or more sentences.

    Instructions that items share count neither as found nor as the item's words. An item of one sentence is found where that is held whole but
    for the words that may differ. Null and empty texts hold nothing; copies of a document are found each, and so are items of equal text. Items of less than
    RUN words besides their instruction are no passages.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of item text are more than {MOST_BYTES}; search in several runs")
    rows = sorted((r[0], r[1]) for r in items.where("text is not null and item_id is not null").select("item_id", "text").distinct().collect())
    digest = hashlib.sha256(repr((share, rows)).encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(rows)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = built(digest, shared.value, share)
        for batch in batches:
            found = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"]) for x in patterns.leaked(t, share, least_sentences)]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "sentences", "share"])

    texts = documents.select("doc_id", "text").where("text is not null and text <> ''")
    return texts.mapInPandas(search, "doc_id bigint, item_id bigint, sentences int, share double")
