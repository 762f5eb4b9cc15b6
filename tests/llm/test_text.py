"""Operators on texts: brute force, round trips and held-out accuracy on generated cases, with nulls, empties, ties and odd columns."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postquarry.llm import contamination, encoding, mixing, personal, quoting, truncation

WORDS = "harbour window paper garden silver market bridge letter winter number basket kitchen engine pocket shadow ticket village orange candle button yellow thunder mirror ladder".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# ---- encoding

CLEAN = ["Die größte Fähre überholt", "déjà vu à l'été", "añadido según el índice", "coração não é", "Сводный почтамт закрыл новый конверт", "“done” – I can’t wait…", "Łucja and Šimon", "plain ascii text", "£40 or €55"]


@pytest.mark.parametrize("text", CLEAN)
def test_ordinary_text_is_left_alone(text):
    assert encoding.repair(text) == (False, text, "")


CHAINS = [
    ("größte Fähre", "utf-8", "latin-1"), ("größte Fähre", "utf-8", "cp437"), ("déjà préféré", "utf-8", "mac-roman"), ("añadido común", "utf-8", "cp1250"), ("añadido común", "latin-1", "cp437"), ("über größere Fähren", "latin-1", "mac-roman"),
    ("Сводный почтамт закрыл", "utf-8", "cp1251"), ("Сводный почтамт закрыл", "koi8-r", "cp1251"), ("Сводный почтамт закрыл", "cp1251", "latin-1"), ("“done” and it’s fine", "cp1252", "latin-1"), ("“done” – fine", "utf-8", "cp1252"),
]


@pytest.mark.parametrize("text,true,wrong", CHAINS)
def test_wrong_decodings_are_undone(text, true, wrong):
    # what a code page leaves open comes through as control characters
    garbled = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true))
    found, restored, _ = encoding.repair(garbled)
    assert found and restored == text


def test_double_decoding_and_losses():
    twice = "größte".encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.repair(twice)[:2] == (True, "größte")
    assert encoding.repair("gr��e") == (True, "gr��e", "lose") and encoding.repair("We can?t wait")[0]
    assert encoding.repair(None) == (False, None, "") and encoding.repair("") == (False, "", "")
    assert encoding.repair("why? yes")[0] is False
    many = "größte"
    for _ in range(4):
        many = many.encode().decode("latin-1")
    assert encoding.repair(many)[:2] == (True, "größte")
    assert encoding.repair("la página.php?id=3 no está, ¿cómo se llama?") == (False, "la página.php?id=3 no está, ¿cómo se llama?", "")
    assert encoding.repair("¿dÃ³nde? aquÃ­")[:2] == (True, "¿dónde? aquí")
    assert encoding.repair("a\x96b Gr\x81e")[0] and encoding.repair("gr\ufffd\ufffde Ã¼ber")[1] == "gr\ufffd\ufffde über"
    mixed = "ganz normal schön, aber " + "schön".encode().decode("latin-1")
    assert encoding.repair(mixed)[1] == "ganz normal schön, aber schön"


def test_fields(spark):
    m = spark.createDataFrame([(1, "grÃ¶ÃŸe", None, "k"), (2, None, "plain", "k"), (3, "", "é" * 100_000, "k")], "read_ord bigint, subject string, body_text string, text string")
    a = spark.createDataFrame([(9, "Zoë".encode().decode("latin-1")), (8, None)], "address_id bigint, addr_name string")
    got = {(r["rec_key"], r["field_name"]): r["restored"] for r in encoding.restore_fields(m, a).collect()}
    assert got[(1, "subject")] == "größe" and got[(9, "addr_name")] == "Zoë" and (2, "body_text") not in got
    assert encoding.restore_fields(m.limit(0), a.limit(0)).count() == 0


# ---- quoting

BODY = """Dear Ana,

The window is open and the garden is wide, as we said.

Best,
Jo

-- 
Jo Martin
Clerk, Silver Works
Tel: 01632 960154

On Mon, 5 Jun 2000 at 10:00, Ana Berg <ana@x.example> wrote:
> The bridge is closed.
> Until when?

This message and any files sent with it are meant only for the addressee. If you received it in error, delete every copy.
"""


def variants(n=300, seed=1):
    """Bodies with known kinds of passages."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        new = "\n\n".join(" ".join(sentence(rng) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3)))
        parts, kinds = ([f"Hello {rng.choice(['Ana', 'Jo', 'Kim'])},"] if rng.random() < 0.6 else []) + [new], set()
        if rng.random() < 0.5:
            parts.append(rng.choice(["Best,\nJo", "Regards,\nAna", "Viele Grüße\nKim"]))
        if rng.random() < 0.5:
            kinds.add("signature")
            parts.append(rng.choice(["-- \nJo Martin\nClerk, Silver Works\nTel: 01632 960154", "Ana Berg | Editor | Paper Mill | +44 20 7946 0000", "Sent from my pocket phone", "~~~\nKim Lee\nPlanner\n4 Garden Row"]))
        if rng.random() < 0.4:
            kinds.add("disclaimer")
            parts.append(rng.choice(["This message is confidential and may be privileged. If you received it in error, delete it.", "====================\nNOTICE: the content is intended for the named recipient alone. Copying is not permitted."]))
        if rng.random() < 0.5:
            kinds.add("quote")
            old = [sentence(rng) for _ in range(3)]
            parts.append(rng.choice(["On Mon, 5 Jun 2000, Ana Berg <ana@x.example> wrote:\n> " + "\n> ".join(old), "-----Original Message-----\nFrom: Ana Berg\nSent: 05.06.2000 10:00\nSubject: x\n\n" + "\n".join(old), "Ana Berg wrote:\n| " + "\n| ".join(old)]))
        out.append(("\n\n".join(parts), kinds, new))
    return out


def test_labels_on_held_out_bodies():
    model = quoting.train([b for b, _, _ in variants(seed=1)])
    right, held = 0, variants(seed=2)
    for body, kinds, new in held:
        lines, labels = quoting.label(body, model)
        got = {quoting.KINDS[y] for y, x in zip(labels, lines) if y and x.strip()}
        right += got == kinds and new in quoting.newly_written(lines, labels)
    assert right >= 0.95 * len(held)


def test_unmarked_quotes_are_told_by_the_answered_message():
    model = quoting.train([b for b, _, _ in variants(seed=1)])
    rng = random.Random(5)
    old = " ".join(sentence(rng) for _ in range(4))
    lines, labels = quoting.label("Fine by me, the market opens soon.\n\n" + old, model, answered=old)
    assert quoting.newly_written(lines, labels) == "Fine by me, the market opens soon."


def test_marks_elsewhere_do_not_hide_an_unmarked_quote(spark):
    rng = random.Random(6)
    old, other = (" ".join(sentence(rng) for _ in range(4)) for _ in range(2))
    reply = "Fine by me, the market opens soon.\n\n"
    rows = [
        (1, "<a@x>", None, None, old, None), (2, "<A@x>", None, None, other, None), (3, "<a@x>", None, None, old, "<p>x</p>"), (4, "<b@x>", "<a@x>", None, reply + old, '<p>Fine</p><div class="earlier">x</div>'),
        (5, "<c@x>", None, ["<a@x>"], reply + other + "\n\n-----\nJo", None), (6, "<d@x>", "<gone@x>", None, reply, None),
    ]
    m = spark.createDataFrame(rows, "read_ord bigint, message_id string, in_reply_to string, refs array<string>, body_text string, body_html string")
    got = {r["read_ord"]: r for r in quoting.with_answered(m).collect()}
    assert len(got) == 6 and got[4]["answered"] == got[5]["answered"] == sorted([old, other]) and got[6]["answered"] is None
    model = quoting.train([b for b, _, _ in variants(seed=1)])
    for k, quoted in ((4, old), (5, other)):
        lines, labels = quoting.label(got[k]["body_text"], model, got[k]["answered"])
        assert labels[lines.index(quoted)] == quoting.QUOTE and labels[0] == quoting.NEW


def test_html_lines():
    assert quoting.html_lines("<html><body><p>a<br>b</p><blockquote>q<blockquote>r</blockquote></blockquote><style>x</style></body></html>") == "a\nb\n\n> q\n\n> > r"
    assert quoting.html_lines('<p>a</p><hr><div>q</div><p>b</p><div class="sig">N</div>') == "a\n\n> q\n\nb\n\n-- \nN"


def test_bodies(spark):
    rows = [(1, "<a@x>", None, None, BODY, None), (2, "<b@x>", "<a@x>", ["<a@x>"], None, "<p>fine</p><blockquote>old text</blockquote>"), (3, None, None, None, None, None), (4, "<c@x>", None, [], " ", ""), (5, "", "gone", [None], "x" * 50_000, None)]
    m = spark.createDataFrame(rows, "read_ord bigint, message_id string, in_reply_to string, refs array<string>, body_text string, body_html string")
    got = {r["read_ord"]: (r["new_text"], set(r["kinds"])) for r in quoting.cut_bodies(m.unionByName(m.where("read_ord = 1").selectExpr("read_ord + 10 as read_ord", "message_id", "in_reply_to", "refs", "body_text", "body_html"))).collect()}
    assert got[1][1] == {"quote", "signature", "disclaimer"} and got[1] == got[11] and got[4] == ("", set()) and 3 not in got
    assert got[2][1] == {"quote"}
    assert quoting.passages(m.limit(0)).count() == 0


# ---- personal data

KEY = "key of the tests"
NAMES = frozenset({"jutta", "berg", "zoë", "martin"})


@pytest.mark.parametrize("text,kinds", [
    ("Write to jo_b1@mail.example today", {"email"}), ("jo.b1 at mail dot example", {"email"}), ("jo(at)mail.example", {"email"}), ("Call +44 (0)1632 960 388 ext. 42", {"phone"}), ("Call (030) 23125 636", {"phone"}),
    ("020 7946\n> 0888 it is", {"phone"}), ("Passport ZZ2402487 expires", {"idnum"}), ("Form for 666-23-7132", {"idnum"}), ("Ticket 4493-566 and invoice 201009-76", set()), ("Part no. 35-3706-91, build 1.15.1842", set()),
    ("open 9:15-12:30 on 12.05.2010", set()), ("60 Saddler Terrace, Valmorin", {"street"}), ("129 bis, impasse Sévrier", {"street"}), ("Weberstraße 12", {"street"}), ("Avda. Peñalisa 106", {"street"}), ("Shelf 13, row 8", set()),
    ("Ask Dr. Unknown about it", {"person"}), ("Dear Quux,", {"person"}), ("thanks, Jutta", {"person"}), ("BERG, Zoë", {"person"}), ("in Berghausen", set()), ("", set()), (None, set()), ("two at most. ok", set()), ("Number QQ 62 29 92 D.\n\nJutta Berg", {"idnum", "person"}),
])
def test_kinds(text, kinds):
    assert {e.kind for e in personal.find(text, NAMES)} == kinds


def test_replacements_keep_the_rest_and_who_is_who():
    text = "Hi Jutta, Jutta Berg (jo@mail.example) met Zoë and BERG, Jutta at 60 Saddler Terrace.\nCall 020 7946 0888!"
    for surrogates in (False, True):
        out = personal.replace(text, NAMES, b"key", surrogates)
        assert out == personal.replace(text, NAMES, b"key", surrogates) != personal.replace(text, NAMES, b"other", surrogates)
        spans = personal.find(text, NAMES)
        gaps = [text[a.end : b.start] for a, b in zip(spans, spans[1:])]
        at = 0
        for gap in gaps:
            at = out.index(gap, at)
        assert not any(x in out for x in ("Jutta", "Zoë", "jo@mail", "Saddler", "0888"))
    masked = personal.replace(text, NAMES, b"key")
    codes = [w for w in __import__("re").findall(r"\[PERSON_\w+\]", masked)]
    assert codes[1] == codes[3] and len(set(codes)) == 3
    made = personal.replace("Jutta and JUTTA and Zoë", NAMES, b"key", True).split(" and ")
    assert made[0].upper() == made[1] and made[1].isupper() and made[0] != made[2]


def test_surrogates_are_one_for_one_in_all_texts():
    rng = random.Random(8)
    names = frozenset("".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(4)) + rng.choice("ae") for _ in range(30_000))
    made = personal.made_names(names, b"k")
    assert len(set(made.values())) == len(made) == len(names) and not names & set(made.values())
    # more women's names than three syllables give; each is the same beside any other
    two = sorted(names)[:400]
    alone = {w: personal.replace(w.capitalize(), names, b"k", True, made) for w in two}
    assert len({*alone.values()}) == 400
    assert all(personal.replace(f"{a.capitalize()}; {b.capitalize()}", names, b"k", True, made) == f"{alone[a]}; {alone[b]}" for a, b in zip(two, two[1:]))
    streets = [f"{n} {w} Lane" for n in range(1, 10) for w in ("Saddler", "Miller", "Old Weaver", "Baker", "Cooper") ] + [f"{n} Court Lane" for n in range(1, 10)]
    assert len({personal.replace(x, frozenset(), b"k", True) for x in streets}) == len(streets)
    phones = [f"020 7946 {n:04}" for n in range(3000)]
    out = [personal.replace(x, frozenset(), b"k", True) for x in phones]
    assert len(set(out)) == 3000 and all(x[:2] == "02" and x[3] == x[8] == " " and x not in phones[i : i + 1] for i, x in enumerate(out))
    assert len({personal.permuted(f"{n:03}", b"k", "") for n in range(1000)}) == 1000
    # one number, two ways of writing
    a, b = (personal.replace(x, frozenset(), b"k", True) for x in ("(030) 23125 636", "+44 20 7946 0888"))
    assert "".join(filter(str.isdigit, b)) == "".join(filter(str.isdigit, personal.replace("+44 20 7946 0888".replace(" 0888", "\n> 0888"), frozenset(), b"k", True)))
    assert "AB>" in personal.replace("Dear Jutta\nAB> Berg", NAMES, b"k", True)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_spans_never_overlap(text):
    spans = personal.find(text, NAMES)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:])) and all(0 <= e.start < e.end <= len(text) for e in spans)
    if not spans:
        assert personal.replace(text, NAMES, b"k") == text


def test_what_is_found_in_garbled_text_is_masked(spark):
    garble = lambda x: x.encode().decode("latin-1")
    a = spark.createDataFrame([(i, n, f"x{i}@y") for i, n in enumerate(["Petronel Müllenbach", "Müllenbach, Petronel", "Stellan Crèvemont", "Crèvemont, Stellan"])], "address_id bigint, addr_name string, addr string")
    rows = [(1, garble("größere Post für Stellan Crèvemont"), garble("„Petronel Müllenbach“ <p.m@mail.example>, überholt; (Müllenbach)!\nWeberstraße 12, schöne Grüße")), (2, "from Crèvemont", "Müllenbach und M&uuml;ller schön")]
    m = spark.createDataFrame(rows, "read_ord bigint, subject string, body_text string")
    found = {tuple(r) for r in personal.personal_data(m, a, KEY).collect()}
    assert {(1, "subject", "person"), (1, "body_text", "person"), (1, "body_text", "street"), (1, "body_text", "email"), (2, "body_text", "person")} <= found
    for surrogates in (False, True):
        out = {(r["read_ord"], r["field_name"]): r["text"] for r in personal.masked(m, a, KEY, surrogates).collect()}
        assert not any(x in t for t in out.values() for x in ("llenbach", "vemont", "Weberstra", "Petronel", "p.m@"))
        assert out[(1, "subject")].startswith(garble("größere Post für ")) and out[(1, "body_text")].endswith(garble(", schöne Grüße")) and garble(">, überholt; (") in out[(1, "body_text")]
        assert ")!\n" in out[(1, "body_text")]
    assert personal.left_after_masking(m, a, KEY).count() == 0
    with pytest.raises(ValueError):
        personal.masked(m, a, "")
    masked = personal.masked(m, a, KEY)
    back = masked.groupBy("read_ord").pivot("field_name", ["subject", "body_text"]).agg({"text": "first"})
    assert personal.personal_data(back, a, KEY).count() == 0


def test_tables(spark):
    a = spark.createDataFrame([(i, n, f"x{i}@y") for i, n in enumerate(["Jutta Berg", "Berg, Jutta", "Jutta (Silver Works)", None, "", "A list of many people here"])], "address_id bigint, addr_name string, addr string")
    m = spark.createDataFrame([(1, "from Jutta", "x"), (2, None, None), (3, "", "call 020 7946 0888"), (4, "JÃ¼rgen Jutta".replace("JÃ¼rgen ", ""), "y")], "read_ord bigint, subject string, body_text string")
    got = {tuple(r) for r in personal.personal_data(m, a, KEY).collect()}
    assert got == {(1, "subject", "person"), (3, "body_text", "phone"), (4, "subject", "person")}
    assert "silver" not in personal.known_names(a) and personal.masked(m, a, KEY).count() == 5
    assert personal.personal_data(m.limit(0), a.limit(0), KEY).count() == 0


# ---- evaluation items

def make_items(rng, n=12):
    return [(i, " ".join(sentence(rng, 12) for _ in range(5))) for i in range(n)]


def test_search_agrees_with_brute_force():
    rng = random.Random(3)
    items = [(i, "Read this and answer the following question now. " + t) for i, t in make_items(rng)]
    items += [(100 + i, " ".join(sentence(rng, rng.randint(2, 4)) for _ in range(6))) for i in range(6)]
    p = contamination.Patterns(items)
    for _ in range(60):
        text = [rng.choice(WORDS) for _ in range(80)]
        if rng.random() < 0.7:
            s = rng.choice(p.sentences)
            text[20:20] = s[: rng.randint(3, len(s)) if len(s) > 3 else len(s)]
        held = set(text)
        want = {}
        for k, s in enumerate(p.sentences):
            if len(set(s) - held) > p.most[k]:
                continue
            n = min(5, len(s))
            hits = [(a, i) for i in range(len(text) - n + 1) for a in range(len(s) - n + 1) if tuple(s[a : a + n]) == tuple(text[i : i + n])]
            if hits:
                want[k] = sorted(hits)
        assert {k: sorted(v) for k, v in p.occurrences(text).items()} == want


def test_equal_short_and_single_items_are_found():
    rng = random.Random(11)
    noise = [sentence(rng, 10) for _ in range(8)]
    held = lambda p, *parts: {i for i, _, _ in p.leaked(" ".join([*noise[:4], *parts, *noise[4:]]))}
    two = " ".join(sentence(rng, 11) for _ in range(2))
    for n in (1, 3, 4, 9):
        assert held(contamination.Patterns([(i, two) for i in range(n)]), two) == set(range(n))
    short = "Lamps glow. Rivers bend slowly. Nobody laughed then. Why? Doors close at nine."
    mixed = "Otters swim upstream whenever the old mill opens its heavy gate. They dive. They hide well. " + "Nobody counted the silver fish that the tall heron left behind."
    single = "Quiet engines carry seven crates of amber glass over the northern ridge."
    p = contamination.Patterns([(1, short), (2, single), (3, mixed), (4, "Yes. No."), (5, ""), (6, None)])
    assert held(p, short) == {1} and held(p, single) == {2} and held(p, single.replace("seven", "nine")) == {2} and held(p, mixed) == {3} and held(p) == set()
    assert held(p, "Rivers bend slowly.", "Why? Doors close at nine.") == {1} and held(p, "Doors close at nine.") == set() and held(p, "They dive. They hide well.") == set()
    # what many begin with tells nothing, what they hold later does
    told = "Answer the question after reading it. "
    q = contamination.Patterns([(i, told + " ".join(sentence(rng, 9) for _ in range(3))) for i in range(5)] + [(9, told)])
    assert held(q, told) == {9} or held(q, told) == set()
    shared = sentence(rng, 12)
    r = contamination.Patterns([(i, sentence(rng, 9) + " " + shared) for i in range(6)])
    assert all(shared[:-1].lower().split() == list(s) for s in r.sentences[1::2])


def test_single_words_join_their_neighbour():
    assert contamination.sentences_of("No. It is not. Why?") == (("no", "it", "is", "not", "why"),) and contamination.sentences_of("Alone") == (("alone",),)


def test_leaks(spark):
    rng = random.Random(4)
    items = make_items(rng)
    s = [x.strip() + "." for x in items[0][1].split(".") if x.strip()]
    noise = " ".join(sentence(rng, 10) for _ in range(6))
    changed = s[1].replace(s[1].split()[4], "different", 1)
    docs = [
        (1, noise + " " + items[0][1]), (2, "> " + "\n> ".join([s[3].upper(), s[0], changed]) + noise), (3, s[0] + " " + noise), (4, noise), (5, None), (6, ""), (7, f"<p>{s[4]}</p><p>{s[2]}</p><p>{s[0]}</p>"), (8, noise + " " + items[0][1]),
    ]
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id bigint, text string, item_id bigint")
    e = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.leaks(d, e).collect()}
    assert got == {(1, 0), (2, 0), (7, 0), (8, 0)}
    assert contamination.leaks(d.limit(0), e).count() == 0 and contamination.leaks(d, e.limit(0)).count() == 0


# ---- mixtures

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

def test_quotas_fill_what_others_can_not_give():
    t = [{"source": "a", "target_share": 2.0, "max_repeats": 1}, {"source": "b", "target_share": 2.0, "max_repeats": 2}, {"source": "c", "target_share": 0.0, "max_repeats": 1}, {"source": "d", "target_share": 1.0, "max_repeats": None}]
    got = {q["source"]: q["quota"] for q in mixing.quotas(t, {"a": 100, "b": 10, "c": 50}, 100)}
    assert got == {"a": 80, "b": 20, "d": 0}
    assert {q["source"]: q["quota"] for q in mixing.quotas(t, {}, 100)} == {"a": 0, "b": 0, "d": 0}


def check_windows(blocks):
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for n, (t, s, k) in enumerate(mixing.pfair(blocks)):
        # block k runs in its window: at every moment the source is less than one block from its share
        assert t == n and k == done[s] and k * total // blocks[s] <= t < -(-(k + 1) * total // blocks[s])
        done[s] += 1
    assert done == blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12))
def test_schedule_stays_within_a_block(sizes):
    check_windows({str(i): n for i, n in enumerate(sizes)})


def test_long_schedules_and_many_sources_stay_within_a_block():
    rng = random.Random(1)
    check_windows({"a": 61_803, "b": 27_182, "c": 14_142, "d": 1, "e": 3})
    check_windows({str(i): rng.choice([1, 1, 2, 7, 40]) for i in range(11_000)})


def test_more_sources_than_ten_thousand(spark):
    n = 10_400
    d = spark.createDataFrame([(i, "paper garden silver market", f"s{i}") for i in range(n)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", f"s{i}", 1.0 + i % 3, 2) for i in range(n)], "mix_name string, source string, target_share double, max_repeats int")
    drawn, shares = mixing.mixture(d, t, TOKENIZER, total_tokens=n * 4, block=2)
    assert shares.count() == n
    assert shares.where("abs(tokens - quota) > 8").isEmpty()


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(sentence(rng) for _ in range(rng.randint(1, 6))), "big" if i % 3 else "small") for i in range(400)] + [(900, None, "big"), (901, "", "small"), (902, "x", None)]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("m", "none", 1.0, 1), ("n", "small", 7.0, 2), (None, "big", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    drawn, shares = mixing.mixture(d, t, TOKENIZER, total_tokens=9000, block=256)
    rows, by = drawn.collect(), {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert by[("m", "none")]["tokens"] == 0
    for key, r in by.items():
        own = [x for x in rows if (x["mix_name"], x["source"]) == key]
        assert r["tokens"] == sum(x["tokens"] for x in own) and r["quota"] <= r["tokens"] + 1 <= r["quota"] + 300 or not own
        times = {}
        for x in own:
            times[x["doc_id"]] = times.get(x["doc_id"], 0) + 1
        assert max(times.values(), default=0) <= (3 if key == ("m", "small") else 2)
    assert mixing.mixture_texts(d, t, TOKENIZER, total_tokens=2000, most_slots=3).where("text is null or text = ''").isEmpty()
    assert mixing.mixture(d.limit(0), t, TOKENIZER)[0].count() == 0


# ---- cut texts

def documents(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = "\n\n".join(" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 4)))
        text += rng.choice(["", "", "", "\n\nYours, the garden desk", "\n\n* paper basket", "\n\nhttps://x.example/a/12", "\n\nsilver-letter.txt", "\n\n4120 pages in all", " And so on...", " More next week…"])
        out.append(text)
    return out


def test_held_out_accuracy():
    w = truncation.train([(t, 0) for t in documents(900, 1)])
    rng = random.Random(9)
    whole = documents(300, 2)
    cuts = [c for t in documents(300, 3) if (c := truncation.cut(t, rng))]
    score = lambda ts: w[truncation._matrix([truncation.features(t, 0) for t in ts])].sum(1) > -0.5
    assert score(cuts).mean() > 0.95 and score(whole).mean() < 0.03


def test_cut_documents(spark):
    rng = random.Random(7)
    texts = documents(300, 4)
    rows = [(i, t, f"s{i % 3}", i) for i, t in enumerate(texts)] + [(1000, None, "s0", 0), (1001, "", "s1", 0), (1002, "  ", None, 0), (1003, texts[0][: len(texts[0]) // 2].rsplit(" ", 1)[0] + " the garden wi", None, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score int")
    got = {r["doc_id"] for r in truncation.truncated(d).collect()}
    assert 1003 in got and not got & {1000, 1001, 1002} and len(got) < 20
    rates = {r["source"]: r["texts"] for r in truncation.truncation_rates(d).collect()}
    assert rates == {"s0": 100, "s1": 100, "s2": 100, None: 1}
    assert truncation.truncated(d.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["jo", "at", "(at)", "[ at ]", "AT", "dot", "(dot)", "DOT", ".", "@", " ", "  ", "mail", "x-y", "example", "<", "12", "\t", "\n", "und", "Largo"]), max_size=14))
def test_cheap_signs_lose_no_match(parts):
    view = personal._view("".join(parts))
    assert personal._DISGUISE.search(view) or all("@" in m[0] and personal.EMAIL.match(m[0]) for m in personal.DISGUISED.finditer(view))
