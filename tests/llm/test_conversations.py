"""Conversations against a plain statement of the rules."""

import datetime as dt
import heapq
import random

import pytest

from postquarry.llm import conversations as C

SCHEMA = "read_ord bigint, fetched_at timestamp_ntz, source_id int, message_id string, from_addr string, in_reply_to string, refs array<string>, date_raw string, body_text string, body_html string, root_id string"
START = dt.datetime(2000, 1, 1)


def row(n, mid, sender, parent=None, refs=None, minutes=0, body="text", markup=None):
    raw = None if minutes is None else (START + dt.timedelta(minutes=minutes)).strftime("%a, %d %b %Y %H:%M:%S +0000")
    return (n, START, 1, mid, sender, parent, refs, raw, body, markup, "own")


@pytest.fixture(scope="module")
def clocks(spark):
    return spark.createDataFrame([(1, "UTC", "dmy")], "source_id int, home_zone string, date_order string")


def run(spark, clocks, rows):
    got = C.conversations(spark.createDataFrame(rows, SCHEMA), clocks).collect()
    return {(r["root_id"], r["message_id"], r["turn_no"]) for r in got}


def plain(rows):
    """The rules, one message a row."""
    by = {r[3]: r for r in rows}
    parent = {m: r[5] or (r[6][-1] if r[6] else None) for m, r in by.items()}
    links = {m: set(([r[5]] if r[5] else []) + (r[6] or [])) for m, r in by.items()}
    names = set(by) | {x for s in links.values() for x in s}
    label = {x: x for x in names}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for m, s in links.items():
        for x in s:
            label[top(m)] = top(x)
    groups = {}
    for x in names:
        groups.setdefault(top(x), set()).add(x)
    out = set()
    for g in groups.values():
        if not g <= set(by) or len(g) < 2:
            continue
        roots = [m for m in g if parent[m] is None]
        if len(roots) != 1 or len({by[m][4].lower() for m in g}) < 2 or not any(by[m][8] for m in g):
            continue
        kids = {}
        for m in g:
            kids.setdefault(parent[m], []).append(m)
        order, heap = [], [(by[roots[0]][7], roots[0])]
        at = lambda m: dt.datetime.strptime(by[m][7], "%a, %d %b %Y %H:%M:%S +0000")
        heap = [(at(roots[0]), roots[0])]
        while heap:
            _, m = heapq.heappop(heap)
            order.append(m)
            for k in kids.get(m, []):
                heapq.heappush(heap, (at(k), k))
        if len(order) == len(g):
            out |= {(roots[0], m, i) for i, m in enumerate(order, 1)}
    return out


def test_random_threads_agree(spark, clocks):
    rng = random.Random(2)
    rows, n = [], 0
    for t in range(40):
        ids = [f"m{t}-{i}@x" for i in range(rng.randint(1, 9))]
        for i, m in enumerate(ids):
            up = rng.choice(ids[:i]) if i else None
            if i and rng.random() < 0.04:
                up = "lost@x"
            if i and rng.random() < 0.04:
                up = ids[min(i + 1, len(ids) - 1)]  # may answer itself or a later one
            refs = [rng.choice(ids)] + [up] if up and rng.random() < 0.4 else None
            minutes = i * 10 - (25 if rng.random() < 0.3 else 0) + t * 1000
            rows.append(row(n, m, f"s{rng.randint(0, 2)}@y", up if not refs or rng.random() < 0.5 else None, refs, minutes))
            n += 1
    rng.shuffle(rows)
    got = run(spark, clocks, rows)
    assert got == plain(rows) and got


def test_forms_copies_and_gaps(spark, clocks):
    rows = [
        row(1, " <A@x>", "me@y"), row(2, "b@X", "You@y", "Your note <a@x>", [], 5), row(3, "<B@x>\t", "you@y", "a@x", None, 5), row(4, "c@x", "me@y", None, ["a@x", None, "<b@x>"], None),
        row(5, None, "z@y", "a@x"), row(6, "", "z@y"), row(7, "d@x", "me@y"), row(8, "e@x", "ME@y", "d@x", None, 9), row(9, "f@x", "p@y", None, None, 0, None, "<p>&nbsp;</p>"), row(10, "g@x", "q@y", "f@x", None, 1, " ", "<style>x</style>"),
    ]
    assert run(spark, clocks, rows) == {("a@x", "a@x", 1), ("a@x", "b@x", 2), ("a@x", "c@x", 3)}
    assert run(spark, clocks, rows[:1]) == set()


def test_empty_table(spark, clocks):
    df = spark.createDataFrame([row(1, "a", "b")], SCHEMA).limit(0)
    assert C.conversations(df, clocks).count() == 0


def test_long_chain(spark, clocks):
    rows = [row(i, f"m{i:03d}@x", f"s{i % 2}@y", f"m{i - 1:03d}@x" if i else None, None, 500 - i) for i in range(130)]
    got = run(spark, clocks, rows)
    assert {(m, n) for _, m, n in got} == {(f"m{i:03d}@x", i + 1) for i in range(130)}


@pytest.mark.parametrize("length", [2, 3, 5, 6])
def test_circles_beside_a_root_end_and_give_nothing(spark, clocks, length):
    rows = [row(0, "root@x", "a@y")]
    ids = [f"c{i}@x" for i in range(length)]
    # the circle hangs on the root by refs only; a tail hangs on the circle
    rows += [row(1 + i, m, "b@y", ids[(i + 1) % length], ["root@x"], i) for i, m in enumerate(ids)]
    rows += [row(20, "tail@x", "c@y", ids[0], ["root@x"], 9), row(30, "p@x", "a@y"), row(31, "q@x", "b@y", "p@x", None, 3)]
    assert run(spark, clocks, rows) == {("p@x", "p@x", 1), ("p@x", "q@x", 2)}


def test_edits_deletes_and_retries_fold_by_version(spark, clocks):
    from pyspark.sql import functions as F

    rows = [
        (1, START, 1, "a@x", "me@y", None, None, None, "first", None, "s"), (2, START + dt.timedelta(hours=2), 1, "a@x", "me@y", None, None, None, "edited", None, "s"),
        (3, START + dt.timedelta(hours=3), 1, "a@x", "me@y", None, None, None, " ", None, "s"), (4, START, 1, "b@x", "you@y", "a@x", None, None, None, "<p>reply</p>", "s"),
        (5, START, 1, "c@x", "me@y", None, None, None, "gone", None, "s"), (6, START, 1, "d@x", "you@y", "c@x", None, None, "lost", None, "s"), (7, START + dt.timedelta(hours=1), 1, "c@x", None, None, None, None, None, None, "delete"),
    ]
    df = spark.createDataFrame([(*r, "S") for r in rows], SCHEMA + ", subject string")
    deleted = F.col("root_id") == "delete"
    got = {r["message_id"]: (r["turn_no"], r["text"], r["role"]) for r in C.conversation_texts(df, clocks, deleted).collect()}
    assert got == {"a@x": (1, "edited", "owner"), "b@x": (2, "<p>reply</p>", "correspondent")}
    assert set(C.conversation_texts(df, clocks).toPandas()["message_id"]) == {"a@x", "b@x", "c@x", "d@x"}
