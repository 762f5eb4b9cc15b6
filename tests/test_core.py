"""Core operators against plain statements of their rules, with nulls, ties, empty tables and clashing columns."""

import datetime as dt
import itertools
import unicodedata
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postquarry.functions import html as H
from postquarry.functions import text as X
from postquarry.functions.compose import mailto
from postquarry.functions.identifiers import bare_id
from postquarry.operators import deliveries, filing, index, instants, listing, manifest

UTC = dt.timezone.utc


def us(*parts, zone=UTC):
    return int(dt.datetime(*parts, tzinfo=zone).timestamp()) * 1_000_000


DATES = [
    ("Mon, 5 Jun 2000 10:00:00 +0200", us(2000, 6, 5, 8)), ("5 Jun 00 10:00:00 -0700 (PDT)", us(2000, 6, 5, 17)), ("Mon, 05 Jun 2000 10:00:00 BST", us(2000, 6, 5, 9)),
    ("Mon Jun  5 10:00:00 2000", us(2000, 6, 5, 8)), ("05.06.2000 10:00", us(2000, 6, 5, 8)), ("5. Juni 2000 10:00:00", us(2000, 6, 5, 8)), ("2000/06/05 10:00:00", us(2000, 6, 5, 8)),
    ("05/06/2000 10:00:00 PM", us(2000, 6, 5, 20)), ("20000605T100000Z", us(2000, 6, 5, 10)), ("2000-06-05T10:00:00.250+02:00", us(2000, 6, 5, 8) + 250_000), ("2000-06-05 10:00 GMT-0700", us(2000, 6, 5, 17)),
    ("960199200", us(2000, 6, 5, 10)), ("960199200123", us(2000, 6, 5, 10) + 123_000), ("960199200123456", us(2000, 6, 5, 10) + 123_456), ("126046728000000000", us(2000, 6, 5, 10)),
    ("2000-10-29 02:30:00", None), ("2000-03-26 02:30:00", None), ("Wed, 31 Feb 2001 10:00:00 +0000", None), ("2000-06-05", None), ("Mon, 5 Jun 2000", None), ("soon", None), ("", None), (None, None),
    ("05/06/2000 13:00:00 PM", None), ("2000-06-05 10:00:61", None), ("Mon, 5 Jun 2000 10:00:00 XQZ", None), (" Mon,  5 Jun 2000 10:00:00 +0200 ", us(2000, 6, 5, 8)),
]


@pytest.fixture(scope="module")
def clocks(spark):
    rows = [(1, "Europe/Berlin", "dmy"), (2, "America/New_York", "mdy"), (None, "UTC", "dmy"), (3, None, None)]
    return spark.createDataFrame(rows, "source_id int, home_zone string, date_order string")


def test_written_dates(spark, clocks):
    df = spark.createDataFrame([(i, 1, d, "kept") for i, (d, _) in enumerate(DATES)], "read_ord bigint, source_id int, date_raw string, home_zone string")
    got = instants.resolve_instants(df, clocks).orderBy("read_ord").collect()
    assert [(r["date_raw"], r["instant_us"]) for r in got] == DATES and {r["home_zone"] for r in got} == {"kept"}


def test_unknown_source_has_no_clock(spark, clocks):
    df = spark.createDataFrame([(1, s, "2000-06-05 10:00:00") for s in (None, 3, 9)], "read_ord bigint, source_id int, date_raw string")
    assert {r["instant_us"] for r in instants.resolve_instants(df, clocks).collect()} == {None}
    assert instants.resolve_instants(df.limit(0), clocks).count() == 0


def test_local_times_agree_with_the_zone_database(spark):
    """Every half hour of the weeks around the changes, against a brute-force search of both folds."""
    zones = ["Europe/London", "America/New_York", "Asia/Kolkata"]
    sources = spark.createDataFrame([(i, z, "ymd") for i, z in enumerate(zones)], "source_id int, home_zone string, date_order string")
    starts = [dt.datetime(2007, 3, 10), dt.datetime(2007, 3, 24), dt.datetime(2007, 10, 27), dt.datetime(2007, 11, 3)]
    local = [s + dt.timedelta(minutes=30 * k) for s in starts for k in range(96)]
    rows = [(i, z, t.strftime("%Y-%m-%d %H:%M:%S")) for i, (z, t) in enumerate(itertools.product(range(3), local))]
    got = instants.resolve_instants(spark.createDataFrame(rows, "read_ord bigint, source_id int, date_raw string"), sources).orderBy("read_ord").collect()
    for r, (z, t) in zip(got, itertools.product(zones, local)):
        zone = ZoneInfo(z)
        both = {int(t.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1)}
        real = {x for x in both if dt.datetime.fromtimestamp(x, zone).replace(tzinfo=None) == t}
        assert r["instant_us"] == (real.pop() * 1_000_000 if len(real) == 1 else None), (z, t)


MAIL = "read_ord bigint, batch_id bigint, fetched_at timestamp_ntz, source_id int, uid string, message_id string, from_addr string, date_raw string, ident string, subject string, body_text string, body_html string"
AT = dt.datetime(2014, 1, 1)


def mails(spark, rows):
    return spark.createDataFrame([(r[0], 0, r[4] if len(r) > 4 else AT, 1, None, r[1], r[2], r[3], "own", None, r[5] if len(r) > 5 else "t", None) for r in rows], MAIL)


def brute_pairs(rows, instant):
    found = set()
    for x, y in itertools.combinations(rows, 2):
        a, b = instant[x[0]], instant[y[0]]
        same = x[1] and y[1] and x[1].strip("<> ").lower() == y[1].strip("<> ").lower() and (x[2] or "").lower() == (y[2] or "").lower()
        if same and a is not None and b is not None and abs(a - b) < 60_000_000:
            found.add((min(x[0], y[0]), max(x[0], y[0])))
    return found


def test_pairs_against_brute_force(spark, clocks):
    rows = []
    for i in range(120):
        second = (i * 7) % 300
        # runs over midnight, shared identifiers, null senders and dates
        when = None if i % 17 == 0 else (dt.datetime(2000, 6, 5, 23, 58) + dt.timedelta(seconds=second)).strftime("%a, %d %b %Y %H:%M:%S +0000")
        rows.append((i, [" <A@x>", "a@X", "b@x", None][i % 4], [None, "S@y", "s@Y"][i % 3], when))
    df = mails(spark, rows)
    instant = {r["read_ord"]: r["instant_us"] for r in instants.resolve_instants(df, clocks).collect()}
    got = {(r[0], r[1]) for r in deliveries.delivered_pairs(df, clocks).collect()}
    assert got == brute_pairs(rows, instant) and got


def test_one_copy_is_kept_by_arrival(spark, clocks):
    date = "Mon, 5 Jun 2000 10:00:00 +0000"
    rows = [(1, "<a@x>", "s", date, AT + dt.timedelta(hours=1)), (2, "a@x", "S", date, AT), (3, "a@x", "t", date, AT), (4, None, "s", date, AT), (5, "a@x", "s", None, AT)]
    df = mails(spark, rows)
    assert sorted(r[0] for r in deliveries.keep_one_copy(df, clocks).select("read_ord").collect()) == [2, 3, 4, 5]
    assert deliveries.keep_one_copy(df, clocks).columns == df.columns
    assert deliveries.delivered_pairs(df.limit(0), clocks).count() == 0
    new = mails(spark, [(11, "A@x", "s", date), (12, "n@x", "s", date), (13, "n@x", "s", date)])
    assert sorted(r[0] for r in deliveries.admit_batch(df, new, clocks).select("read_ord").collect()) == [12]


def test_copies_over_midnight_are_one_message(spark, clocks):
    rows = [(i, "a@x", "s", (dt.datetime(2000, 6, 5, 23, 59, 30) + dt.timedelta(seconds=20 * i)).strftime("%a, %d %b %Y %H:%M:%S +0000")) for i in range(6)]
    assert [r[0] for r in deliveries.keep_one_copy(mails(spark, rows), clocks).select("read_ord").collect()] == [0]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given,wanted", [("Re: RE[2]:  Fwd: a  b ", "a b"), ("Antwort: x", "x"), (None, ""), ("Reply: x", "Reply: x")])
def test_subjects(spark, given, wanted):
    assert one(spark, X.normalize_subject(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize("given,wanted", [("", "Inbox"), (None, "Inbox"), (" /sent items/2001/ ", "Sent/2001"), ("Work/Inbox", "Work/Inbox"), ("JUNK", "Junk")])
def test_folders(spark, given, wanted):
    assert one(spark, X.normalize_folder(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize("given,wanted", [("<A@b>", "a@b"), ("Your note of today <A @b> x", "a@b"), (" a@B\t", "a@b"), ("<>", None), (None, None)])
def test_identifiers(spark, given, wanted):
    assert one(spark, bare_id(F.lit(given).cast("string"))) == wanted


def tokens(text):
    import re

    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    out = []
    for m in re.finditer(r"[a-z0-9][a-z0-9'._+\-]*", folded):
        t = m[0].strip("'._+-")
        if 2 <= len(t) <= 60:
            out.append(t)
            if re.search(r"[._+\-]", t):
                out += [p for p in re.findall("[a-z0-9]+", t) if 2 <= len(p) <= 40 and p != t]
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzÄéßñоЖ09'._+- \n@…½ﬁ"), max_size=40), min_size=1, max_size=20))
def test_tokens_follow_the_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", X.tokenize(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [tokens(t) for t in texts]


def test_folder_order(spark):
    paths = ["Zoo", "Sent", "Inbox", "2004/Inbox", "2011/Sent", "2011/Inbox", "2011", "apple"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.orderBy(X.folder_sort_key(F.col("p"))).collect()] == ["2011", "2011/Inbox", "2011/Sent", "2004/Inbox", "Inbox", "Sent", "apple", "Zoo"]


def test_slugs_and_filenames():
    assert filing.number_slugs(["a", "a", "a-2", "a"]) == ["a", "a-2", "a-2-2", "a-3"]
    assert filing.number_filenames(["x.gif", "X.gif", "x.gif"]) == ["x.gif", "X-2.gif", "x-2-3.gif"]
    assert filing.number_filenames(["a", "a", "a"]) == ["a", "a-2", "a-2-3"]


@pytest.mark.parametrize("counts,accounts", [
    ({"a": 5, "b": 5}, {"a", "b"}), ({"a": 20, "b": 1}, {"a"}), ({"a": 100, "b": 100, "c": 1}, {"a", "b", "Other Recipients"}), ({"": 4}, {"Unknown Recipient"}), ({"a": 1, "b": 1}, {"a"}),
])
def test_accounts(spark, counts, accounts):
    rows = [(c, i) for i, c in enumerate(x for x, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "candidate string, read_ord int")
    assert {r["account"] for r in filing.assign_accounts(df).collect()} == accounts


def test_account_candidates(spark):
    headers = "array<struct<k:string,v:string>>"
    df = spark.createDataFrame([
        ("Sent/2001", "Me@x.org", [], ["o@x.org"]), ("Inbox", "s@x.org", [("delivered-to", "<Box@x.org>")], ["o@x.org"]), ("Inbox", "s@x.org", [], ["", "O@x.org"]), ("Inbox", "s@x.org", [], []), ("Inbox", None, None, None),
    ], f"f string, s string, h {headers}, t array<string>")
    got = [r[0] for r in df.select(filing.account_candidate(F.col("f"), F.col("s"), F.col("h"), F.col("t"))).collect()]
    assert got == ["me@x.org", "box@x.org", "o@x.org", "s@x.org", ""]


def test_longest_copy_in_first_place(spark):
    df = spark.createDataFrame([("u", 1, "ab", None), ("u", 2, "abc", None), ("u", 3, None, "xyz"), ("v", 4, None, None), (None, 5, "x", "x")], "uid string, read_ord int, body_text string, body_html string")
    got = {r["uid"]: (r["read_ord"], r["slot"], r["copies"]) for r in filing.dedupe_longest(df).collect()}
    assert got == {"u": (2, 1, 3), "v": (4, 4, 1)}
    assert sorted(r["read_ord"] for r in filing.first_uids(df.where("uid is not null"), 1).collect()) == [1]
    assert filing.dedupe_longest(df.limit(0)).count() == 0 and filing.first_uids(df.limit(0), 3).count() == 0


def test_tree(spark):
    df = spark.createDataFrame([("a/2001/Inbox", True), ("a/2001/Inbox", None), ("a/2002/Inbox", False), ("b", True)], "path string, unread boolean")
    tree = {r["path"]: (r["parent"], r["depth"], r["count"], r["unread"]) for r in filing.folder_tree(df).collect()}
    assert tree["a"] == (None, 0, 0, 0) and tree["a/2001/Inbox"] == ("a/2001", 2, 2, 1) and len(tree) == 6
    assert {r["path"]: r["unread"] for r in filing.branch_unread(df).collect()}["a"] == 1
    assert {r["path"]: r["collapsed"] for r in filing.collapsed_years(filing.folder_tree(df)).collect()} == {"a/2002": False, "a/2001": True}


def test_postings_round_trip_and_search(spark):
    docs = spark.createDataFrame([(1, "heavy pump", "the pump.gif", 9), (2, None, "heavy heavy", 9), (3, "", None, None), (4, "pumps", "heavier", 10)], "gid bigint, subject string, body string, epoch bigint")
    rows = index.postings(docs, "gid", {1: F.col("subject"), 8: F.col("body")})
    assert {(r["gid"], r["token"]): r["mask"] for r in rows.collect()}[(1, "pump")] == 9 and rows.where("token = 'the'").isEmpty()
    found = [r["gid"] for r in index.search(rows, docs, "pump heav").collect()]
    assert found == [4, 1] or found == [1, 4]
    assert {r["gid"] for r in index.matches(rows, "pump heavy", exact=True).collect()} == {1}
    assert index.matches(rows, "!").isEmpty() and index.matches(rows, "the pump").isEmpty()
    assert not index.matches(rows, "the pump", drop_stopwords=True).isEmpty()
    # AND never finds more than any of its terms
    assert {r["gid"] for r in index.matches(rows, "pump heav").collect()} <= {r["gid"] for r in index.matches(rows, "pump").collect()}


def test_listing_and_threads(spark):
    df = spark.createDataFrame([("p", "a", 5, "t", True), ("p", "b", 5, "t", False), ("p", "c", None, None, True), ("q", "d", 1, "t", None)], "path string, uid string, epoch bigint, thread string, unread boolean")
    assert {r["uid"]: r["idx"] for r in listing.listing(df).collect()} == {"b": 0, "a": 1, "c": 2, "d": 0}
    assert {r["uid"]: r["gid"] for r in listing.document_ids(df).collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}
    assert {r["uid"]: (r["prev"], r["next"]) for r in listing.neighbours(df).collect()}["a"] == ("b", "c")
    assert {r["uid"]: r["member"] for r in listing.threads(df).where("thread = 't'").collect()} == {"d": 1, "a": 2, "b": 3}
    assert {r["uid"]: r["next_unread"] for r in listing.next_unread(df).collect()}["b"] == "a"
    marks = spark.createDataFrame([("a",)], "uid string")
    assert [r["uid"] for r in listing.unread_rows(df, marks).collect()] == ["c"]


def test_manifest(spark, tmp_path):
    now = spark.createDataFrame([("a", "1", "n", "f"), ("b", "2", "n", "f"), ("c", "3", None, "f")], "uid string, hash string, nav string, folder string")
    was = spark.createDataFrame([("a", "1", "n", "f", "t0", "t0"), ("b", "x", "n", "f", "t0", "t0"), ("d", "4", "n", "f", "t0", "t0")], "uid string, hash string, nav string, folder string, first_seen string, last_built string")
    acts = lambda **k: {r["uid"]: r["action"] for r in manifest.diff(now, was, **k).collect()}
    assert acts() == {"a": "unchanged", "b": "updated", "c": "added", "d": "gone"} and acts(force=True)["a"] == "updated"
    assert acts(pages=spark.createDataFrame([("b",)], "uid string"))["a"] == "updated"
    manifest.save(manifest.next_manifest(now, was, "t1"), str(tmp_path / "m"))
    kept = {r["uid"]: (r["first_seen"], r["last_built"]) for r in manifest.load(spark, str(tmp_path / "m")).collect()}
    assert kept == {"a": ("t0", "t0"), "b": ("t0", "t1"), "c": ("t1", "t1"), "d": ("t0", "t0")}
    assert manifest.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(RuntimeError):
        manifest.guard_empty(now.limit(0), was)


def test_recovery_survives_markup_in_subjects(spark):
    df = spark.createDataFrame([("u", "a</script><b>")], "uid string, subject string")
    meta = F.to_json(F.struct("uid", F.lit("f").alias("folder"), F.lit("h").alias("hash"), "subject", F.lit("").alias("nav"), F.lit(1).alias("date")))
    pages = df.select(manifest.page_html(meta).alias("html")).unionByName(spark.createDataFrame([("no record",)], "html string"))
    assert [r["subject"] for r in manifest.recover(pages).collect()] == ["a</script><b>"]


@pytest.mark.parametrize("given,has,lacks", [
    ('<script>x</script><p onclick="a">b</p>', "<p>b</p>", "script"), ('<a href="javascript:x">y</a>', "y", "javascript"), ('<img src="http://t.example/p.gif">', "data-remote-src", ' src="http'),
    ("<b><i>x", "<b><i>x</i></b>", "??"), ('<p style="color: red; background: url(x)">a</p>', 'style="color: red"', "url("), ("<head><title>t</head><body>real text</body>", "real text", "<title"), (None, "", "x"),
])
def test_sanitize(given, has, lacks):
    out, _ = H.sanitize(given)
    assert has in out and lacks not in out


def test_text_rendering():
    assert H.strip_tags("<p>a</p><style>x</style>b<br>c") == "a\nb\nc" and H.strip_tags(None) == ""
    assert 'quote-2">&gt;' in H.text_html("> > x") and "mailto:a@b.org" in H.text_html("a@b.org") and H.text_html(None)
    assert H.safe_link(" java\x00script:x") is None and H.safe_link("a/b") == "a/b"
    assert H.body_html(" ", "x")[2] and not H.body_html("<p>x</p>", "y")[2]


def test_mailto(spark):
    url = one(spark, mailto("reply", F.lit("a b"), F.lit(""), F.lit("s@x.org"), F.lit("l1\nl2"), F.lit("m@x"), to=F.array(F.lit("")), cc=F.array(F.lit(""))))
    assert url == "mailto:s@x.org?subject=Re%3A%20a%20b&body=%0A%0As%40x.org%20wrote%3A%0A%3E%20l1%0A%3E%20l2&in-reply-to=%3Cm%40x%3E"
    assert one(spark, mailto("reply", F.lit("a"), F.lit(""), F.lit(""), F.lit(""), F.lit(""))) == ""
    assert "Fwd%3A" in one(spark, mailto("forward", F.lit("a"), F.lit(""), F.lit(""), F.lit(""), F.lit("")))


def test_sizes_with_ties_and_nulls(spark, tmp_path):
    from postquarry.plans.archive_queries import size_format

    sizes = [None, 0, 1, 512, 1023, 1024, 1536, 2560, 3584, 2559, 2561, 1048064, 1048575, 1048576, 1310720, 1835008, 1310719, 1310721, 5 * 1048576 + 52429, 7 << 40, *range(1024, 60_000, 256), *range(1048576, 4_000_000, 65536)]
    spark.createDataFrame(list(enumerate(sizes)), "read_ord bigint, size_bytes bigint").write.parquet(str(tmp_path / "messages.parquet"))
    want = {i: None if n is None else f"{n} B" if n < 1024 else f"{n / 1024:.0f} KB" if n < 1048576 else f"{n / 1048576:.1f} MB" for i, n in enumerate(sizes)}
    assert {r["read_ord"]: r["size"] for r in size_format(spark, str(tmp_path)).collect()} == want


def test_compact_dates_without_t(spark, clocks):
    rows = [(1, 1, "20050102030405"), (2, 1, "20050102T030405"), (3, 1, "20050102030405Z"), (4, 1, "20051302030405"), (5, 1, "11046374450"), (6, 1, "1104637445")]
    got = {r["read_ord"]: r["instant_us"] for r in instants.resolve_instants(spark.createDataFrame(rows, "read_ord bigint, source_id int, date_raw string"), clocks).collect()}
    assert got[1] == got[2] is not None and got[3] == 1104635045 * 10**6 and got[4] is None and got[5] is None and got[6] == 1104637445 * 10**6


def test_links_and_recovery():
    line = H.linkify('see <http://x.org/a?b=1&c=2>, www.y.org. "me@www.z.org"')
    assert 'href="http://x.org/a?b=1&amp;c=2"' in line and ">www.y.org</a>." in line and 'href="mailto:me@www.z.org"' in line and line.startswith("see &lt;")
    assert H.linkify("http://a") == "http://a" and H.linkify("") == ""
    assert H.strip_tags("<object>lost<body>kept<p>too") == "kept\ntoo"
    out, held = H.sanitize('<img src="a.gif"><img src="cid:p@q"><b><i>x</b></u>y', cids={"p@q": "files/p"})
    assert held == 1 and 'data-remote-src="a.gif"' in out and 'src="files/p"' in out and out.endswith("<b><i>x</i></b>y")
    assert H.sanitize('<img src="a.gif">', block_remote=False) == ('<img src="a.gif">', 0)
    lost = "<title>never closed <body><p>" + "words of the message " * 5
    assert "words of the message" in H.sanitize(lost)[0]


def test_undated_copies_and_classes(spark, clocks):
    date = "Mon, 5 Jun 2000 10:00:00 +0000"
    rows = [
        (1, "<a@x>", "s", None, AT, "t"), (2, "A@x", "S", None, AT, "t"), (3, "a@x", "s", None, AT, "other"), (4, "a@x", "s", "soon", AT, "t"), (5, None, "s", None, AT, "t"), (6, None, "s", None, AT, "t"),
        (7, "a@x", "s", date, AT, "t"), (8, "a@x", None, date, AT, "t"), (9, "a@x", None, date, AT, "u"),
    ]
    df = mails(spark, rows)
    assert sorted(r[0] for r in deliveries.keep_one_copy(df, clocks).select("read_ord").collect()) == [1, 3, 4, 5, 6, 7, 8]
    got = {r["read_ord"]: (r["class_id"], r["copies"]) for r in deliveries.delivery_classes(df, clocks).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (6, 1), 7: (7, 1), 8: (8, 2), 9: (8, 2)}
    new = mails(spark, [(21, "a@x", "s", None, AT, "t"), (22, "b@x", "s", None, AT, "t"), (23, "b@x", "s", None, AT, "t"), (24, None, "s", None, AT, "t"), (25, "a@x", "s", date, AT, "t"), (26, "a@x", "s", None, AT, "new")])
    assert sorted(r[0] for r in deliveries.admit_batch(df, new, clocks).select("read_ord").collect()) == [22, 24, 26]
    assert deliveries.admit_batch(df.limit(0), new.limit(0), clocks).count() == 0


def test_first_copies_are_ranked_before_the_shuffle(spark, clocks):
    plan = deliveries.keep_one_copy(mails(spark, [(1, "a@x", "s", None)]), clocks)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_dates_of_all_mail_years(spark, clocks):
    rows = [(1, 1, "1975-06-05 10:00:00"), (2, 1, "2050-07-05 10:00:00"), (3, 1, "1901-06-05 10:00:00"), (4, 1, "2101-06-05 10:00:00")]
    got = [r["instant_us"] for r in instants.resolve_instants(spark.createDataFrame(rows, "read_ord bigint, source_id int, date_raw string"), clocks).orderBy("read_ord").collect()]
    assert got == [us(1975, 6, 5, 9), us(2050, 7, 5, 8), None, None]


def test_folding_agrees_with_the_decomposition_everywhere(spark):
    signs = [c for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000)] if c < 0x0590 or unicodedata.normalize("NFKD", chr(c)) != chr(c) or unicodedata.combining(chr(c))]
    rows = [(c, f"of{chr(c)}ice") for c in signs]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, t string").select("i", X.tokenize(F.col("t")).alias("x")).collect()}
    wrong = [i for i, t in rows if got[i] != tokens(t)]
    assert not wrong, wrong[:5]


def test_windows_by_day_agree_with_plain_ones(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("pq"), f"u{i:03}", rng.choice([None, 0, 5, 86_400, 86_401, 90_000, 400_000, 400_000, -70_000]), rng.choice(["t", "s", None]), rng.choice([True, False, None])) for i in range(160)]
    df = spark.createDataFrame(rows, "path string, uid string, epoch bigint, thread string, unread boolean")
    want_idx, want_near, want_open = {}, {}, {}
    for p in "pq":
        own = sorted((r for r in rows if r[0] == p), key=lambda r: (r[2] or 0, r[1]), reverse=True)
        for i, r in enumerate(own):
            want_idx[r[1]] = i
            want_near[r[1]] = (own[i - 1][1] if i else "", own[i + 1][1] if i + 1 < len(own) else "")
            want_open[r[1]] = next((x[1] for x in own[i + 1 :] if x[4]), None)
    assert {r["uid"]: r["idx"] for r in listing.listing(df).collect()} == want_idx
    assert {r["uid"]: (r["prev"], r["next"]) for r in listing.neighbours(df).collect()} == want_near
    assert {r["uid"]: r["next_unread"] for r in listing.next_unread(df).collect()} == want_open
    want = {}
    for t in ("t", "s", None):
        own = sorted((r for r in rows if r[3] == t), key=lambda r: (r[2] or 0, r[1]))
        want |= {r[1]: (i + 1, min(i, 1), len(own) - 1 if not i else 0, max(x[2] or 0 for x in own)) for i, r in enumerate(own)}
    assert {r["uid"]: (r["member"], r["depth"], r["kids"], r["newest"]) for r in listing.threads(df).collect()} == want
    order = sorted(rows, key=lambda r: (-(r[2] or 0), r[1]))
    got = listing.ranked(df, listing.sort_order(), parts=5).collect()
    assert {r["uid"]: r["place"] for r in got} == {r[1]: i for i, r in enumerate(order, 1)}


def test_blocks_of_postings(spark, monkeypatch):
    monkeypatch.setattr(index, "SPAN", 4)
    gids = [0, 1, 3, 4, 9, 17, 18, 40]
    df = spark.createDataFrame([(g, "a", 1 + g % 2) for g in gids] + [(7, "b", 8)], "gid bigint, token string, mask int")
    d = {(r["token"], r["gid"]): r["delta"] for r in index.deltas(df).collect()}
    assert [d[("a", g)] for g in gids] == [0, 1, 2, 1, 5, 8, 1, 22] and d[("b", 7)] == 7
    coded = spark.createDataFrame([("a", i, d[("a", g)], 1) for i, g in enumerate(gids, 1)], "token string, pos int, delta bigint, mask int")
    assert sorted(r["gid"] for r in index.undo_deltas(coded).collect()) == gids
    assert {(r["token"], r["block"]): r["entries"] for r in index.posting_blocks(df).collect()}[("a", 4)] == "17:2 18:1"
