"""Readers over generated mailboxes, and a whole build."""

import bz2
import gzip
import io
import json
import lzma
import random
import tarfile
import zipfile

import pytest

from postquarry.sources import mailbox, mime, pst

MESSAGES = [
    (f"From: A{i} <a{i}@one.example>\nTo: Box <box@mail.example>\nSubject: Number {i}\nMessage-ID: <m{i}@one.example>\nDate: Mon, {i + 1} Jan 2001 10:00:00 -0800\n\nBody {i}\n").encode() for i in range(4)
]


def box(messages=MESSAGES):
    return b"".join(b"From a@b Mon Jan  1 00:00:00 2001\n" + m + b"\n" for m in messages)


def test_split_keeps_inner_from_lines():
    inner = b"Subject: x\n\nline\nFrom here on it goes\n"
    assert list(mailbox.split_mbox(io.BytesIO(box([inner, inner])))) == [inner + b"\n"] * 2
    # a paragraph that starts so divides, as mailboxes are written
    assert len(list(mailbox.split_mbox(io.BytesIO(b"From a b\nS: x\n\nFrom now on\nmore\n")))) == 2
    assert list(mailbox.split_mbox(io.BytesIO(b""))) == []


def test_record_fields():
    r = mime.from_bytes(MESSAGES[0])
    assert (r["message_id"], r["subject"], r["sender"]["addr"], r["date_offset_s"]) == ("m0@one.example", "Number 0", "a0@one.example", -28800)
    assert mime.from_bytes(b" \n") is None


def test_encoded_headers_and_parts():
    raw = (
        b"From: =?utf-8?q?J=C3=B6rg?= <j@x.example>\nSubject: =?iso-8859-1?q?Gr=FC=DFe?=\nContent-Type: multipart/mixed; boundary=b\nX-Priority: 1 (Highest)\nStatus: O\n\n"
        b"--b\nContent-Type: text/plain; charset=iso-8859-1\n\nGr\xfc\xdfe\n--b\nContent-Type: application/pdf; name=\"a/b c?.pdf\"\nContent-Transfer-Encoding: base64\n\nAAAA\n--b--\n"
    )
    r = mime.from_bytes(raw)
    assert (r["sender"]["name"], r["subject"], r["body_text"], r["priority"], r["unread"]) == ("Jörg", "Grüße", "Grüße", "Highest", True)
    assert r["attachments"][0]["filename"] == "b c_.pdf" and r["attachments"][0]["size"] == 3


def test_dates():
    assert mime.parse_date("Mon, 1 Jan 2001 10:00:00").utcoffset().total_seconds() == 0
    assert mime.parse_date("Mon, 1 Jan 1901 10:00:00 +0000") is None and mime.parse_date("soon") is None


def test_labels():
    for labels, folder in [
        ("Inbox,Important,Unread", "Inbox"), ("Sent", "Sent"), ("Draft", "Drafts"), ("Spam,Unread", "Junk"), ("Receipts,Archived", "Receipts"), ("Archived,Starred", "Archive"), ("Inbox,Receipts", "Inbox"),
    ]:
        assert mailbox.labels_folder(labels.split(",")) == folder


def test_detect(tmp_path):
    for name, data, kind in [
        ("a.mbox", box(), "mbox"), ("b.bin", gzip.compress(box()), "mbox-compressed"), ("c", b"!BDNxxxx", "pst"), ("d.eml", MESSAGES[0], "eml-file"), ("e.pst", b"", "pst"),
    ]:
        (tmp_path / name).write_bytes(data)
        assert mailbox.detect(tmp_path / name) == kind
    for sub in ("cur", "new"):
        (tmp_path / "m" / sub).mkdir(parents=True)
    assert mailbox.detect(tmp_path / "m") == "maildir" and mailbox.detect(tmp_path) == "eml"


def test_fingerprint(tmp_path):
    assert mailbox.fingerprint(tmp_path / "none") == "missing"
    (tmp_path / "x").write_bytes(b"a")
    first = mailbox.fingerprint(tmp_path)
    (tmp_path / "x").write_bytes(b"ab")
    assert mailbox.fingerprint(tmp_path) != first


class Item:
    def __init__(self, **k):
        self.__dict__ |= k

    def __getattr__(self, name):
        raise OSError(name)


def test_pst_items():
    import datetime as dt

    full = Item(subject="S", sender_name="N", sender_email_address="/O=ORG/CN=x", delivery_time=dt.datetime(2001, 1, 1), plain_text_body=b"caf\xe9\x00", flags=0, importance=2)
    r = pst.convert(full, "Inbox", "f.pst", 0)
    assert (r["subject"], r["sender"], r["body_text"], r["unread"], r["priority"]) == ("S", {"name": "N", "addr": ""}, "café", True, "High")
    assert pst.convert(Item(), "Inbox", "f.pst", 0) is None
    root = Item(name="Root", messages=[], folders=[Item(name="Inbox", messages=[full], folders=[Item(name="Sub", messages=[full], folders=[])])])
    assert [x["folder"] for x in pst.walk(root, "", "f")] == ["Inbox", "Inbox/Sub"]
    assert pst.rtf_text(r"{\rtf1{\fonttbl{\f0 A;}}Hello\par W\'f6rld}") == "Hello\nWörld"


def test_pst_without_backend(tmp_path):
    (tmp_path / "a.pst").write_bytes(b"!BDN")
    with pytest.raises(RuntimeError, match="pypff"):
        list(pst.read(str(tmp_path / "a.pst")))


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "Inbox.mbox").write_bytes(box())
    (tmp_path / "old.mbox.gz").write_bytes(gzip.compress(box()))
    (tmp_path / "old.mbox.bz2").write_bytes(bz2.compress(box()))
    (tmp_path / "old.mbox.xz").write_bytes(lzma.compress(box()))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("Mail/Sent.mbox", box())
        z.writestr("notes.txt", "x")
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("Mail/All.mbox")
        info.size = len(box())
        t.addfile(info, io.BytesIO(box()))
    tree = tmp_path / "tree" / "Projects" / "cur"
    tree.mkdir(parents=True)
    (tree / "1:2,S").write_bytes(MESSAGES[1])
    (tree / "junk.bin").write_bytes(b"\0\0\0")
    (tree / "x.jpg").write_bytes(MESSAGES[1])
    return tmp_path


def test_data_source(spark, sources):
    from postquarry.sources.datasource import read_mail

    paths = [str(sources / n) for n in ("Inbox.mbox", "old.mbox.gz", "old.mbox.bz2", "old.mbox.xz", "t.zip", "t.tgz", "tree")]
    rows = read_mail(spark, *paths).select("folder", "message_id", "error").collect()
    assert len(rows) == 6 * 4 + 1 and not any(r["error"] for r in rows)
    assert {r["folder"] for r in rows} == {"Inbox", "old", "Sent", "All", "Projects"}


def test_failing_source_is_a_row(spark, sources):
    from postquarry.sources.datasource import read_mail

    (sources / "bad.mbox.gz").write_bytes(b"\x1f\x8bbroken")
    rows = read_mail(spark, str(sources / "bad.mbox.gz"), str(sources / "Inbox.mbox")).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and len(rows) == 5


def test_build_is_incremental(spark, sources):
    from postquarry.operators.manifest import known_sources, load
    from postquarry.plans.publish import build, current_pages, export_json, search

    out = str(sources / "out")
    paths = [str(sources / "Inbox.mbox"), str(sources / "old.mbox.gz")]
    first = build(spark, paths, out, now="t1")
    assert (first.added, first.duplicates, first.errors) == (4, 4, ())
    again = build(spark, paths, out, now="t2")
    assert (again.added, again.updated, again.unchanged) == (0, 0, 4)
    assert {r["first_seen"] for r in load(spark, out + "/manifest").collect()} == {"t1"}
    assert "fingerprint" in known_sources(spark, out + "/manifest")[paths[0]]
    hits = search(spark, out, "number body").collect()
    assert len(hits) == 4
    export_json(spark, out, built="t2", news_host="news.example")
    told = json.loads((sources / "out/data/folders.json").read_text())
    assert told["built"] == "t2" and told["newsHost"] == "news.example" and told["totalMessages"] == 4 and len(told["folders"]) == 3
    assert spark.read.text(out + "/data/search/docs").count() == 4 and spark.read.text(out + "/data/search/shards").where("value like '%\"number\"%'").count() == 1
    page = current_pages(spark, out).where("html like '%Number 0%'").first()
    assert "Body 0" in page["html"] and page["plain"] and page["page"].startswith("msg/") and page["built"] == "t1"
    (sources / "out" / "manifest" / "current.json").unlink()
    recovered = build(spark, paths, out, now="t2")
    assert (recovered.added, recovered.unchanged) == (0, 4)
    (sources / "Inbox.mbox").write_bytes(box(MESSAGES[:1]))
    less = build(spark, [str(sources / "Inbox.mbox")], out, now="t3")
    # neighbours of the one left changed, so its page is made again; the others keep theirs
    assert (less.updated, less.gone, less.pruned) == (1, 3, 0) and load(spark, out + "/manifest").count() == 4
    assert {r["built"] for r in current_pages(spark, out).collect()} == {"t1", "t3"} and current_pages(spark, out).count() == 4
    gone = build(spark, [str(sources / "Inbox.mbox")], out, now="t4", prune=True)
    assert gone.pruned == 3 and current_pages(spark, out).count() == 1
    (sources / "Inbox.mbox").write_bytes(b"")
    with pytest.raises(RuntimeError):
        build(spark, [str(sources / "Inbox.mbox")], out, now="t5")


def test_options_of_a_build(spark, tmp_path):
    from postquarry.plans.publish import build, page_html

    parts = b"".join(
        b"--b\nContent-Type: image/gif; name=\"p.gif\"\nContent-ID: <c%d@x>\nContent-Transfer-Encoding: base64\n\nAAA%d\n" % (i, i) for i in range(2)
    )
    rich = b"From: a@x.example\nMessage-ID: <r@x>\nDate: Mon, 1 Jan 2001 10:00:00 +0000\nContent-Type: multipart/related; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>see <img src='cid:c1@x'><img src='http://t.example/p.gif'></p>\n" + parts + b"--b--\n"
    (tmp_path / "b.mbox").write_bytes(box([rich]))
    (tmp_path / "a.mbox").write_bytes(box([rich.replace(b"see", b"saw"), *MESSAGES]))
    out = str(tmp_path / "out")
    # equal lengths: the source given first counts, not the one whose name does
    stats = build(spark, [str(tmp_path / "b.mbox"), str(tmp_path / "a.mbox")], out, now="t1", limit=3, by_year=False, by_account=False, block_remote=False)
    assert (stats.added, stats.attachments) == (3, 2)
    rows = spark.read.parquet(out + "/messages").select("path", "uid", "message_id").collect()
    uid = next(r["uid"] for r in rows if r["message_id"] == "r@x")
    assert {r["path"] for r in rows} == {"b", "a"}
    html = page_html(spark, out, uid)
    files = {r["path"]: bytes(r["payload"]) for r in spark.read.parquet(out + "/files").collect()}
    assert sorted(files) == [f"attachments/{uid[:2]}/{uid}/p-2.gif", f"attachments/{uid[:2]}/{uid}/p.gif"] and all(p in html for p in files) and 'src="http://t.example/p.gif"' in html and "see" in html
    assert f'src="attachments/{uid[:2]}/{uid}/p-2.gif"' in html and len(set(files.values())) == 2


def test_stream_is_idempotent(spark, sources, tmp_path):
    from postquarry.streaming.ingest import ingest

    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.mbox").write_bytes(box(MESSAGES[:2]))
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    ingest(spark, str(drop), store, check).awaitTermination()
    (drop / "b.mbox").write_bytes(box())
    ingest(spark, str(drop), store, check).awaitTermination()
    assert spark.read.parquet(store).select("uid").distinct().count() == spark.read.parquet(store).count() == 4


def test_registered_functions(spark):
    from postquarry.functions.registry import register

    register(spark)
    row = spark.sql("select mail_fold('Ünïcode ﬁ') f, mail_tokenize('a.b@c.example x') t, mail_strip_tags('<p>a</p><script>x</script>b') s, mail_sanitize('<b onclick=x>y</b>').html h, mail_parse_addresses('A <a@b.c>') a, mail_parse_date('Mon, 1 Jan 2001 10:00:00 +0100').date_offset_s d").first()
    assert (row.f, row.s, row.h, row.a[0].addr, row.d) == ("unicode fi", "a\nb", "<b>y</b>", "a@b.c", 3600)
    assert row.t == ["a.b", "c.example", "example"]
    spark.createDataFrame([(box(),)], "c binary").createOrReplaceTempView("packed")
    assert spark.sql("select count(*) n from packed, lateral mbox_messages(c)").first().n == 4
    assert spark.sql("select m.subject from packed, lateral mbox_messages(c) x, lateral mime_message(x.raw) m").count() == 4


def test_every_message_is_written_and_parsed(spark, tmp_path):
    import email
    import hashlib
    import re
    from email import policy

    from pyspark.sql import functions as F

    from postquarry.plans.archive_queries import mime_roundtrip, written_message

    long = "Größere Sendung für München 😀 " * 9 + "Ende"
    rows = [
        (1, "A@X.example", long, "Grüße\r\nJo\n" * 40), (2, "b@x.example", "=?utf-8?q?literal?=", "From x\n.\n"), (3, None, None, None), (4, "c@x.example", "", ""), (5, None, "  two\nlines\t", " \n "),
        (6, "d@x.example", "plain", "x" * 20_000), (7, "", "Сводный почтамт", "é" * 57),
    ]
    m = spark.createDataFrame(rows, "read_ord bigint, from_addr string, subject string, body_text string")
    m.write.parquet(str(tmp_path / "messages.parquet"))
    got = {r["read_ord"]: r for r in mime_roundtrip(spark, str(tmp_path)).collect()}
    raw = {r["read_ord"]: bytes(r["raw"]) for r in m.select("read_ord", written_message(F.col("from_addr"), F.col("subject"), F.col("body_text")).alias("raw")).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert len(got) == len(rows)
    for k, sender, subject, body in rows:
        read = email.message_from_bytes(raw[k], policy=policy.compat32)
        assert read.get_payload(decode=True).decode() == (body or "") and max(map(len, raw[k].split(b"\n"))) <= 85
        assert read["From"] is None if sender is None else read["From"] == f"<{sender}>"
        want = re.sub(r"[\r\n\t]+", " ", subject or "").strip()
        assert str(email.header.make_header(email.header.decode_header(read["Subject"] or ""))) == (subject or "")
        assert (got[k]["subject_digest"], got[k]["sender"], got[k]["body_digest"]) == (md5(want), (sender or "").lower(), md5((body or "").strip()))


def plainly_split(raw):
    """Lines of a mailbox, divided by the rule as it is stated."""
    out, held, last = [], b"", b"\n"
    for line in io.BytesIO(raw):
        if line.startswith(b"From ") and (last in (b"\n", b"\r\n") or mailbox._ENVELOPE.match(line)):
            out, held = out + [held], b""
        else:
            held += line
        last = line
    return [x for x in [*out, held] if x]


def test_ranges_of_a_mailbox_give_each_message_once():
    rng = random.Random(4)
    pieces = [b"From a@b Mon Jan  1 00:00:00 2001\n", b"From here on\n", b"From x\r\n", b"Subject: y\n", b"\n", b"\r\n", b"text\n", b">From z\n", b" From w\n", b"From", b"long " * 40 + b"\n"]
    for _ in range(300):
        raw = b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        want = plainly_split(raw)
        assert list(mailbox.split_mbox(io.BytesIO(raw))) == want
        step = rng.randint(1, 90)
        got = [x for a in range(0, max(1, len(raw)), step) for x in mailbox.mailbox_parts(io.BytesIO(raw), a, a + step)]
        assert [x for _, x in got] == want and [a for a, _ in got] == sorted({a for a, _ in got})
        assert all(raw[a : a + len(x)] == x for a, x in got)


def test_blocks_cut_no_message(monkeypatch):
    monkeypatch.setattr(mailbox, "BLOCK", 8)
    assert list(mailbox.split_mbox(io.BytesIO(box()))) == plainly_split(box())
    assert list(mailbox.split_mbox(io.BytesIO(b"From a\n>From b\n>>From c\nx >From d\n"), unquote=True)) == [b"From b\n>From c\nx >From d\n"]


def test_large_mailbox_is_read_in_ranges(spark, tmp_path):
    from postquarry.sources.datasource import read_mail

    many = [m.replace(b"<m", b"<n%d-" % k) for k in range(40) for m in MESSAGES]
    (tmp_path / "Big.mbox").write_bytes(box(many))
    rows = read_mail(spark, str(tmp_path / "Big.mbox"), range_bytes=700)
    assert rows.rdd.getNumPartitions() > 20
    got = rows.orderBy("pos").select("message_id", "folder").collect()
    assert [r[0] for r in got] == [f"n{k}-{i}@one.example" for k in range(40) for i in range(4)] and {r[1] for r in got} == {"Big"}


def test_one_broken_file_costs_no_other(spark, tmp_path):
    from postquarry.sources.datasource import MailReader, read_mail
    from postquarry.schema import MESSAGE

    for i in range(3):
        (tmp_path / f"{i}.eml").write_bytes(MESSAGES[i])
    (tmp_path / "1b.eml").symlink_to(tmp_path / "1b.eml")
    rows = read_mail(spark, str(tmp_path)).select("message_id", "error").collect()
    assert len({r["message_id"] for r in rows if r["error"] is None}) == 3
    assert "FileNotFoundError" in MailReader(MESSAGE, {"path": "x"}).message_file(tmp_path / "gone.eml", tmp_path)["error"]


def test_forwarded_messages_and_charsets():
    raw = b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: message/rfc822\n\nSubject: In/ner\n\nx\n--b\nContent-Type: message/rfc822\n\n\n\ny\n--b\nContent-Type: text/plain; charset=none-such\n\n\x81caf\xe9\n--b--\n"
    r = mime.from_bytes(raw)
    assert [a["filename"] for a in r["attachments"]] == ["ner.eml", "Forwarded message.eml"] and r["body_text"] == "\x81café"
    assert mime.decode_bytes("“é”".encode(), "ascii") == "“é”" and mime.decode_bytes(b"\x93x\x94", None) == "“x”" and mime.decode_bytes(b"YQ==", "base64") == "YQ=="
