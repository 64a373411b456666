import gzip
import hashlib

from kinograph.llm.common import scratch_path
from kinograph.llm.warc import MAGIC, read_warc, write_warc

FORGED = f"\r\n{MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n{MAGIC}\r\n{MAGIC}Content-Length: 999\r\n\r\n"
SCHEMA = "page_id long, url string, html string, payload string"


def back(spark, rows):
    path = scratch_path(spark, "warc")
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    return [(r.headers.get("warc-record-id"), r.headers["warc-type"], r.headers.get("warc-refers-to"), bytes(r.payload)) for r in read_warc(spark, path).collect()]


def test_round_trip_with_magic_in_payloads(spark):
    texts = ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, FORGED, FORGED * 12, "é" * 60, "\r\nWARC/1.0", "\r\n\r\nWARC/1.0\r\n", "end\r", "\n"]
    rows = [(i, "http://a/\r\nb" if i % 2 else None, t, "z") for i, t in enumerate(texts)] + [(None, "u", "nobody", ""), (4, "u", "y" * 100, "")]
    for split in ("128m", "1500", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(back(spark, rows), key=str)
        want = []
        for i, _, t, _ in rows:
            data = (t or "").encode()
            again = t == "y" * 100 and i != 4
            want.append((None if i is None else f"<urn:page:{i}>", "revisit" if again else "response", "<urn:page:4>" if again else "<urn:page:8>" if t == FORGED * 12 and i != 8 else None, b"" if again else data))
        assert got == sorted(want, key=str), split
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_and_digest(spark):
    assert back(spark, []) == []
    (row,) = back(spark, [(1, "u", "t" * 500, None)])
    assert hashlib.sha256(row[3]).hexdigest() == hashlib.sha256(b"t" * 500).hexdigest()


def test_damage_ends_the_chain(spark, tmp_path):
    good = MAGIC + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = MAGIC + "WARC-Type: response\r\nContent-Length: 4\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good + good + bad + good).encode())
    (tmp_path / "b.warc").write_bytes((good + good)[:-10].encode())
    (tmp_path / "c.warc").write_bytes(b"nothing " + good.encode())
    got = [(r.file[-6:], r.pos) for r in read_warc(spark, f"file://{tmp_path}").collect()]
    n = len(good)
    assert sorted(got) == [("a.warc", 0), ("a.warc", n), ("a.warc", 2 * n), ("b.warc", 0)]


def test_long_urls_lose_no_page(spark):
    urls = ["http://a/", "data:" + "u" * 100_000, "http://b/", "data:" + "é" * 300_000, None, "http://c/"]
    rows = [(i, u, f"page {i} " * 30 + FORGED, "z") for i, u in enumerate(urls)]
    for split in ("128m", "50000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = scratch_path(spark, "warc")
        write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
        got = sorted((r.headers["warc-record-id"], r.headers.get("warc-target-uri"), bytes(r.payload).decode()) for r in read_warc(spark, path).collect())
        assert got == [(f"<urn:page:{i}>", u, t) for i, u, t, _ in rows], split
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gzip_archives(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 40 + FORGED, "z") for i in range(30)]
    path = scratch_path(spark, "warc")
    write_warc(spark.createDataFrame(rows, SCHEMA), path, compression="gzip")
    read = lambda where: sorted((r.headers["warc-record-id"], bytes(r.payload).decode()) for r in read_warc(spark, where).collect())
    want = sorted((f"<urn:page:{i}>", t) for i, _, t, _ in rows)
    assert read(path) == want
    members = b""
    for i, _, t, _ in rows:  # one member a record, as crawls have them
        members += gzip.compress(f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(t.encode())}\r\n\r\n{t}\r\n\r\n".encode())
    (tmp_path / "crawl.warc.gz").write_bytes(members)
    assert read(f"file://{tmp_path}") == want


def test_many_copies_shuffle_their_payloads_only(spark, monkeypatch):
    monkeypatch.setattr("kinograph.llm.warc.BROADCAST_ROWS", 0)
    rows = [(i, "u", "same " * 50 if i % 3 == 0 else f"own {i} " * 50, "z") for i in range(60)]
    got = sorted((r[0], r[1], r[2]) for r in back(spark, rows))
    assert got == sorted((f"<urn:page:{i}>", "revisit" if i % 3 == 0 and i else "response", "<urn:page:0>" if i % 3 == 0 and i else None) for i in range(60))
