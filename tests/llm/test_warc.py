import base64
import gzip
import hashlib
import random

import pytest

from tidemark.llm import warc
from tidemark.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, n string"


def brute(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    owner = {}
    for k, (i, d) in enumerate(data):
        if len(d) >= least and (d not in owner or i > data[owner[d]][0]):
            owner[d] = k
    out = []
    for k, (i, d) in enumerate(data):
        digest = base64.b32encode(hashlib.sha1(d).digest()).decode()
        first = owner.get(d, k)
        out.append((i, len(d), digest, "response" if first == k else "revisit", None if first == k else data[first][0]))
    return sorted(out, key=str)


def pages(seed=1, n=120):
    rnd = random.Random(seed)
    bodies = ["", "WARC/1.0\r\n\r\nWARC-Type: response\r\n\r\n", "<html>\r\n\r\n</html>", "ü€😀\x00\n\n", "\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\nx"] + [f"<p>{rnd.random()}</p>\r\n" * rnd.randrange(1, 30) for _ in range(50)]
    urls = ["http://a.example/x?y=1", None, "", "no url at all", "https://b.example/ü b\r\nWARC-Type: evil", "http://[bad"]
    return [(i, rnd.choice(urls), rnd.choice(bodies)) for i in range(n)] + [(500, None, None)]


@pytest.mark.parametrize("least", [0, 25])
def test_round_trip_equals_brute_force(spark, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in warc.archive_and_read(df, least).collect()]
    assert sorted(got, key=str) == brute(rows, least)


def test_nested_captures_carry_payload_and_both_sides(spark):
    rows = pages(3, 30)
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA), path, records_per_file=20)
    found = warc.captures(warc.read_records(spark, path)).collect()
    assert len(found) == len(rows)
    text = {i: (h or "").encode() for i, _, h in rows}
    for r in found:
        page = int(r["metadata"]["head"].split(": ")[1])
        if r["capture"]["type"] == "response":
            assert bytes(r["capture"]["payload"]) == text[page]
        assert r["request"]["head"].startswith("GET ") and r["metadata"]["record_id"] != r["request"]["record_id"]


def test_repeated_rows_are_captures_of_their_own(spark):
    rows = [(7, "http://a.example/", "same"), (7, "http://a.example/", "same"), (3, None, "same"), (None, None, "other")]
    got = sorted((tuple(r) for r in warc.archive_and_read(spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA)).collect()), key=str)
    kinds = [(r[0], r[3], r[4]) for r in got]
    assert sorted(kinds, key=str) == sorted([(7, "response", None), (7, "revisit", 7), (3, "revisit", 7), (None, "response", None)], key=str)


def test_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damaged_archives_are_refused():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Type: application/http\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="SHA-1"):
        list(warc._parse(record))
    with pytest.raises(ValueError, match="ends within"):
        list(warc._parse(record[:-8]))


def test_a_gzip_member_for_each_record(spark):
    """As most crawlers write them; field names in any case, without the blank, continued; other digests and types."""
    body = b"<p>body</p>"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: \xff\r\n\r\n" + body
    heads = [
        ("warcinfo", b"content-type:application/warc-fields\r\n", b"software: x\r\n"),
        ("response", f"Content-Type: Application/HTTP; msgtype=response\r\nwarc-payload-digest:sha1:{sha}\r\nWARC-Target-URI: http://a\r\n /b\r\n".encode(), http),
        ("response", b"Content-Type: application/http\r\nWARC-Payload-Digest: md5:abc\r\n", http),
        ("response", b"Content-Type: text/dns\r\n", b"a. 1 IN A 1.2.3.4"),
        ("resource", b"", b"\x00\xff" * 5),
    ]
    records = [f"WARC/1.1\r\nWARC-TYPE: {kind}\r\nWARC-Record-ID: <{n}>\r\n".encode() + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n" for n, (kind, more, block) in enumerate(heads)]
    path = new_path(spark, "warc-members")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/a.warc.gz")
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(b"".join(map(gzip.compress, records))))
    out.close()
    got = {r["record_id"]: r for r in warc.read_records(spark, path).collect()}
    assert [got[f"<{n}>"]["type"] for n in range(5)] == [h[0] for h in heads]
    assert [None if got[f"<{n}>"]["payload"] is None else bytes(got[f"<{n}>"]["payload"]) for n in range(5)] == [None, body, body, b"a. 1 IN A 1.2.3.4", b"\x00\xff" * 5]
    assert got["<1>"]["target_uri"] == "http://a /b" and got["<1>"]["payload_digest"] == sha and got["<2>"]["payload_digest"] == "md5:abc"
    assert [r[0] for r in warc._parse(b"".join(records))] == [f"<{n}>" for n in range(5)]
    assert list(warc._parse(gzip.compress(b""))) == []
    with pytest.raises(EOFError):
        list(warc._parse(gzip.compress(records[1])[:-12]))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc._parse(b"text" + records[0]))
