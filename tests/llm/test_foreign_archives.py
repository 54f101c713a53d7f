"""Archives written elsewhere: other record types, digests, line ends and plain files."""

import base64
import gzip
import hashlib

import pytest

from rivulet.llm import mixing, warc


def one(kind, block, *fields):
    head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{hashlib.md5(block).hexdigest()}{kind}>"), ("WARC-Date", "2020-01-01T00:00:00Z"), *fields))
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGE = b"<p>hello</p>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + PAGE


def archive(*extra):
    return [
        one("warcinfo", b"software: x\r\n"),
        one("request", b"GET / HTTP/1.1\r\n\r\n", ("WARC-Target-URI", "http://a/")),
        one("response", HTTP, ("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", sha1(PAGE))),
        one("response", HTTP.replace(b"hello", b"other"), ("WARC-Target-URI", "http://b/")),
        one("response", HTTP, ("WARC-Target-URI", "http://c/"), ("WARC-Payload-Digest", "blake2:abc")),
        one("resource", b"plain", ("WARC-Target-URI", "http://d/"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"plain").hexdigest())),
        one("revisit", b"HTTP/1.1 200 OK\r\n\r\n", ("WARC-Target-URI", "http://e/"), ("WARC-Payload-Digest", sha1(PAGE))),
        one("metadata", b"a: b\r\n"),
        *extra,
    ]


@pytest.mark.parametrize("packed", [False, True])
def test_other_records_and_digests(spark, tmp_path, packed):
    data = b"".join(gzip.compress(r) if packed else r for r in archive())
    (tmp_path / "a.warc").write_bytes(data)
    got = {r.url: r for r in warc.read_pages(spark, str(tmp_path / "a.warc")).collect()}
    assert {u: (r.record_type, r.payload) for u, r in got.items()} == {
        "http://a/": ("response", PAGE), "http://b/": ("response", PAGE.replace(b"hello", b"other")), "http://c/": ("response", PAGE), "http://d/": ("resource", b"plain"), "http://e/": ("revisit", None),
    }
    assert got["http://a/"].payload_digest == hashlib.sha256(PAGE).hexdigest() and got["http://e/"].payload_digest == sha1(PAGE)
    assert all(r.page_id is None for r in got.values())


def test_a_wrong_digest_is_refused(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(archive(one("response", HTTP, ("WARC-Payload-Digest", sha1(b"x"))))))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_pages(spark, str(tmp_path / "a.warc")).collect()


def test_records_are_dated(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", "")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "own"), date="2024-05-06T07:08:09Z")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "own").glob("*.gz"))
    assert text.count(b"WARC-Date: 2024-05-06T07:08:09Z") == text.count(b"WARC/1.1\r\n") == 3


def test_a_budget_beyond_the_repetition_limit(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "word " * 10) for i in range(30)], "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, budget=9000, max_repeats=4).collect()
    assert max(r["pass"] for r in got) == 4 and sum(r.n_tokens for r in got) == 1200
