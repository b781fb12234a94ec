"""Broken, deep and compressed pages: linear time, the web's charsets, bounded decompression."""

import gzip
import time
import zlib

import pytest

from solvara.llm import warc


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<title ", "<div>", "<div>x", "<p ", "<!doctype ", "<html ", '<a href="', "<a href='", "<", "<script ", "<!--", "<a href    ", "<a <b <i "])
@pytest.mark.parametrize("end", ["", ">"])
def test_a_megabyte_takes_under_two_seconds(piece, end):
    page = piece * (10**6 // len(piece)) + end
    start = time.process_time()
    warc.derive_record({"warc-type": "response", "warc-record-id": "<urn:x>", "warc-target-uri": "http://a/"}, warc.http_block(page.encode()))
    assert time.process_time() - start < 4  # twice the bound, for slow machines


def test_titles_and_links_of_odd_tags():
    page = '<HTML x=1 lang=de><title a="1"> One &amp; two </title><title>no</title><a class="x" href="/y?a=1&amp;b=2">t</a><a title="a < b" href=z>u</a><a <img src=p.png><a href="#top">'
    assert warc.title_of(page) == " One &amp; two " and warc.title_of("<title>open") is None
    assert warc.links(page, "http://h/d/") == ["http://h/y?a=1&b=2 a/@href", "http://h/d/z a/@href", "http://h/d/p.png img/@src"]
    assert warc._LANG.search(page)[1] == "de"


@pytest.mark.parametrize("name", ["idna", "undefined", "unicode_escape", "raw_unicode_escape", "punycode", "hex", "base64", "rot13", "utf-7", "mbcs", "nonsense"])
def test_only_charsets_of_the_web(name):
    body = rb"<p>aA " + "é".encode()
    assert warc.decode(body, f"text/html; charset={name}") == (body.decode(), "utf-8")
    assert warc.decode(f'<meta charset="{name}">é'.encode(), "")[1] == "utf-8"
    warc.derive_record({"warc-type": "response", "warc-record-id": "<urn:x>"}, warc.http_block(body, f"text/html; charset={name}"))


def test_charsets_of_the_web_are_read():
    assert all(warc.decode("abc".encode("utf-8"), f"text/html; charset={name}")[1] == name for name in warc.CHARSETS)
    assert warc.decode("Привет".encode("windows-1251"), "text/html; charset=Windows-1251") == ("Привет", "windows-1251")


def test_bodies_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(warc, "BODY_BYTES", 10_000)
    zstandard = pytest.importorskip("zstandard")
    for size in (10_000, 10_001, 5_000_000):
        raw = b"x" * size
        for name, packed in (("gzip", gzip.compress(raw)), ("deflate", zlib.compress(raw)), ("zstd", zstandard.ZstdCompressor().compress(raw))):
            assert warc.unpacked(packed, name) == ((raw, "") if size <= 10_000 else (b"", name))


def test_members_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1_000_000)
    record = lambda n: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + b"y" * n + b"\r\n\r\n"
    data = gzip.compress(record(10)) + gzip.compress(record(200_000_000)) + gzip.compress(record(20))
    got = [(len(block), problem) for _, block, problem in warc.from_bytes(data)]
    assert (10, "") in got and (20, "") in got and any("too large" in p for _, p in got)
