import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

import pytest
import zstandard

from lorespark.llm import warc as A


class Text(HTMLParser):
    """Another way to the words of a page."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        self.words.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")
        self.words.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def response(body, kind="text/html; charset=utf-8", extra=()):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nX-Long: a\r\n  b\r\n\r\n".encode() + body
    return A.serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", A.digest(body)), *extra], block)


def test_links_headers_and_digests():
    meta, text = A.derive(response("<html lang=de><title>A &amp; B</title><p>x<b>y</b></p><!-- z --><script>no</script><a href='/q?a=1&amp;b=2'>é</a>".encode()))
    assert [meta["record_type"], text["record_type"]] == ["metadata", "conversion"] and meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>"
    assert text["block"] == "A & B\nx y\né" and "outlink: /q?a=1&b=2" in meta["block"] and "title: A & B" in meta["block"] and "language: de" in meta["block"]
    assert "payload-digest-verified: yes" in meta["block"] and "http-x-long: a b" in meta["block"] and "source-warc-payload-digest: sha1:" in meta["block"]
    for r in (meta, text):
        headers, block, after = A.parse(r["record"])
        of = dict(headers)
        assert after == len(r["record"]) and block.decode() == r["block"] and of["WARC-Block-Digest"] == A.digest(block) == r["block_digest"]
        assert of["WARC-Refers-To"] == "<urn:uuid:1>" and of["WARC-Date"] == "2020-01-01T00:00:00Z" and int(of["Content-Length"]) == len(block) == r["content_length"]
    assert meta["record_id"] != text["record_id"] and A.derive(response(b""))[1]["content_length"] == 0
    assert A.derive(response("ü".encode("latin-1"), "text/html; charset=iso-8859-1"))[1]["block"] == "ü"
    assert A.derive(A.serialize([("WARC-Type", "request")], b"x")) == []


def test_files_and_broken_records(spark, tmp_path):
    one, two = response(b"<p>1"), response(b"<p>2")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    df = A.read_warc(spark, f"file://{tmp_path}/*")
    assert df.count() == 4
    assert sorted(r.block for r in A.derivatives(df, "path", "record").filter("record_type = 'conversion'").collect()) == ["1", "1", "2", "2"]
    bad = spark.createDataFrame([(1, None, "k"), (2, bytearray(b"junk"), "k"), (3, bytearray(one[:-20]), "k")], "i int, record binary, block string")
    assert [r.record_type for r in A.derivatives(bad, "i", "record").collect()] == ["error"] * 3
    assert A.derivatives(bad.limit(0), "i", "record").count() == 0


def test_pages_with_nulls(spark):
    rows = [(1, None, None), (None, "http://a/\r\nX: y", "<p>é</p>"), (2, "u", ""), (2, "u", "")]
    got = A.derivatives(A.responses(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "record").collect()
    assert len(got) == 8 and {r.record_type for r in got} == {"metadata", "conversion"}
    assert [r.block for r in got if r.page_id is None and r.record_type == "conversion"] == ["é"]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = A.op1_warc_derivatives(spark, d).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.payload_digest == "sha256:" + hashlib.sha256(page.html.encode()).hexdigest()
        if r.record_type == "conversion":
            p = Text()
            p.feed(page.html)
            assert r.block.split() == "".join(p.words).split()
        else:
            assert "payload-digest-verified: yes" in r.block


def test_values_can_not_forge_fields():
    meta, text = A.derive(response(b"<title>a&#10;source-x: 1</title><a href=\"x\r\nsource-warc-record-id: forged\">l</a><a href='&#10;no: 1'>", extra=[("X-Odd", "a\x85b\x0bc")]))
    lines = meta["block"].split("\r\n")
    assert not [x for x in lines if x.startswith(("no:", "source-x:")) or "forged" in x and not x.startswith("outlink")]
    assert meta["block"].splitlines() == lines[:-1] and "outlink: x source-warc-record-id: forged" in lines


def test_bodies_are_decoded():
    page = "<p>naïve</p>".encode()
    chunked = b"5\r\n" + page[:5] + b"\r\n%x;x=1\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    kinds = [(page, ""), (gzip.compress(page), "Content-Encoding: gzip"), (zlib.compress(page), "Content-Encoding: deflate"), (zstandard.compress(page), "Content-Encoding: zstd"), (chunked, "Transfer-Encoding: chunked")]
    kinds += [(zlib.compress(gzip.compress(page)), "Content-Encoding: gzip, deflate")]
    for body, header in kinds:
        meta, text = A.derive(response(body, "text/html" + (f"\r\n{header}" if header else "")))
        assert text["block"] == "naïve" and "payload-digest-verified: yes" in meta["block"], header
    for body, kind in ((b"%PDF", "application/pdf"), (b"\x00", "image/png"), (b"<p>x", "text/html\r\nContent-Encoding: br"), (b"junk", "text/html\r\nContent-Encoding: gzip"), (b"zz\r\n", "text/html\r\nTransfer-Encoding: chunked")):
        (meta,) = A.derive(response(body, kind))
        assert meta["record_type"] == "metadata" and "no-conversion: " in meta["block"], kind
    assert A.derive(response(b"a <b> c", "text/plain"))[1]["block"] == "a <b> c"


def test_conversions_have_their_own_digests_and_the_sources_headers():
    body = "<p>é".encode()
    for r in A.derive(response(body)):
        of = dict(A.parse(r["record"])[0])
        assert of["X-Source-WARC-Payload-Digest"] == A.digest(body) and of["X-Source-WARC-Record-ID"] == "<urn:uuid:1>" == of["WARC-Refers-To"]
        assert of["WARC-Refers-To-Target-URI"] == "http://x/" and of["WARC-Refers-To-Date"] == "2020-01-01T00:00:00Z"
        assert of.get("WARC-Payload-Digest") == (A.digest("é".encode()) if r["record_type"] == "conversion" else None)


@pytest.mark.parametrize("piece", ["<a", "<!--", "<script>", "<a '", '<a "', "<title>", "<a href=", "<a \"'>", "</script", "<p title='>'>", "&lt", "<script>x</script", '<a ">'])
def test_open_markup_takes_linear_time(piece):
    began = time.process_time()
    A.Page(piece * 200_000)
    A.Page("<p>x</p>" + piece * 200_000 + ">\"'-->")
    assert time.process_time() - began < 12


def test_quotes_and_open_ends():
    assert A.Page('<p title="x>y">a</p><b>b').text == "a\nb"
    assert A.Page("<!-- a <p>b").text == "<!-- a\nb" and A.Page("1 < 2 <3 <a").text == "1 < 2 <3 <a"
    assert A.Page("<script>a<p>b").text == "a\nb" and A.Page("<SCRIPT>a</Script >b<style>c</style>d").text == "b d"
    assert A.Page("<a href=x>1</a><a class=q href='y'>2<a data-href=z>").links == ["x", "y"]
    assert A.Page('<a title="open>one</a> two').text == "one two"


def test_cut_files_keep_their_first_records(spark, tmp_path):
    one, two = response(b"<p>1"), response(b"<p>2")
    (tmp_path / "a.warc").write_bytes(one + two[:-30])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two)[:-12])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one) + b"\x1f\x8bjunk")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(one * 3))
    got = sorted((r.path.rsplit("/", 1)[1], r.error is not None) for r in A.read_warc(spark, f"file://{tmp_path}/*").collect())
    assert got == [("a.warc", False), ("a.warc", True), ("b.warc.gz", False), ("b.warc.gz", True), ("c.warc.gz", False), ("c.warc.gz", True), ("d.warc.gz", False), ("d.warc.gz", False), ("d.warc.gz", False)]


def test_many_members_take_linear_time():
    data = gzip.compress(response(b"x")) * 40_000
    began = time.process_time()
    assert sum(1 for _ in A.records(data)) == 40_000 and time.process_time() - began < 20


def test_derivatives_are_written_and_read_back(spark, tmp_path):
    made = A.derivatives(A.responses(spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}") for i in range(20)], "page_id long, url string, html string").repartition(2)), "page_id", "record")
    files = A.write_warc(made, str(tmp_path / "out"), most=2000)
    assert files.agg({"records": "sum"}).first()[0] == 40 and files.count() > 4
    back = A.read_warc(spark, f"file://{tmp_path}/out/*.warc.gz")
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in made.collect())
    A.write_warc(made, str(tmp_path / "out"), most=2000)  # again, onto the same files
    assert A.read_warc(spark, f"file://{tmp_path}/out/*.warc.gz").count() == 40
