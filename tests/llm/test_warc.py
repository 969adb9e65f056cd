import base64
import hashlib
from html.parser import HTMLParser

from callweave.llm.warc import LINES, derivatives, op2_warc_derivatives, parsed, plain_text, responses, serialized

HIDDEN = {"script", "style", "title", "noscript", "template"}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.deep, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag in HIDDEN
        self.parts.append("\n" if tag in LINES else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.deep -= tag in HIDDEN
        self.parts.append("\n" if tag in LINES else "")

    def handle_data(self, data):
        if not self.deep:
            self.parts.append(data)


def read(page):
    p = Plain()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x), p.links


def sha(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_query(spark, sf):
    pages = {r.url: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    d = spark.read.parquet(f"{sf}/pages.parquet")
    out = op2_warc_derivatives(spark, sf).collect()
    sources = {r.record_id: r for r in responses(d).collect()}
    assert len(out) == 2 * d.count() and len({r.record_id for r in out}) == len(out)
    for r in out:
        s = sources[r.refers_to]
        page = s.payload
        text, links = read(page)
        assert (r.target_uri, r.refers_to_date, r.source_payload_digest) == (s.target_uri, s.warc_date, sha(page.encode()))
        assert r.source_block_digest == sha(f"{s.http_head}\r\n\r\n{page}".encode())
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        if r.warc_type == "conversion":
            assert r.block == text and text
        else:
            assert [x[9:] for x in r.block.split("\r\n") if x.startswith("outlink: ")] == links
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in r.block
    assert pages


def test_round_trip(spark, sf):
    rows = serialized(op2_warc_derivatives(spark, sf)).collect()
    records = list(parsed(b"".join(bytes(r.record) for r in rows)))
    assert [(f["WARC-Record-ID"], f["WARC-Refers-To"], b.decode()) for f, b in records] == [(r.record_id, r.refers_to, r.block) for r in rows]


def test_markup():
    assert plain_text('<p>a&amp;b<b>c</b> <i title="x>y">d</i><!-- no <p> --><script>var x="</p>";</script><br/>e<style>q') == "a&bc d\ne"
    assert plain_text("") == "" and plain_text("a < b") == "a < b" and plain_text("<titled>x</titled>") == "x"
    assert plain_text("<p " + '"' * 50001) == "" and plain_text("<!--" * 20000) == ""
    assert len(plain_text("<a href=" * 20000 + "<div>" * 20000)) == 0


def test_cases(spark):
    d = spark.createDataFrame([(None, None, None, None, None, 1), ("<x>", "u", "t", "H: 1", "<p>hi", 2), ("<x>", "u", "t", "H: 1", "<p>hi", 2)], "record_id string, target_uri string, warc_date string, http_head string, payload string, block int")
    out = derivatives(d).collect()
    assert len(out) == 6 and len({r.record_id for r in out}) == 4
    assert {r.block for r in out} == {"", "hi", "source-header: H: 1\r\n"}
    assert derivatives(d.limit(0)).count() == 0


def test_header_values_stay_on_one_line(spark):
    d = spark.createDataFrame([("<x>", "http://a/\r\nWARC-Type: response\r\nX: 1", "t", "H: 1", "<p>hi")], "record_id string, target_uri string, warc_date string, http_head string, payload string")
    fields = [f for f, _ in parsed(b"".join(bytes(r.record) for r in serialized(derivatives(d)).collect()))]
    assert [f["WARC-Type"] for f in fields] == ["metadata", "conversion"]
    assert all(f["WARC-Target-URI"] == "http://a/ WARC-Type: response X: 1" for f in fields)


def test_bytes_and_given_digests(spark):
    raw = b"<p>caf\xe9 " + "é".encode() + b"</p>" * 3 + b"<p>long " + b"x" * 2_000_000
    rows = [("<a>", "u", "t", "H", raw, "sha1:GIVEN", None), ("<b>", "u", "t", "H", None, None, "md5:OTHER")]
    d = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http_head string, payload binary, source_block_digest string, source_payload_digest string")
    out = {(r.refers_to, r.warc_type): r for r in derivatives(d).collect()}
    one, two = out["<a>", "conversion"], out["<b>", "metadata"]
    assert (one.source_block_digest, one.source_payload_digest) == ("sha1:GIVEN", sha(raw))
    assert one.block.startswith("caf\ufffd é\nlong x") and len(one.block) > 2_000_000
    assert (two.source_block_digest, two.source_payload_digest) == (sha(b"H\r\n\r\n"), "md5:OTHER")
