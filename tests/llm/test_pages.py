import re
import zlib
from html import unescape

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from sondage.llm import htmltext, warc
from sondage.llm.htmltext import main_text

LONG = "A sentence that is long enough to be the text of an article. " * 3


def page(article="", **parts):
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><article>x</article>';</script></head><body>"
            + "<header><h1>Site</h1></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav>" + parts.get("before", "") + article
            + parts.get("after", "") + "<footer>&copy; all</footer></body></html>")


def test_article_without_what_surrounds_it():
    inner = (f"<h1>Title &amp; more</h1><p>Short.</p><p><b>{LONG}</b><br>next\n\tline<p>No <i>closing</i> tag &lt;here&gt;"
             "<div class='ad-box'>Buy</div><aside>Side</aside><form>Name <input> <button>Go</button></form><!-- no --><script>x()</script>"
             "<p>The end.</p><section id=comments><article class=comment><p>First!</p></article></section>")
    want = f"Title & more Short. {LONG.strip()} next line No closing tag <here> The end."
    for html in (page(f"<article>{inner}</article>"), page(f"<main>{inner}</main>"), page(f"<article>{inner}"),
                 page(f"<article>{inner}</article>", before="<div role='alert'>Cookies?</div><div class='cookie-notice'>OK</div>", after="<div id=sidebar>Links</div>")):
        assert main_text(html) == want


def test_lines_decide_where_no_article_is_marked():
    links = "".join(f"<div><a href=x>Link {k} with some words to it</a></div>" for k in range(12))
    html = page(f"<div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{links}</div>")
    assert main_text(html) == f"{LONG.strip()} {LONG.strip()}"
    assert main_text("<p>tiny</p>") == "tiny" and main_text("") == "" and main_text("plain & <b>bold</b>") == "plain & bold"


def test_stretch_decides_over_marked_teasers():
    cards = "".join(f"<article class='card'><h3><a href=x>Teaser {k}</a></h3><p>Few words.</p></article>" for k in range(3))
    links = "<div><a href=x>One</a></div><div><a href=x>Two</a></div><div><a href=x>Three</a></div>"
    body = f"<p>{LONG}</p><p>{LONG}</p>"
    want = f"{LONG.strip()} {LONG.strip()}"
    assert main_text(page(f"<div>{body}</div>{links}{cards}")) == want
    assert main_text(page(f"<main><div><h1>Head</h1>{body}</div>{links}{cards}<p>End.</p></main>")) == f"Head {want} One Two Three End."


def test_names_do_not_hide_the_wrappers_of_the_article():
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head {LONG.strip()} {LONG.strip()}"
    for tag in ("<div class='content has-sidebar'>", "<div id='main' class='no-ads'>", "<section id='search-methods'>", "<div class='legal-text'>", "<form action=x>"):
        close = "</" + re.match("<([a-z]+)", tag)[1] + ">"
        for inner in (body, f"<article>{body}</article>"):
            assert main_text(page(f"{tag}{inner}<div class='sidebar'>Side</div>{close}")).endswith(want.removeprefix("Head ")), tag
        assert main_text(page(f"{tag}<article>{body}</article><div class='sidebar'>Side</div>{close}")) == want
    # what holds little stays hidden, text in a line too, and so do comments longer than the article beside them
    assert main_text(page(f"<article>{body}<form>Name <button>Go</button></form><p class='notice'>Note<p>End <span class='share'>Share</span>here.</article>")) == f"{want} End here."
    assert main_text(page(f"<article>{body}</article><div class='related'><article>Card</article></div>")) == want
    assert main_text(page(f"<div>{body}</div><div class='comments'>{f'<p>{LONG}</p>' * 9}</div>")) == want
    assert main_text(page(f"<article>{body}<span class=share><div>x</span>y</div><p>End.</article>")).endswith("End.")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "<a href='>'>", "</a>", "<article>", "</article>", "<script>", "</script>", "<!--",
                                 "-->", "<", ">", "&amp", "&#x41;", "text ", "\n", "<br/>", "<nav>", "</nav>", "<li>", "<x y=\"", "İ"]), max_size=25).map("".join))
def test_any_soup_gives_clean_text(html):
    text = main_text(html)
    assert text == " ".join(text.split(" ")).strip() and "\n" not in text


def test_pages_match_brute_force(spark):
    """Every page of the table: its article cut out and split at block tags."""
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|div)[^>]*>", inner)
        want = " ".join(x for b in blocks if (x := re.sub(r"\s+", " ", unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", b))).strip()))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", page(f"<article><p>{LONG * 2000}</p></article>"), "x"), (2, "u", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, len((LONG * 2000).strip())]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_warc_records(spark):
    rows = [(1, "http://a/\r\nX: y", page("<article><p>Text &amp; more</p><a href='z'>l</a></article>"), "d"), (2, None, None, "d"), (2, None, None, "d"),
            (3, "u", "<p>é " + "long " * 300_000, "d"), (None, "u", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, data string")
    sources = warc.respond(df, "2024-01-01T00:00:00Z")
    old, warc.BLOCK_BYTES = warc.BLOCK_BYTES, 1000
    try:
        responses = warc.read_records(warc.pack_records(sources)).collect()
        derived = warc.read_records(warc.pack_records(warc.derive(warc.read_records(warc.pack_records(sources)))))
        out = derived.collect()
    finally:
        warc.BLOCK_BYTES = old
    assert len(responses) == 5 and len(out) == 10 and not any(r["truncated"] for r in responses + out)
    for r in responses:
        mine = [o for o in out if o["refers_to"] == r["record_id"]]
        assert {o["type"] for o in mine} == {"metadata", "conversion"}
        meta = next(o for o in mine if o["type"] == "metadata")
        text = next(o for o in mine if o["type"] == "conversion")
        fields = warc._fields(meta["block"].decode())
        payload = bytes(r["block"]).partition(b"\r\n\r\n")[2]
        assert fields["conversion"] == text["record_id"] and fields["payload-digest"] == warc.digest(payload) == r["headers"]["WARC-Payload-Digest"]
        assert fields["payload-digest-agrees"] == "true" and fields["http-content-type"] == "text/html; charset=utf-8"
        assert all(o["target_uri"] == r["target_uri"] and o["date"] == r["date"] and o["headers"]["WARC-Block-Digest"] == warc.digest(bytes(o["block"])) for o in mine)
    first = next(o for o in out if o["type"] == "conversion" and o["target_uri"] == "http://a/ X: y")
    assert first["block"].decode().split("\n") == ["T", "Site", "One", "Two", "Text & more", "l", "© all"]
    blocks = warc.derive_blocks(warc.respond(df, "2024-01-01T00:00:00Z", packed=True))
    by_rows, by_blocks = (sorted(map(tuple, x.collect()), key=repr) for x in (warc.digests(derived), warc.digest_blocks(blocks)))
    assert by_rows == by_blocks and len(by_rows) == 10 and all(r[6] for r in by_rows)
    assert warc.derive(warc.respond(df.limit(0), "x")).count() == 0


def test_warc_data():
    one = warc.serialise({"record_id": "<urn:a>", "type": "response", "headers": {"X": "1"}, "block": b"WARC/1.0 inside\r\n\r\nx"})
    two = warc.serialise({"record_id": "<urn:b>", "type": "warcinfo", "headers": {}, "block": b""})
    for data in (one + two, warc.gzip_member(one) + warc.gzip_member(two), warc.gzip_member(one + two)):
        got = list(warc.parse_records(data))
        assert [(g["record_id"], g["block"], g["truncated"]) for g in got] == [("<urn:a>", b"WARC/1.0 inside\r\n\r\nx", False), ("<urn:b>", b"", False)]
    assert [g["truncated"] for g in warc.parse_records(one[:-10])] == [True] and list(warc.parse_records(b"")) == []
    assert warc._fields("A: 1\r\n b\r\nA: 2\r\nbad") == {"A": "1 b, 2"}


def test_derivatives_keep_source_headers_and_decode_bodies():
    html = b"<title>T</title><p>Some text</p>"
    z = warc.gzip_member(html)
    for head, body in ((b"", html), (b"Transfer-Encoding: chunked\r\n", b"8;x=1\r\n" + html[:8] + b"\r\n" + b"%x\r\n" % len(html[8:]) + html[8:] + b"\r\n0\r\n\r\n"),
                       (b"Content-Encoding: gzip\r\n", z), (b"Content-Encoding: deflate\r\n", zlib.compress(html)), (b"Content-Encoding: gzip\r\n", html),
                       (b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", b"%x\r\n" % len(z) + z + b"\r\n0\r\n\r\n")):
        source = {"record_id": "<urn:a>", "type": "response", "refers_to": None, "target_uri": "u", "date": "d", "truncated": False,
                  "headers": {"WARC-Concurrent-To": "<urn:r>", "WARC-Truncated": "time"}, "block": b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body}
        [read] = warc.parse_records(warc.serialise(source))
        meta, text = [r for d in warc.derive_one(read) for r in warc.parse_records(warc.serialise(d))]
        assert text["block"] == b"T\nSome text" and read["truncated"] and meta["truncated"] and text["truncated"]
        fields = warc._fields(meta["block"].decode())
        assert fields["source-warc-concurrent-to"] == "<urn:r>" and fields["source-warc-truncated"] == meta["headers"]["WARC-Truncated"] == "time"
    cut = warc.derive_one({**source, "headers": {}, "truncated": True})
    assert [d["headers"]["WARC-Truncated"] for d in cut] == ["unspecified"] * 2


def test_records_after_broken_bytes():
    one, two = (warc.gzip_member(warc.serialise({"record_id": f"<urn:{k}>", "type": "response", "headers": {}, "block": b"x"})) for k in "ab")
    broken = one[:12] + b"\xff" * 8 + one[20:]
    for data, want in ((one + b"junk" + two, ["<urn:a>", None, "<urn:b>"]), (one + b"junk\x1f\x8b\x08" + two, ["<urn:a>", None, "<urn:b>"]),
                       (broken + two, [None, "<urn:b>"]), (one + b"\0", ["<urn:a>", None])):
        got = list(warc.parse_records(data))
        assert [g["record_id"] for g in got] == want and all(g["truncated"] == (g["record_id"] is None) for g in got)
        assert len(list(warc._derived(iter(got)))) == 2 * sum(x is not None for x in want)
