"""HTML text, URL rules and WARC archives."""

import hashlib
import re
from base64 import b32encode

import pytest

from slotframe.llm import blocked_bloom, html_text, url_filter, warc
from slotframe.llm.html_text import main_text
from slotframe.llm.url_filter import Entry

LONG = "the quick brown fox jumps over the lazy dog and then runs far away from all the other dogs in the wide green field"


def test_article_in_tags():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x:1}}</style><script>var t="</p>";if(a<b)x();</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>ad</p> -->
    <div class="ad">Buy now, {LONG}</div><article><h1>Head &amp; Tail</h1><p><b>{LONG}<br><p>One.</p><p>A <a href=x>link</a>\n  here &lt;b&gt; &#233;</p>
    <aside>Aside {LONG}</aside><form><p>Name</p><input><button>Send</button></form></article><div class="cookie-notice">We use cookies {LONG}</div>
    <section id="comments"><p>I think {LONG}</p></section><footer>&copy; 2020 {LONG}</footer></body></html>"""
    assert main_text(page) == f"Head & Tail\n{LONG}\nOne.\nA link here <b> é"


def test_article_by_words_alone():
    links = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><h2>My day</h2><p>{LONG}</p><p>Yes.</p><p>{LONG} again</p></div><div><ul>{links}</ul></div><div>Privacy</div></body>"
    assert main_text(page) == f"My day\n{LONG}\nYes.\n{LONG} again"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<html><body></body></html>", "&", "</div></div>", "<div class='x"])
def test_pages_without_text(page):
    assert main_text(page) in ("", "<", "&")


def test_broken_pages():
    assert main_text(f"<article><p>{LONG} &amp").endswith("&")
    assert main_text(f"<article><p>{LONG}</p><p>cut <b") == f"{LONG}\ncut"
    assert main_text(f'<article><p title="a > b">{LONG}</p></article>') == LONG
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000).count("\n") == 2999
    assert len(main_text("<article><p>" + "a " * 300_000)) == 599_999


def test_markup_in_texts_does_not_stall():
    assert main_text("<article><p>" + "< " * 50_000 + LONG).endswith(LONG)
    assert main_text("<article><p " + 'a="' * 20_000) is not None


def test_tree_fits_its_table():
    assert all(html_text.keeps(html_text.tree(), r[:-1]) == bool(r[-1]) for r in html_text.LABELLED)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, text string, n long")


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{LONG}</p></article>")]
    got = sorted(map(tuple, html_text.extract_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "v", "", 0), (1, "u", LONG, len(LONG))], key=str)
    assert html_text.extract_text(pages(spark, [])).collect() == []
    whole = pages(spark, rows).selectExpr("cast(page_id AS int) AS page_id", "url", "html")
    assert sorted(map(tuple, html_text.extract_text(whole).collect()), key=str) == got


# ---- urls

URLS = [
    "http://a.org/x", "http://A.ORG", "http://a.org?x=/", "https://x.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/1", "ftp://b.com/fr/", "b.com/fr/", "http://b.com/de/x#y",
    "http://b.com/frx", "://", "x://h", "http://h.com:80/fr/", "http://a.b.c.d.e.f.com/fr/z?q#", "http:///es/", None, "", "http://É.ORG/", "http://cheap-pills.example.com/", "http://www.cheap-pills.example.net", "http://mycheap-pills.example.com/", "http://org/", "http://x/http://y.org/",
]


def judge(url, entries):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    of = lambda h, e: h == e.host or h.endswith("." + e.host)
    rules = sorted((e for e in entries if e.rule and of(host, e) and path.startswith(e.path)), key=lambda e: len(e.host + e.path))
    bare, full = re.sub(r"\.*(:(80|443)?)?$", "", re.sub("^.*@", "", host)), path or "/"
    listed = [e for e in entries if not e.rule and of(bare, e) and (e.path in ("", full) or e.path.endswith("/") and full.startswith(e.path))]
    return host, path, rules[-1].host + rules[-1].path if rules else None, rules[-1].verdict if rules else "block" if any(e.verdict == "block" for e in listed) else "allow"


def test_urls(spark):
    entries = (*url_filter.RULES, *url_filter.LISTED, Entry("h", "/deep/page7", "block"), Entry("h", "/dir/", "block"), Entry("h", "/", "allow"), Entry("i.h", "/", "block"))
    listed = url_filter.entry_table(spark, entries)
    more = ["http://h/dir", "http://h/dir/", "http://h/dir/x/y", "http://h/dirx/", "http://u:p@h:443/dir/a", "http://h.:80/deep/page7", "http://h:8080/dir/", "http://cheap-pills.example.com.:443", "http://i.h", "http://i.h?q", "http://j.i.h/x"]
    urls = [*URLS, *(f"http://www{i}.h/deep/page{i}" for i in range(50)), *more, "http://a.org/x"]
    got = url_filter.judge_urls(pages(spark, [(i, u, None) for i, u in enumerate(urls)]), listed).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [judge(u, entries) for u in urls]
    assert url_filter.judge_urls(pages(spark, []), listed).collect() == []
    empty = url_filter.judge_urls(pages(spark, [(1, "http://a.org/x", None)]), url_filter.entry_table(spark, ()))
    assert [tuple(r) for r in empty.collect()] == [(1, "a.org", "/x", None, "allow")]


def test_filter_rules_most_out_and_never_a_member(spark):
    listed = url_filter.entry_table(spark, [Entry(f"site{i}.net") for i in range(2000)])
    members = listed.select("key")
    others = spark.range(5000).selectExpr("concat('other', id, '.net') AS key")
    assert blocked_bloom.possible_hits(members, listed).count() == 2000
    assert blocked_bloom.possible_hits(others, listed).count() < 100


def test_plan_does_not_grow_with_the_list(spark):
    plans, few, many = [], [Entry(f"s{i}.net", "/p" * (i % 40)) for i in range(40)], [Entry(f"s{i}.net", "/p" * (i % 40)) for i in range(100_000)]
    urls = pages(spark, [(1, "http://s99999.net" + "/p" * 39, None), (2, "http://s99999.net" + "/p" * 38, None), (3, "http://s100000.net/p", None), (4, "http://x.s40.net/q", None)])
    for entries in (few, many):
        judged = url_filter.judge_urls(urls, url_filter.entry_table(spark, entries))
        plans.append(len(judged._jdf.queryExecution().analyzed().toString().splitlines()))
    assert [r["verdict"] for r in judged.orderBy("page_id").collect()] == ["block", "allow", "allow", "block"]
    assert plans[0] == plans[1]


# ---- archives


def test_archive(spark, tmp_path):
    big = "<p>" + "x" * 300_000
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (None, "n", "alone"), (7, "long", big), (8, "uml", "Ä\r\n\r\nWARC/1.1 🙂"), (3, "http://b/\r\nX: y", "same")]
    got = warc.page_records(pages(spark, rows)).collect()
    least = {}
    for i, _, h in rows:
        least[h or ""] = min((x for x in (least.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least[h or ""]
        want.append((i, len(data), b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, rows), path)
    full = warc.read_warc(spark, path)
    assert sorted(bytes(r["payload"]) for r in full.filter("record_type = 'response'").collect()) == sorted([b"same", b"same", b"", b"alone", big.encode(), rows[7][2].encode()])
    assert full.filter("record_type = 'revisit'").count() == 3
    assert [r["payload_bytes"] for r in full.filter("target_uri = 'long'").collect()] == [len(big) ]
    heads = warc.read_warc(spark, path, payload="none", types="response").collect()
    assert all(r["payload"] is None for r in heads) and len(heads) == 6
    import gzip

    parts = list((tmp_path / "w").glob("*.warc.gz"))
    assert parts and all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in parts)


def test_small_payloads_are_never_revisits(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r["record_id"]: r["record_type"] for r in warc.records(pages(spark, rows), least_bytes=5).collect()}
    assert got == {"urn:page:1": "response", "urn:page:2": "response", "urn:page:3": "response", "urn:page:4": "revisit"}


def test_empty_archive(spark):
    assert warc.page_records(pages(spark, [])).collect() == []


def test_unwanted_payloads_are_not_inflated():
    import io

    packed = warc.gzip_member(warc.encode_record("response", "urn:page:1", "u", None, "D", b"x" * 1_000_000))
    rejected = warc.Predicates({"warc-type": {"revisit"}})
    assert list(warc.read_records(io.BytesIO(packed * 3), rejected, True)) == []
    (one,) = warc.read_records(io.BytesIO(packed), warc.Predicates({"warc-target-uri": {"u"}}), False)
    assert one["payload"] is None and one["payload_bytes"] == 1_000_000


def test_unclosed_quotes_do_not_stall():
    page = "<article>" + '<p title="x>word</p>' * 30_000
    assert main_text(page).count("word") > 0
    assert main_text("<article>" + "<p x='" * 30_000 + f"><p>{LONG}</p>") is not None
    assert main_text("<!-" * 30_000 + "<script" * 30_000) is not None


@pytest.mark.parametrize("odd", ["<svg class=i/>", "<svg viewBox='0 0 1 1'/>", "<svg>", "<iframe src=x>", "<object data=x>", "<video-player>", "<object-view>", "<title-bar>", "<noscript>", "<canvas/>", "<svg><title/></svg>"])
def test_silent_elements_end(odd):
    """An element without an end, or a name that only begins like a silent one, takes no text with it."""
    page = f"<article><p>{LONG}</p>{odd}<p>{LONG} two</p>%s<p>{LONG} three</p></article>"
    assert main_text(page % "") == f"{LONG}\n{LONG} two\n{LONG} three"
    name = re.match(r"<([a-z]+)", odd)[1]
    if name != "title":  # one that ends, after one that doesn't
        assert main_text(page % f"<{name} id=y><g>inside</g></{name}>") == f"{LONG}\n{LONG} two\n{LONG} three"


def test_formulas_stay():
    page = f"<article><p>{LONG} <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>x=2</annotation></semantics></math> holds.</p><math/><p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG} x=2 holds.\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p>" + "<svg>" * 30_000 + f"<p>{LONG}</p>") == f"{LONG}\n{LONG}"


def test_marks_on_leaves_and_wrappers():
    page = f"""<body><div class="content has-sidebar"><p>{LONG}</p><p class="advert">{LONG} ad</p><div class="entry-content"><p>{LONG} two</p><p hidden>{LONG} hidden</p></div>
    <ul><li class="comment">{LONG} comment</li></ul><div style="display: none"><p>{LONG} none</p></div><div class="post-comments"><p>{LONG} more</p></div></div><div id="rightSidebar">{LONG}</div></body>"""
    assert main_text(page) == f"{LONG}\n{LONG} two"


def test_wrappers_around_an_article_are_no_boilerplate():
    text = "".join(f"<p>{LONG} {i}</p>" for i in range(4))
    want = "\n".join(f"{LONG} {i}" for i in range(4))
    side = f"<div class='sidebar'>{LONG} side</div>"
    for around in ("<form id='aspnetForm' method='post'>", "<div class='content-with-sidebar'>", "<div class='layout-right-sidebar'>", "<div class='page-sidebar'>"):
        assert main_text(f"<body>{around}<div>{text}</div>{side}</{around[1:5].strip()}></body>") == want
    for around in ("<div class='comments'>", "<form class='search'>", "<div class='ad'>"):
        name = around[1:5].strip()
        assert main_text(f"<body>{around}<article>{text}</article></{name}></body>") == want
        assert main_text(f"<body><article>{text}{around}<article>{LONG} more</article></{name}></article></body>") == want
    assert main_text(f"<body><div style='display:none'><article>{text}</article></div></body>") == ""
    assert main_text(f"<body><nav><article>{text}</article></nav></body>") == ""


@pytest.mark.parametrize("mark", ["section id='social-history'", "section aria-label='Search algorithms'", "div class='article-header'", "section class='warning-signs'", "section id='rail-transport'", "div data-id='comments'"])
def test_real_sections_stay(mark):
    page = f"<article><p>{LONG}</p><{mark}><h2 id='related-work'>Related work</h2><h3 id='comments'>On comments</h3><p>{LONG} two</p></{mark.split()[0]}><p>{LONG} end</p></article>"
    assert main_text(page) == f"{LONG}\nRelated work\nOn comments\n{LONG} two\n{LONG} end"


@pytest.mark.parametrize("mark", ["div class='site-header'", "div id='comments'", "div class='social-links'", "section aria-label='Related posts'", "div class='post-comments'", "div role='search'", "div class='alert-box'"])
def test_boilerplate_goes(mark):
    page = f"<article><p>{LONG}</p><p>{LONG} two</p><{mark}><p>{LONG} gone</p></{mark.split()[0]}><p>{LONG} end</p></article>"
    assert main_text(page) == f"{LONG}\n{LONG} two\n{LONG} end"


def test_much_text_outweighs_a_mark():
    much = " ".join([LONG] * 10)
    linked = " ".join(f"<a href='/{i}'>Link number {i}</a>" for i in range(100))
    assert main_text(f"<article><p>{much} 1</p><div class='related'><p>{much} 2</p></div><p>{much} 3</p></article>") == f"{much} 1\n{much} 2\n{much} 3"
    assert main_text(f"<article><p>{much} 1</p><nav>{linked}</nav><p>{much} 3</p></article>") == f"{much} 1\n{much} 3"
    assert main_text(f"<article><p>{LONG}</p></article><footer>{much}</footer>") == LONG
    assert main_text(f"<article><p>{much} 1</p><div class='cookie-notice'>{LONG}</div><p>{much} 3</p></article>") == f"{much} 1\n{much} 3"
