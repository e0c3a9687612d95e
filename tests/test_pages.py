"""Page extraction, URL keys, the page gate and link extraction (inline traps)."""

from pyspark.sql import functions as F

from textlake.functions.html import page_lang
from textlake.functions.urls import url_group_key, url_group_key_default
from textlake.operators import pages

HTML = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title>'
    '<style>p{margin:0}</style><script>var t="</p><h1>fake</h1>";</script></head><body>'
    '<nav><a href="/The">The </a><a href="https://other.example.org/x">  BOB</a>'
    '<a href="/file/doc.pdf">file</a><a href="mailto:x@y.z">mail</a></nav>'
    '<!-- <p>comment</p> --><article><h1 class="title">Big &amp; Data</h1>'
    '<p><b>Lead &lt;b&gt;.<br><p>Second   para.</p><p class="x">Third &amp;amp; end</p></article>'
    '<footer><p>foot</p></footer></body></html>'
)


NAV = ["nav a::text"]
WHOLE = ["#main p ::text", "article p ::text"]

def slot():
    return F.regexp_extract_all("html", F.lit("(</html>)"), 1)


# Two articles, a main block, upper case, single quotes, a line break inside a tag,
# a comment with an anchor, a stylesheet link and two kinds of speaker fields.
HARD = (
    "<HTML\nlang='en'><HEAD><link rel='stylesheet' href='/style.css'></HEAD><BODY>"
    "<!-- <div class='field-field-speaker'><a href='/g'>ghost</a></div> -->"
    "<H1>First</H1><h1 id=x>Second</h1>"
    "<div id='main'><p\nclass='lead'>Main text.</p></div>"
    "<article><p>One.</p></article><ARTICLE class='b'><P>Two.</P></ARTICLE>"
    "<div class='x field-field-speakers y'><a HREF='/en/../up?a=1&amp;b=2'>Ann &amp; Co</a></div>"
    "<span class='field-field-speaker'><a href=\"/file/x\">Bob</a><A href=/en/./here>Cid</A></span>"
    "<nav><a href='/up?a=1&b=2'>nav</a><area href='#top'></nav></BODY></HTML>"
)


def test_page_extract_takes_all_scopes_and_fields(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/en/1", HARD), (2, "u", None), (3, "u", "")],
                               "page_id long, url string, html string")
    out = {r.page_id: r for r in pages.page_extract(df, title=["h1::text"]).collect()}
    r = out[1]
    assert r.title == "First Second" and r.content == "Main text. One. Two."
    assert r.speakers == ["bob", "cid", "ann & co"]  # by field class, then in page order; no comment
    assert out[2].title is None and out[3].title == "" and out[3].speakers == []


def test_page_links_of_hard_markup(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/en/1", HARD)], "page_id long, url string, html string")
    got = sorted((r.href, r.target) for r in pages.page_links(df, ["example.com"]).collect())
    # no stylesheet, entities decoded, dot segments resolved, /file/ denied
    assert got == [("#top", "https://a.example.com/en/1"),
                   ("/en/../up?a=1&b=2", "https://a.example.com/up?a=1&b=2"),
                   ("/en/./here", "https://a.example.com/en/here"),
                   ("/up?a=1&b=2", "https://a.example.com/up?a=1&b=2")]


def test_page_gate_reads_single_quotes(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/en/1", HARD)], "page_id long, url string, html string")
    gate = pages.page_gate(df, ["de"], slot(), key=page_lang("html"))
    assert [r.page_key for r in gate.collect()] == ["en"]


def test_dot_segments(spark):
    from textlake.functions.urls import remove_dot_segments
    cases = {"http://h/a/b/../c": "http://h/a/c", "http://h/../up": "http://h/up", "http://h/a/./b/.": "http://h/a/b/",
             "http://h/a/..": "http://h/", "http://h/a?x=/../y": "http://h/a?x=/../y", "mailto:a@b": "mailto:a@b",
             "http://h": "http://h", "http://h/a.../b": "http://h/a.../b"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.v for r in df.select("u", remove_dot_segments(F.col("u")).alias("v")).collect()} == cases


def test_page_extract_traps(spark):
    df = spark.createDataFrame([(1, "https://2015.site.example.com/en/1", HTML)],
                               "page_id long, url string, html string")
    r = pages.page_extract(df, speakers=NAV, content=WHOLE).first()
    assert r.title == "Big & Data"
    # an unclosed <p> ends where the next begins; script/comment text never leaks
    assert r.content == "Lead <b>. Second para. Third &amp; end"
    assert r.speakers == ["the", "bob", "file", "mail"]
    assert r.link == "https://2015.site.example.com/en/1"


def test_url_keys(spark):
    urls = ["http://2015.site.de/session/x", "https://www.site.de/session/y", "http://site.de/z", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(url_group_key("u").alias("a"), url_group_key_default("u").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("2015", "2015"), ("2016", "2016"), ("", "2016"),
                                          (None, "2016")]


def test_page_gate_mismatch_and_special(spark):
    rows = [
        (1, "https://h.example.com/en/1", '<html lang="en"><p>x</p></html>'),   # agree
        (2, "https://h.example.com/fr/2", '<html lang="en"><p>x</p></html>'),   # mismatch
        (3, "https://h.example.com/de/3", '<html lang="en"><p>x</p></html>'),   # special, slot
        (4, "https://h.example.com/es/4", '<html lang="es"><p>x</p>'),          # special, no slot
        (5, "https://h.example.com/en/5", '<html><p>x</p></html>'),             # no page key
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = [r.page_id for r in pages.page_gate(df, ["de", "es"], slot(), key=page_lang("html")).orderBy("page_id")
            .collect()]
    assert kept == [1, 3]


def test_page_links_resolve_deny_allow(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/en/1?x=1", HTML)],
                               "page_id long, url string, html string")
    got = sorted((r.href, r.target) for r in pages.page_links(df, ["example.com", "example.org"])
                 .collect())
    assert got == [("/The", "https://a.example.com/The"),
                   ("https://other.example.org/x", "https://other.example.org/x")]


def test_anchor_list_positions(spark):
    df = spark.createDataFrame([(7, HTML)], "page_id long, html string")
    got = [(r.pos, r.speaker) for r in pages.page_anchor_list(df, speakers=NAV).orderBy("pos").collect()]
    assert got == [(0, "the"), (1, "bob"), (2, "file"), (3, "mail")]
    assert pages.page_anchor_list(df).schema["pos"].dataType.simpleString() == "int"
    assert F is not None


def test_direct_paragraph_text(spark):
    df = spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string")
    got = {r.page_id: r.content for r in pages.direct_paragraph_text(df).collect()}
    # "Lead" sits inside an unclosed <b>, so it is not a direct text node of a <p>;
    # the footer paragraph is outside <article>; entities are decoded.
    assert got == {1: "Second para. Third &amp; end", 2: None}


def test_page_extract_by_layout(spark):
    from textlake.functions.urls import url_lang
    layouts = pages.layout_rules(spark, [
        ("en", ["h1.title::text"], ["article p ::text"], NAV),
        ("de", ["head > title::text"], ["footer p::text"], ["nav a::text", "article b::text"])])
    df = spark.createDataFrame([(1, "https://h.example.com/en/1", HTML),
                                (2, "https://h.example.com/de/2", HTML),
                                (3, "https://h.example.com/es/3", HTML)],
                               "page_id long, url string, html string")
    out = {r.page_id: (r.title, r.content, r.speakers) for r in
           pages.page_extract_by_layout(df, layouts, url_lang(F.col("url"))).collect()}
    assert out[1][0] == "Big & Data" and out[1][1].startswith("Lead")
    assert out[2] == ("T", "foot", ["the", "bob", "file", "mail", "lead <b>."])
    assert out[3] == (None, None, None)
