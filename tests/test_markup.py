"""Tag streams, selectors and character references: inline pages, and a parser as referee."""

import html as stdlib_html
import random
import re
from html.parser import HTMLParser

import pytest

from textlake.functions import markup as M
from textlake.functions import references as R
from textlake.functions.html import joined_text, page_paragraphs, page_title
from textlake.functions.references import decode_references
from textlake.operators import pages

SCHEMA = "page_id long, url string, html string"


def texts(spark, html, *selectors):
    df = spark.createDataFrame([(1, "u", html)], SCHEMA)
    nodes = df.select(M.text_nodes("html", M.any_pattern(selectors)).alias("nodes"))
    return nodes.select(M.selected_by("nodes", selectors).alias("t")).first().t


def test_blocks_nest_to_any_depth(spark):
    page = "<div id=main><div>a</div><p>kept?</p><div><div><p>deep <b>bold</b> end</p></div></div></div><p>outside</p>"
    assert texts(spark, page, "#main p::text") == ["kept?", "deep ", " end"]
    assert texts(spark, page, "#main p ::text") == ["kept?", "deep ", "bold", " end"]
    assert texts(spark, page, "#main ::text") == ["a", "kept?", "deep ", "bold", " end"]
    assert texts(spark, page, "div div > p::text") == ["kept?", "deep ", " end"][1:]
    df = spark.createDataFrame([(1, "u", page)], SCHEMA)
    assert pages.page_extract(df).first().content == "kept? deep end"


def test_titles_by_class_and_id(spark):
    page = "<h1 class=menu>Site name</h1><h1 class='big title'>Talk</h1><h1 id=\"page-title\">Long <i>talk</i></h1><h1 id=page-title-2>no</h1>"
    df = spark.createDataFrame([(1, "u", page)], SCHEMA)
    assert df.select(page_title("html")).first()[0] == "Talk Long"
    assert df.select(page_title("html", ["h1 ::text"])).first()[0] == "Site name Talk Long talk no"


def test_list_field_in_nested_blocks_and_order(spark):
    page = ("<div class='field field-field-speakers'><div><span><a href=/1>Ann</a></span></div><a> Bob &eacute; </a></div>"
            "<ul class=field-field-speaker><li><a>Cid<b>x</b></a></ul><a>none</a><div class=field-field-speaker-x><a>no</a></div>")
    df = spark.createDataFrame([(1, "u", page)], SCHEMA)
    assert pages.page_extract(df).first().speakers == ["cid", "ann", "bob é"]
    assert [(r.pos, r.speaker) for r in pages.page_anchor_list(df).collect()] == [(0, "cid"), (1, "ann"), (2, "bob é")]


@pytest.mark.parametrize("selector, want", [
    ("p::text", ["1", "3", "6"]), (".a::text", ["1", "2"]), (".a.b::text", ["2"]), (".b.a::text", ["2"]), ("span.b::text", ["2", "5"]),
    ("#i ::text", ["4", "5"]), ("section > p::text", ["6"]), ("section p::text", ["6"]), ("* > span::text", ["5"]), ("*::text", list("123456")),
    ("div#i.x > span.b::text", ["5"]), ("div#i.y::text", []), ("P.A::text", []), ("body p::text", []),
])
def test_selectors(spark, selector, want):
    page = ("<p class='a'>1</p><span class='b c a'>2</span><p>3</p><div id='i' class='x'>4<span class=b>5</span></div>"
            "<section><p title='>' data-class=a>6</p></section>")
    assert texts(spark, page, selector) == want


@pytest.mark.parametrize("selector", ["", "p", "::text", "> p::text", "p >::text", "p[x]::text", "a, b::text", "#a#b::text"])
def test_what_is_no_selector(selector):
    with pytest.raises(ValueError):
        M.path_pattern(selector)


def test_odd_markup(spark):
    assert texts(spark, "<P CLASS=\"x\ny\">up</P >", ".y::text") == ["up"]
    assert texts(spark, "<p class='w-1/2 m.t a#b'>x</p>", "p::text") == ["x"]  # parting signs inside a class
    assert texts(spark, "a < b <p>c < d</p>", "p::text") == ["c ", "<", " d"]
    assert texts(spark, "<p id='unpaired>x</p><p>y</p>", "p::text") == ["x", "y"]
    assert texts(spark, "<p/>a<p>b<br/>c<img src=x>d</p></i></p>e", "p::text") == ["b", "c", "d"]
    assert texts(spark, "<p>a<div>b</div>c<p>d<p>e</div>f", "p::text") == ["a", "d", "e", "f"]
    assert texts(spark, "<a title=' id=x class=y '>t</a>", ".y::text", "#x::text") == []
    assert texts(spark, "<p a=/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p/q/r/s/t/u/v/w/x/y/z class=q>t</p>", ".q::text") == ["t"]
    assert texts(spark, "", "p::text") == [] and texts(spark, None, "p::text") is None
    assert texts(spark, "<" + "a" * 50_000, "p::text") == []
    assert texts(spark, "<p>" + "<b>x</b>" * 3000 + "</p>", "p ::text") == ["x"] * 3000


class Referee(HTMLParser):
    """The same rules with a stack: (path of tag names, text) of every text node."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in M.ENDS_PARAGRAPH and "p" in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index("p"):]
        if tag not in M.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in M.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag):]

    def handle_data(self, data):
        self.out.append(("/".join(self.stack), data))

    def handle_entityref(self, name):
        self.out.append(("/".join(self.stack), f"&{name};"))

    def handle_charref(self, name):
        self.out.append(("/".join(self.stack), f"&#{name};"))


def joined(nodes):
    """Neighbouring texts of one path as one, so that cutting texts differently doesn't matter."""
    out = []
    for path, text in nodes:
        if out and out[-1][0] == path:
            out[-1] = (path, out[-1][1] + text)
        else:
            out.append((path, text))
    return out


TAGS = ["p", "div", "b", "a", "ul", "li", "article", "h1", "br", "img", "span", "section"]


def test_paths_equal_a_parser(spark):
    rng = random.Random(11)
    made = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(25)):
            tag = rng.choice(TAGS)
            parts.append(rng.choice([f"<{tag}>", f"<{tag} class='x y' title=\"a > b\">", f"</{tag}>", f"</{tag.upper()} >", f"<{tag}/>", "text", " &amp; ", "\n"]))
        made.append("".join(parts))
    made += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    df = spark.createDataFrame(list(enumerate(made)), "i int, html string")
    for r in df.select("i", M.text_nodes("html").alias("nodes")).collect():
        referee = Referee()
        referee.feed(re.sub(M.NOISE_PATTERN, "", made[r.i]))
        referee.close()
        got = [("/".join(e.split("#")[0] for e in n.path.split("/")[1:]), n.text) for n in r.nodes]
        assert joined(got) == joined(referee.out), made[r.i]


def test_references_equal_the_library(spark):
    rng = random.Random(2)
    names = [n for n in R.NAMED if n.endswith(";")]
    made = [f"a&{n} b" for n in names]
    made += ["".join(rng.choice(["&", "&#", ";", "x", " ", "&amp;", "&lt ", "&#65;", "&#x1F600;", "&#8217;", "&#150;", "é", "&nope;", "&copy; "])
                     for _ in range(rng.randrange(1, 12))) + " " for _ in range(400)]
    made += ["&#0;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000065;", "&copy 2020", "&AMP", "&amp;lt;", "", None]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    for r in df.select("i", decode_references("t").alias("d")).collect():
        want = made[r.i]
        if want is not None:
            want = stdlib_html.unescape(want)
        assert r.d == want, made[r.i]
    assert df.select(joined_text("array('a  &lt;', '\\nb')")).first()[0] == "a < b"


def test_direct_text_is_a_selector(spark):
    page = "<article><p>one <i>two</i> three<ul><li><p>four</ul></article><p>five"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None)], SCHEMA)
    assert {r.page_id: r.content for r in pages.direct_paragraph_text(df).collect()} == {1: "one three four", 2: None}
    assert df.select(page_paragraphs("html", ["article p ::text"])).first()[0] == "one two three four"


def test_gate_fields_by_selector(spark):
    rows = [(1, "https://h.example.com/en/1", "<span class='date-display-single'>Monday, en</span>"),
            (2, "https://h.example.com/en/2", "<span class='date-display-single'>fr</span>"),
            (3, "https://h.example.com/de/3", "<div class='field-field-session-slot'>9:00</div>"),
            (4, "https://h.example.com/de/4", "<div class='field-field-session-slot'></div><i class=date-display-single>de</i>"),
            (5, "https://h.example.com/en/5", "<p>en</p>"), (6, "https://h.example.com/en/6", None)]
    out = pages.page_gate(spark.createDataFrame(rows, SCHEMA), ["de"]).collect()
    assert sorted((r.page_id, r.page_key) for r in out) == [(1, "Monday, en"), (3, "")]


def test_the_page_is_folded_once(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>")], SCHEMA)
    plan = pages.page_extract(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(transform(regexp_extract_all(") == 1
