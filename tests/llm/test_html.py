import random

import pytest



def test_html():
    from tributary.llm.html_text import page_text

    page = "<p>One<p>Two<ul><li>a<li>b<ol><li>x</ol></ul><div hidden>no</div><table><tr><td>Name<td>N<tr><td>Al<td>10</table><script>no</script>&amp; end"
    assert page_text(page) == "One\n\nTwo\n\n- a\n- b\n  1. x\n\nName | N\nAl   | 10\n\n& end"
    assert page_text(None) is None and page_text("") == "" and page_text("<div>" * 5000 + "deep") == "deep"
    assert page_text("<pre> a\n  b</pre><p style='visibility:hidden'>x<span style='visibility:visible'>y</span>") == " a\n  b\n\ny"
    assert page_text("<p>x<p>x") == "x\n\nx" and page_text("<b><!-- x -->text") == "text"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><colgroup><col><tr><td>x</table>", "x"),
        ("<table><colgroup><col><tbody><tr><td>x<td>y</table>", "x | y"),
        ("<table><colgroup>up<col><tr><td>x</table>", "up\n\nx"),
        ("<table><tr><form><td>x</td></form></tr></table>z", "x\n\nz"),
        ("<table><tbody><form><tr><td>x<td>y</tr></form></tbody></table>", "x | y"),
        ("a<table><tr>b<td>x</tr>c<tbody>d<tr><b>e</b><td>y</table>f", "abcde\n\nx\ny\n\nf"),
        ("<table><tr hidden>b<td>x</table>", "b"),
        ("<table><tr><td>x<table><tr>in<td>y</table></table>", "xin\n\ny"),
        ("<table><tr><td>x</td><table><tr><td>y</table>", "x\n\ny"),
        ("<table><tbody><tr><td>x<tbody><caption>c</caption></table>", "c\nx"),
        ("<table><tbody><div>d<tr><td>x</table>", "d\n\nx"),
    ],
)
def test_html_tables(page, text):
    from tributary.llm.html_text import page_text

    assert page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x=1 b"),
        ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>", "1 2"),
        ("<math><mtext>if <b>so</b></mtext></math> end", "if so end"),
        ("a<svg/>b<math/>c", "abc"),
        ("<p>a <svg><title>t</title><path/><text>one<tspan>two</tspan></text><text>three</text>no</svg> b</p>c", "a onetwo three b\n\nc"),
        ("<svg><defs><text>no</text></defs><desc>no</desc><foreignObject><p>yes</p></foreignObject><g/><text>t</text></svg>", "yes\n\nt"),
        ("<div><svg><path d='x'><p>after", "after"),
        ("<svg><svg><g><p>after", "after"),
        ("<div/>x<desc>y</desc><text>z</text>", "xyz"),
        ("<table><tr><svg><text>s</text></svg><td>x</table>", "s\n\nx"),
    ],
)
def test_html_svg_and_math(page, text):
    from tributary.llm.html_text import page_text

    assert page_text(page) == text


@pytest.mark.parametrize("depth", [10, 255, 256, 300, 5000, 100_000])
def test_html_of_any_depth(depth):
    from tributary.llm.html_text import page_text

    assert page_text("<div>" * depth + "<div hidden><p>secret</p></div>shown") == "shown"
    assert page_text("<b>" * depth + "<span hidden><i>secret</i></span>shown" + "</b>" * depth + "<p>after") == "shown\n\nafter"
    assert page_text("<svg>" * depth + "<g><desc>x</desc><text>t") == "t"
    assert page_text("<pre>" + "<i>" * depth + "a\n b") == "a\n b"
    if depth <= 5000:
        assert page_text("<ul><li>" * depth + "<span style='display:none'>x</span>y").strip("- ") == "y"
        assert page_text("<blockquote>" * depth + "q<p hidden>x").strip() == "q"
        assert page_text("<table><tr><td>" * depth + "c<p hidden>x").strip() == "c"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.gone, #x { display : none }</style><p class='a gone'>1<p id=x>2<p>3", "3"),
        ("<style>p.gone{display:none}.gone{display:block}</style><p class=gone>1<div class=gone>2</div>", "2"),
        ("<style>@media print{p{display:none}} @import 'x'; /* p{display:none} */ i{visibility:hidden}</style><p>a <i>b <u style='visibility:visible'>c</u></i>", "a c"),
        ("<style>.h{display:none}</style><p class=h style='display:block'>shown<p class=H>kept", "shown\n\nkept"),
        ("<p>early</p><style>p{display:none}</style>late", "late"),
        ("<style>div p{display:none} p:first-child{display:none} p{</style><p>kept", "kept"),
        ("<progress>70%</progress>done<meter>3</meter>", "done"),
    ],
)
def test_html_style_rules(page, text):
    from tributary.llm.html_text import page_text

    assert page_text(page) == text


def reference_text(page):
    """Words of a page by another parser's events: those outside unseen and hidden elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.open.append((tag, "hidden" in dict(attrs) or tag in ("script", "style", "head", "title", "noscript") or "display:none" in dict(attrs).get("style", "").replace(" ", "")))

        def handle_endtag(self, tag):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    return

        def handle_data(self, data):
            if not any(h for _, h in self.open):
                self.words += data.split()

    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader.words


def test_html_on_random_pages_through_spark(spark):
    """Well-formed random pages: all visible words, in order, and nothing else, also with null and repeated ids and extra columns."""
    from tributary.llm.html_text import extract

    r, serial = random.Random(4), iter(range(10**6))

    def node(depth):
        if depth == 0 or r.random() < 0.3:
            return f" word{next(serial)} "
        tag = r.choice(["div", "p", "span", "b", "ul", "section", "h2", "blockquote", "table"])
        mark = r.choice(["", "", "", " hidden", " style='display: none'"])
        inside = [node(depth - 1) for _ in range(r.randrange(1, 4))]
        if tag in ("p", "h2", "span", "b"):
            inside = [f" word{next(serial)} <i{mark}>word{next(serial)}</i> "]
        body = "".join(inside)
        if tag == "ul":
            body = "".join(f"<li>{x}</li>" for x in inside)
        if tag == "table":
            body = "".join(f"<tr><td>{x}</td></tr>" for x in inside)
        return f"<{tag}{mark}>{body}</{tag}>"

    pages = [(i % 50 if i % 9 else None, f"u{i}", "".join(node(6) for _ in range(4)), "x") for i in range(120)] + [(1, None, None, "x"), (1, None, "", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    strip = lambda words: [w for w in words if w.startswith("word")]
    want = sorted(((str(i), str(u), None if h is None else strip(reference_text(h))) for i, u, h, _ in pages), key=str)
    assert sorted(((str(x.page_id), str(x.url), None if x.text is None else strip(x.text.split())) for x in extract(df).collect()), key=str) == want
    assert extract(df.where("false")).count() == 0 and extract(df).columns == ["page_id", "url", "text"]
