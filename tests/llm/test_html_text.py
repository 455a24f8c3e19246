import html
import re
import time

import numpy as np

from brainweave.llm import common, html_text, html_training

SF = "/root/testdata/sf0.01"


def test_held_out_labelled_pages():
    field = html_text.trained()
    wrong = blocks = 0
    for found, labels in html_training.labelled_pages(150, seed=9):
        got = field.viterbi(field.emissions(found))
        wrong += sum(a != b for a, b in zip(got, labels))
        blocks += len(labels)
    assert wrong / blocks < 0.02


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(2)
    for n in range(1, 7):
        field = html_text.Field({}, np.zeros((0, 2)), rng.normal(size=(2, 2)))
        emit = rng.normal(size=(n, 2))
        value = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max((tuple(int(b) for b in np.binary_repr(k, n)) for k in range(2**n)), key=value)
        assert [bool(x) for x in best] == field.viterbi(emit)


def test_every_page_gives_its_article(spark):
    pages = common.table(spark, SF, "pages")
    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a> <a href=/x>More</a></nav></header><div class="cookie-notice">We use cookies to track. <button>OK</button></div>
<div id="content"><h1>A &lt;title&gt; &amp; more</h1><p>First   paragraph of the text,<br>with a break &#233;. It goes on for some words.<p>Second one, unclosed, with <a href="/y">a link</a> in it.
<ul><li>Point one of the list.<li>Point two of the list.</ul><div class="advert">Buy this now</div><p>The last paragraph has words, too.</p></div>
<div class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this text at all.</p></div></div>
<aside class="sidebar"><h3>Related</h3><a href="/z">Other article</a></aside><form><label>Search</label><input></form><footer>&copy; Us. All rights.</footer></body></html>"""


def test_a_page_with_everything():
    assert html_text.trained().main_text(PAGE).split("\n") == [
        "A <title> & more", "First paragraph of the text, with a break é. It goes on for some words.", "Second one, unclosed, with a link in it.",
        "Point one of the list.", "Point two of the list.", "The last paragraph has words, too.",
    ]


def test_places_of_blocks():
    found = html_text.blocks('<div class="navMenu x1"><odd><span id=post>a</span><p role="comments">b</div><a href=/>c</a>')
    assert [(b.text, b.place.parent, b.place.block, set(b.place.tags), set(b.place.marks), b.linked) for b in found] == [
        ("a", "span", "div", {"div", "span"}, {"nav", "menu", "post"}, 0),
        ("b", "p", "p", {"div", "p"}, {"nav", "menu", "comments"}, 0),
        ("c", "a", "-", {"a"}, set(), 1),
    ]


def test_a_megabyte_of_nested_or_unbalanced_tags_is_read_in_linear_time():
    pages = {
        "end tags without begin": ("<div>" * 3000 + "</p>" * 250_000, 0),
        "nested": ("<div class='ad-nav'>x" * 50_000, 50_000),
        "unknown names": ("".join(f"<x{i}>t<p>" for i in range(80_000)), 80_000),
        "links": ("<a>" * 330_000 + "</b>", 0),
    }
    for name, (page, n) in pages.items():
        before = time.process_time()
        found = html_text.blocks(page)
        features = sum(1 for _ in html_text.feature_names(found))
        assert (features, time.process_time() - before < 8) == (n, True), name  # a walk over the stack took minutes


def test_odd_markup():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("") == [] and text("<p>") == [] and text("<!-- <p>x</p> --> <p>y") == ["y"]
    assert text("<p>a<p>b</p></p>c") == ["a", "b", "c"]
    assert text("plain &amp; text") == ["plain & text"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert text("<style>p{}</style><SCRIPT>x</SCRIPT >z<textarea><p>t</textarea>") == ["z"]
    assert text('<div title="a > b">x</div><p class=\'q">r\'>y') == ["x", "y"]
    assert text("a < b <p>c") == ["a < b", "c"]
    assert text("<p>un<!-- c -->broken") == ["unbroken"]
    assert text("<div" + " x" * 10) == []


def test_features_read_the_whole_block():
    features = lambda text: set(next(html_text.feature_names([html_text.Block(text, html_text.Place("p", "p", frozenset({"p"})), 0)])))
    assert {"caps:0", "digits:0"} <= features("A" * 300 + "1" * 100 + "a" * 4000)
    assert {"caps:3", "digits:0"} <= features("a" * 400 + "A" * 8000)
    assert {"caps:0", "digits:2"} <= features("a" * 400 + "1" * 8000)


def test_formulas_stay_and_their_annotations_go():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2 \\tex</annotation></semantics></math>'
    assert text(f"<p>So {formula} holds.<p>Next") == ["So x=2 holds.", "Next"]


def test_nulls_long_pages_repeated_rows_and_clashing_columns(spark):
    long = "<article>" + "<p>Words of a long page, and more of them.</p>" * 20_000 + "</article>"
    rows = [(1, None, "u", 1), (2, "", "u", 1), (3, long, "u", 1), (4, PAGE, "u", 1), (4, PAGE, "u", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = sorted(html_text.extract_text(df).collect(), key=lambda r: (r.page_id, r.n_chars))
    assert [r.page_id for r in got] == [1, 2, 3, 4, 4] and [r.text for r in got[:2]] == ["", ""] and got[3] == got[4]
    assert got[2].text.count("\n") == 19_999
    assert html_text.extract_text(df.limit(0)).columns == ["page_id", "text", "n_chars"]


def test_what_stands_inside_embedded_elements_is_text():
    page = "<p>Energy <math><mi>E</mi></math> mass <noscript>one</noscript> <object>two</object> <video>three</video> <audio>four</audio> <canvas>five</canvas> end</p><script>no</script><textarea>no</textarea>"
    assert [b.text for b in html_text.blocks(page)] == ["Energy E mass one two three four five end"]
