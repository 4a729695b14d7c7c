import numpy as np
import pytest
from pyspark.sql import types as T

from lexspan.llm import html_text

PROSE = ["The committee met on Tuesday to discuss the new bridge, and decided to postpone the vote until spring.", "Residents had asked for a crossing &amp; a path; both are in the plan that was shown &mdash; at last.", "Short line."]
WANT = "\n\n".join(["Bridge vote postponed", PROSE[0], "Residents had asked for a crossing & a path; both are in the plan that was shown — at last.", "Short line."])
BODY = "<h1>Bridge  vote\n postponed</h1><p>" + "</p>\n<p>".join(PROSE) + "</p>"


@pytest.fixture(scope="module")
def tree():
    return html_text.trained()


def test_tree_learns_its_table(tree):
    table = np.array(html_text.LABELLED, dtype=float)
    assert all(tree.says(tuple(r[:-1])) == r[-1] for r in table)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{BODY}</article><footer>&copy; 2024</footer></body></html>",
        f"<body><header><h2>Site name</h2></header><div class='cookie-notice'>We use cookies to improve this site, read our policy to learn more about them.</div><main>{BODY}</main></body>",
        f"<body><div id=content>{BODY}</div><aside>Most read stories of the week and other news that you may like today</aside></body>",
        f"<body><article>{BODY}<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --></article></body>",
        f"<body><article>{BODY}<div class='ad'>Buy a new car today for less money than you would ever think.</div></article></body>",
        f"<body><article>{BODY}</article><section class='comments'><p>Great article, I agree with every word of it and said so for years!</p></section></body>",
        f"<body><article>{BODY}<form><label>Your name</label><input><p>Please leave us your address so that we can send you our letter.</p></form></article></body>",
        f"<body><article>{BODY.replace('</p>', '')}",
        f"<body><article><section class=entry-content>{BODY}</section><ul class='share'><li><a>Share</a></li></ul></article>",
        f"<body><div class='page-with-sidebar'><article>{BODY}</article><div class=sidebar><p>Most read stories of the week and other news that you may like today</p></div></div>",
        f"<body><div class='site-header-banner'><p>The best news site in the whole wide world, now also on paper</p></div><div class='modal-page'><main>{BODY}</main></div>",
        f"<body><article>{BODY}</article><div id=comments><article class=comment><p>I agree with every word of it and have said so for many years!</p></article></div>",
        f"<body><article><header><h1>Bridge  vote postponed</h1></header>{BODY[BODY.index('<p>'):]}</article><nav class='post-navigation'><a href=1>Older</a></nav>",
        f"<BODY><ARTICLE>{BODY}</ARTICLE><div style='display:none'>hidden words that nobody sees on the page at all</div>",
    ],
)
def test_pages(page, tree):
    assert html_text.main_text(page, tree) == WANT


def test_broken_and_empty(tree):
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<!-- only", tree) == ""
    assert html_text.main_text("<article><p>Cut off in the mid", tree) == "Cut off in the mid"
    assert html_text.main_text("<article><p>Text then a tag <a hre", tree) == "Text then a tag"
    assert html_text.main_text("<article><p>5 < 6 &am", tree) == "5 < 6 &am"
    long = "<article>" + "<p>word and word</p>" * 20_000
    assert html_text.main_text(long, tree).count("\n\n") == 19_999


def test_table(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "u", f"<article>{BODY}</article>", "old"), (1, "u", f"<article>{BODY}</article>", "old"), (None, None, None, None), (3, "v", "", "old")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (3, "", 0)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("visible", ["style='overflow:hidden'", 'class="overflow-hidden"', "class=hidden-xs", "aria-hidden=false", "data-hidden='1'", "title='hidden display:none'", "style='backface-visibility:hidden'"])
def test_visible_elements_that_mention_hidden(visible, tree):
    assert html_text.main_text(f"<body><div {visible}><article>{BODY}</article></div>", tree) == WANT
    assert html_text.main_text(f"<body><article {visible}>{BODY}</article>", tree) == WANT


@pytest.mark.parametrize("hidden", ["hidden", "hidden=''", "HIDDEN class=x", "style='color:red; display : none'", 'style="visibility:hidden"', "aria-hidden=true", "aria-hidden='true'"])
def test_hidden_elements(hidden, tree):
    assert html_text.main_text(f"<body><article>{BODY}<div {hidden}><p>hidden words that nobody sees on the page at all</p></div></article>", tree) == WANT


def words(n, start=0):
    return " ".join(f"w{(start + k) % 37}" for k in range(n)) + "."


def test_tree_uses_both_neighbours_and_names_once(tree):
    used = set()

    def walk(node):
        if node.at:
            used.add(node.at[0])
            walk(node.low)
            walk(node.high)

    walk(tree)
    # own words and density, words of the next block, link density of both neighbours, the part
    assert {0, 1, 3, 4, 5, 6} <= used


A, B = words(80), words(70, 5)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<form id=aspnetForm><input type=hidden><div><a href=1>Home</a> <a href=2>News</a></div><article><h1>Head</h1><p>{A}</p></article></form>", ["Head", A]),
        (f"<form id=aspnetForm><input type=hidden><div>{A}</div><div>{B}</div></form>", [A, B]),
        (f"<div>{A}</div><form><p>Please log in with your name</p><input></form>", [A]),
        (f"<article><p>{A}</p><form><p>{words(22)}</p><input></form></article>", [A]),
        (f"<div class='post tag news'><p>{A}</p></div>", [A]),
        (f"<div id='share-prices-story'><h2>Head line</h2><p>{A}</p></div>", ["Head line", A]),
        (f"<div>{A}</div><div>Yes.</div><div>{B}</div>", [A, "Yes.", B]),
        (f"<div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div><h2>Head line</h2><p>{A}</p><p>{B}</p></div><div>Imprint</div>", ["Head line", A, B]),
        (f"<div><p>{A}</p><p>Most read</p><ul><li><a>{words(16)}</a></li><li><a>{words(18)}</a></li></ul></div>", [A]),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", ["So x=2 holds."]),
        ("<article><p>See <object data=x>the fallback</object> here.</p></article>", ["See the fallback here."]),
        (f"<article><p>{A}</p><select><option>one<p>{B}</p></article>", [A, B]),
        (f"<article><p>{A} <button>Copy<p>{B}</p></article>", [A, B]),
        (f"<article><p>{A}</p><p>Buy <span hidden>unseen</span> now.</p></article>", [A, "Buy", "now."]),
    ],
)
def test_page_shapes(page, want, tree):
    assert html_text.main_text(page, tree) == "\n\n".join(want)


def test_pages_without_names_against_their_plan(tree):
    """Pages written from a plan that says which blocks are the article; no tag, class or id
    names a part, so only text tells."""
    r = np.random.default_rng(3)
    right = total = 0
    for _ in range(200):
        say = lambda low, high: words(int(r.integers(low, high)), int(r.integers(37)))
        link = lambda n: "".join(f"<li><a href=x>{say(1, 4)}</a></li>" for _ in range(n))
        article = [say(3, 9), *(say(25, 140) for _ in range(r.integers(2, 7)))]
        if r.random() < 0.5:
            article.insert(2, say(2, 7))
        parts = [(f"<ul>{link(r.integers(3, 8))}</ul>", 0), *((f"<{'h2' if len(a.split()) < 10 else 'p'}>{a}</{'h2' if len(a.split()) < 10 else 'p'}>", a) for a in article), (f"<div>{say(2, 4)}</div><ul>{link(r.integers(3, 6))}</ul>", 0), (f"<div>{say(2, 6)}</div>", 0)]
        page = "<body><div>" + "</div><div>".join(p for p, _ in parts) + "</div></body>"
        got = html_text.main_text(page, tree).split("\n\n")
        want = [a for _, a in parts if a]
        blocks = [b[0] for b in html_text.blocks(page)]
        total += len(blocks)
        kept, plan = list(got), list(want)
        for b in blocks:
            right += (b in kept) == (b in plan)
    assert right > 0.97 * total, right / total


def test_time_grows_with_length():
    import time

    took = []
    for n in (20_000, 80_000):
        page = "<div><b></i>" * n
        began = time.process_time()
        html_text.blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3
