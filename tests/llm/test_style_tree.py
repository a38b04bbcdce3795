"""Main texts of pages: markup by example, importance against the recursive definition."""

import math
import random
from collections import Counter, defaultdict

import pytest

from recollect.llm import style_tree
from recollect.llm.queries import QUERIES

from .conftest import prose

PAGES = "page_id long, url string, html string"

# (html, text)
MARKUP = [
    (None, ""),
    ("", ""),
    ("plain  words\n only", "plain words only"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\n\nfour"),
    ("<p>a &lt; b &amp;&amp c &eacute;&#233;&#xe9; &nbsp; &bogus; &am</p>", "a < b && c ééé &bogus; &am"),
    ("<p>x<!-- <p>no</p> --->y<!-->z</p>", "xyz"),
    ("<p>1 < 2 <3 a<b>c</b></p>", "1 < 2 <3 ac"),
    ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes", "yes"),
    ("<p>cut off <b>here <i", "cut off here"),
    ("<p>a</span></div></p></p>b", "a\n\nb"),
    ("<script>never ends <p>no", ""),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"),
    ("<p title='a > b' data-x=\"</p>\">t</p><p class=x>u", "t\n\nu"),
    ("<NAV>menu</NAV><ARTICLE><H1>Title</H1>body<BR>more</ARTICLE><footer>foot</footer>", "Title\n\nbody more"),
    ("<header>site</header><article><header><h1>t</h1></header><p>b</p><footer>f</footer></article>", "t\n\nb"),
    ("<div class='side-bar ad-box'>ad</div><div class=shadow>kept</div><div class='Cookie_Notice'>no</div>", "kept"),
    ("<p>a <span class=share>like!</span> b <a href=x>link</a></p>", "a b link"),
    ("<div>before<span class=ad><div>no</div></span>after</div>", "before\n\nafter"),
    ("<form><p>no</p></form><div hidden>no</div><div style='display: none'>no</div><div role=search>no</div><p>y", "y"),
    ("<main><section id=comments><p>no</p></section><p>y</p><textarea><p>no</textarea></main>", "y"),
    ("<article><p>y</p><div class='reader-comments'><p>no</p></div><aside>no</aside></article>", "y"),
    ("<head><title>no</title><meta charset=utf-8><body class='has-sidebar'><p>y", "y"),
    ("<div class=a id=''>x</div><svg><path/><text>no</text></svg>y<noscript><p>no</noscript>", "x\n\ny"),
    ("<p>a  b\x85c\td</p>", "a b c d"),
    ("<![CDATA[ no ]]><!doctype html><?php no ?></ no>y", "y"),
    ("<div>" * 300 + "deep" + "</div>" * 300 + "<p>end", "deep\n\nend"),
    ("<p x='" + "a" * 50_000 + "'>long <p y=\"open>z", "long\n\nz"),
    ("<article><pre>a\n   b</pre>" + "<p>w</p>" * 2000, "a b" + "\n\nw" * 2000),
]


def texts(frame):
    return {r.page_id: r.text for r in frame.collect()}


def test_markup(spark):
    rows = [(i, f"http://h{i}.example/", html) for i, (html, _) in enumerate(MARKUP)]
    got = style_tree.main_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    for r in got:
        assert (r.text, r.n_chars, r.url) == (MARKUP[r.page_id][1], len(MARKUP[r.page_id][1]), rows[r.page_id][1]), rows[r.page_id]
    assert len(got) == len(rows)


def site(host, n, seed=0, frames=2):
    """Pages without any telling name: a frame of few variants around prose that differs."""
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        paragraphs = [prose(seed * 1000 + 10 * i + j, 8) for j in range(rng.randrange(1, 5))]
        top = f"<div class=x1><span>Home of {host} {rng.randrange(frames)}</span><div><ul><li>a<li>b</ul></div></div>"
        body = f"<div class=x2><h2>{paragraphs[0]}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:]) + "</div>"
        rows.append((seed * 1000 + i, f"https://{host}:80/p/{i}", top + body + "<div class=x3>All rights kept</div>"))
        want[seed * 1000 + i] = "\n\n".join(paragraphs)
    return rows, want


def test_frames_without_names_go(spark, monkeypatch):
    monkeypatch.setattr(style_tree, "MANY", 10)
    monkeypatch.setattr(style_tree, "SPREAD", 3)
    big, want = site("big.example", 40, 1)
    small, want_small = site("small.example", 6, 2, frames=1)
    got = texts(style_tree.main_text(spark.createDataFrame(big + small, PAGES).repartition(4)))
    assert got == want | want_small


def test_copies_keep_their_text(spark):
    rows = [(i, "http://copies.example/", "<div><p>The same text.</p><p>Again.</p></div>") for i in range(9)]
    assert set(texts(style_tree.main_text(spark.createDataFrame(rows, PAGES))).values()) == {"The same text.\n\nAgain."}


def test_repeated_passages_in_articles_stay(spark):
    rows = [(i, "http://h.example/", f"<nav>{i}</nav><article><p>A passage that all share.</p><p>{i}</p></article>") for i in range(9)]
    got = texts(style_tree.main_text(spark.createDataFrame(rows, PAGES)))
    assert got == {i: f"A passage that all share.\n\n{i}" for i in range(9)}


def by_definition(htmls):
    """Composite importance of each merged element, top down, page by page."""
    pages = [style_tree.Page(h) for h in htmls]
    having = defaultdict(list)
    for page in pages:
        for key, node in page.nodes.items():
            having[key].append([c.key for c in node.children])
    m = {key: len(styles) for key, styles in having.items()}
    features = defaultdict(lambda: defaultdict(Counter))
    for i, page in enumerate(pages):
        for node, _, text in page.blocks:
            features[node.key][text][i] += 1

    def entropy(parts, base):
        total = sum(parts)
        return -sum(p / total * math.log(p / total, base) for p in parts)

    def own(key):
        if m[key] == 1:
            return 1.0
        if key in features:
            found = features[key].values()
            return 1 - sum(entropy(list(c.values()), m[key]) for c in found) / len(found)
        return entropy(list(Counter(map(tuple, having[key])).values()), m[key])

    def composite(key):
        if key in features:
            return own(key)
        styles = Counter(map(tuple, having[key]))
        passed = 0.9 ** len(styles)
        below = sum(n / m[key] * sum(map(composite, s)) / len(s) for s, n in styles.items() if s)
        return (1 - passed) * own(key) + passed * below

    return {style_tree._hash(key): (m[key], composite(key)) for key in having}


@pytest.mark.parametrize("seed", [3, 4])
def test_importance_equals_its_definition(spark, seed):
    rows, _ = site("a.example", 12, seed, frames=3)
    rows += [(5000, "http://a.example/", "<div class=x2><p>one</p></div><div class=x9></div>"), rows[0]]
    trees = style_tree.parsed(spark.createDataFrame(rows, PAGES).repartition(2))
    got = {r.node: (r.m, r.importance) for r in style_tree.importance(trees).collect()}
    want = by_definition([r[2] for r in rows])
    assert got.keys() == want.keys()
    for node, (m, value) in want.items():
        assert got[node][0] == m and got[node][1] == pytest.approx(value, abs=1e-9)


def test_null_and_repeated_rows(spark):
    rows = [(None, None, "<p>x</p>"), (None, "no host", "<p>x</p>"), (1, "http://h.example", None), (1, "http://h.example", "<p>y")]
    frame = spark.createDataFrame(rows * 2, PAGES).selectExpr("*", "url as uid", "url as host", "html as text", "html as nodes")
    got = sorted(map(repr, map(tuple, style_tree.main_text(frame).collect())))
    want = [(None, None, "x", 1), (None, "no host", "x", 1), (1, "http://h.example", "", 0), (1, "http://h.example", "y", 1)]
    assert got == sorted(map(repr, want * 2))
    assert style_tree.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_articles_of_the_table(spark):
    import html as entities
    import re

    sf = "/root/testdata/sf0.001"
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op12_html"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
