import collections
import math
import random
import time

import pytest

from tessera.llm import html_text

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{color:red}</style><script>var a = "<p>no</p>";</script></head>
<body class="no-sidebar has-menu"><header class="site-header"><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav></header>
<div id="cookie-consent">We use cookies <button>OK</button></div><!-- a comment <p>hidden</p> -->
<div class="ad-slot">Buy now</div>
<main><article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>First  para
with&nbsp;<b>bold</b>, caf&eacute; &#8212; end.</p>
<p>Second<br>line <i>unclosed
<ul><li>one<li>two</ul>
<aside>Related: x</aside><div class="share">Tweet</div><form><label>Mail</label><input></form>
<blockquote>Quote &lt;tag&gt; &quot;q&quot;</blockquote><script>track()</script><p style="display: none">unseen</p>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I disagree</p></article></section>
<footer>By me</footer></article></main>
<aside class="sidebar">Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para with bold, café — end.\n\nSecond line unclosed\n\none\n\ntwo\n\nQuote <tag> \"q\""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>one <span>two</span> three</div>", "one two three"),
        ("<div><div class=menu><a>x</a></div><p>body text</p></div>", "body text"),
        ("<div><a href=1>Home</a> <a href=2>About</a></div><p>body with <a>link</a> in it</p>", "body with link in it"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<p>open <b>tag", "open tag"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ('<p title="a > b">t</p>', "t"),
        ("<script>if (a < b) { '</p>' }</script><p>x</p><style>y", "x"),
        ("<article><b><p>x</b> y</p></article>", "x y"),
        ("<nav><p>x</p></nav>", ""),
        ("<noscript><p>on</p></noscript><p>z</p>", "z"),
        ("<p>a</p></div></div><p>b</p>", "a\n\nb"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<div role=navigation>n</div><div role=main><p>r</p></div>", "r"),
        ("<p>&notanentity; &amp;amp; &#x41;</p>", "¬anentity; &amp; A"),
    ],
)
def test_fragments(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_broken_nesting():
    assert html_text.main_text("<div><b>" * 20_000 + "deep" + "</b></div>" * 20_000 + "<p>end</p>").split("\n\n") == ["deep", "end"]
    assert html_text.main_text("<p>" * 5000 + "x" + "</i>" * 5000) == "x"
    assert html_text.main_text("<" * 3000 + "y") == "<" * 3000 + "y"
    assert html_text.main_text('<p class="' + "a" * 100_000 + "<p>z").endswith("z")


SCHEMA = "page_id long, url string, html string, host string, low string, n_chars int"


def test_site_tree_cuts_what_a_site_repeats(spark):
    """Blocks with names that say nothing go where they repeat over a site, and only there; copies keep their article."""
    page = lambda i, box: f"<body><div class=x9><span>{box}</span></div><div class=c1><p>words {i} of the text {i * i}</p></div></body>"
    rows = [(i, "https://a.example/p/%d" % i, page(i, "Same box"), "h", "l", 1) for i in range(12)]
    rows += [(100 + i, "http://b.example/%d" % i, page(i, f"box {i}"), "h", "l", 1) for i in range(12)]
    rows += [(200 + i, "//c.example:80/%d" % i, "<article><p>The same article.</p></article>", "h", "l", 1) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert got[i] == f"words {i} of the text {i * i}"
        assert got[100 + i] == f"box {i}\n\nwords {i} of the text {i * i}"
        assert got[200 + i] == "The same article."
    shuffled = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA), most_broadcast=0).collect()}
    assert shuffled == got


def test_odd_rows(spark):
    rows = [(1, None, None, "h", "l", 1), (2, "", "", "h", "l", 1), (None, "x", "<p>é🙂</p>", "h", "l", 1), (3, "x", "<p>a</p>", "h", "l", 1), (3, "x", "<p>a</p>", "h", "l", 1), (4, "x", "<p>" + "word " * 50_000, "h", "l", 1)]
    got = [(r.page_id, r.text[:9], r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (2, "", 0), (None, "é🙂", 2), (3, "a", 1), (3, "a", 1), (4, "word word", 249_999)], key=str)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p>a</p><svg class="i"/><p>b</p>', "a\n\nb"),
        ("<p>a</p><svg class=i/><p>b</p>", "a\n\nb"),
        ("<p>a</p><svg-icon></svg-icon><template-x></template-x><select-box>c</select-box><p>b</p>", "a\n\nc\n\nb"),
        ("<p>a</p><select><option>x<option>y<p>b</p>", "a\n\nb"),
        ("<p>a</p><select><p>b</p><select><option>x</select><p>c</p>", "a\n\nb\n\nc"),
        ('<p>a</p><svg><path d="M0"><text>t</text><p>b</p>', "a\n\nb"),
        ("<p>a</p><svg><g><svg><text>t</text></svg><text>u</text></g></svg><p>b</p>", "a\n\nb"),
        ("<p>a</p><svg><foreignObject><p>t</p></foreignObject><text>u</text></svg><p>b</p>", "a\n\nb"),
        ("<p>a</p><template>t<template>u</template>v</template><p>b</p>", "a\n\nb"),
        ("<p>a</p><template><p>b</p>", "a\n\nb"),
        ("<p>a</p><noscript><p>b</p>", "a\n\nb"),
        ("<p>a</p><script>t</script type=x><p>b</p><iframe>u", "a\n\nb"),
    ],
)
def test_skipped_elements_end(page, text):
    assert html_text.main_text(page) == text


def test_many_skipped_elements_take_no_longer():
    for page in ("<svg>", "<select>", "<template>", "<svg><p>"):
        assert html_text.main_text(page * 50_000 + "end").endswith("end")


def test_noise_at_any_depth():
    """Rules hold below any depth, and leave again where the noise ends."""
    for depth in (10, 999, 1000, 1001, 30_000):
        page = "<font>" * depth + "<p>body</p><nav>menu</nav><p>more</p>" + "</font>" * depth + "<p>end</p>"
        assert html_text.main_text(page) == "body\n\nmore\n\nend"
        page = "<div>" * depth + "<article><p>body</p><div class=ad>buy</div></article>" + "</div>" * depth + "<p>out</p>"
        assert html_text.main_text(page) == "body"


@pytest.mark.parametrize("part", ["<a ", "<a<b", '<a "', "<a ' \">", '<a ">"', "<svg ", "<!--", "<svg><!--", "<p>", "<b><p></b>", "<div></span>", "</script x", "<script></script ", "<div><li>", "<b><hr>", "<table><tr><td>", "<a><div>", "<![", "</ ", "&lt", "<select>"])
def test_time_is_linear(part):
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        html_text.main_text(part * n)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 8 * seconds[0] + 0.5


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class=content><p>A story of many words that goes on.</p></div><article class=card>teaser</article>", "A story of many words that goes on.\n\nteaser"),
        ("<p>Intro.</p><article>x</article>", "Intro.\n\nx"),
        ("<p>side</p><article><p>The article itself.</p></article>", "The article itself."),
        ("<section id=search-algorithms><p>Search by halves.</p></section><div class=search-box>find</div>", "Search by halves."),
        ("<article><div id=header-compression><p>About headers.</p></div><div class='ad-slot-3 wide'>buy</div></article>", "About headers."),
        ("<p>a</p><svg class='x>y'><text>t</text></svg><p title='</p>'>b</p>", "a\n\nb"),
        ("<p>a <a href='x'>b <div>c</div></a> d</p>", "a b\n\nc\n\nd"),
        ("<p>a</p></ x><p>b</p><//><p>c</p>", "a\n\nb\n\nc"),
        ("<p>a</p><b", "a\n\n<b"),
        ("<!DOCTYPE html><?xml a?><p>x</p><!x>", "x"),
    ],
)
def test_what_else_is_content(page, text):
    assert html_text.main_text(page) == text


def sites(n=24, seed=4):
    """Pages of two sites: menus and boxes without telling names, which differ or repeat, around text that differs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    links = lambda: "".join(f"<li><a href=/{word()}>{word()} {word()}</a></li>" for _ in range(4))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(8, 30)))
    rows = []
    for i in range(n):
        host = "abc"[i % 2]
        body = [prose() for _ in range(rng.randrange(1, 4))]
        page = f"<body><main><div class=q7><ul>{links()}</ul></div><div class=z1>Same words on every page</div><div class=t>" + "".join(f"<p>{x}</p>" for x in body) + "</div></main></body>"
        rows.append((i, f"http://{host}.example/{i}", page, body))
    return rows


def test_the_tree_alone_removes_menus_that_differ_by_page(spark):
    rows = sites()
    df = spark.createDataFrame([(i, u, p, "h", "l", 1) for i, u, p, _ in rows], SCHEMA)
    got = {r.page_id: r.text for r in html_text.extract(df, marks=False).collect()}
    assert got == {i: "\n\n".join(body) for i, _, _, body in rows}
    none = {r.page_id: r.text for r in html_text.extract(df, marks=False, threshold=-1.0).collect()}
    assert all("Same words on every page" in t for t in none.values())


def test_importance_is_that_of_brute_force(spark):
    rows = sites(40) + [(100 + i, u, p.replace("q7", "k8"), b) for i, u, p, b in sites(7, 5)]
    pages = spark.createDataFrame([(u[7], p) for _, u, p, _ in rows], "host string, html string")
    nodes = html_text.style_nodes(pages)
    seen = collections.defaultdict(list)
    for r in nodes.collect():
        seen[r.host, r.node].append(r)

    def entropy(values):
        n = len(values)
        return -sum(k / n * math.log(k / n, n) for k in collections.Counter(values).values())

    low = set()
    for key, rs in seen.items():
        if len(rs) >= 8:
            said = [r.links for r in rs if r.links is not None]
            content = 0 if len(said) >= 8 and sum(said) >= 0.9 * len(said) else entropy([r.content for r in rs])
            if 0.1 * entropy([r.style for r in rs]) + 0.9 * content < 0.3:
                low.add(key)
    assert low and {(r.host, r.node) for r in html_text.low_importance(nodes).collect()} == low


@pytest.mark.parametrize("inline", ["<span hidden>SECRET</span>", '<span style="display: none">SECRET</span>', '<i aria-hidden="true">SECRET</i>', '<span class="ad">SECRET</span>', '<a class="share" href="x">SECRET</a>', "<button>SECRET</button>", "<video>SECRET</video>", '<span hidden><b>SECRET</b> <i class="x">SECRET</i></span>'])
def test_inline_elements_that_are_no_content(inline):
    blocks, _ = html_text.walk(f"<p>Text {inline} goes <b>on</b></p>")
    assert [b[:2] for b in blocks] == [("Text goes on", 0)]


def test_the_tree_has_nodes_at_any_depth():
    _, nodes = html_text.walk("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert sum(1 for n in nodes.values() if n[3]) == 3000
