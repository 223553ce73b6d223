import html
import math
import random
import re
import time

from lodestrata.llm import html_text
from lodestrata.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Head&shy;line &amp; more</h1></header><p>One <b>bold</b>
 word<br>next<p>Two &lt;tag&gt;&nbsp;x<div class="advert">Buy</div><ul><li>a<li>b <i>c</i></ul><script>var x = "</p>";</script>
<table><tr><td>1<td>2<tr><td>3</table><form><input> Send</form><section id="comments"><p>Nice!</p></section>
<aside>Side</aside><blockquote>Said <!-- no <p> --> so</blockquote></article></main><div id="sidebar"><p>Links</p></div><footer>&copy; x</footer></body></html>"""


def test_page_by_hand():
    assert main_text(PAGE).split("\n") == ["Head\xadline & more", "One bold word next", "Two <tag> x", "a", "b c", "1 2", "3", "Said so"]


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<p> </p>") == ""
    assert main_text("plain < 3 words") == "plain < 3 words"
    assert main_text("<p>open <b>and <i>never closed") == "open and never closed"
    assert main_text("</div></p>x<script>y") == "x"
    assert main_text("<div>a</div>b<div>c<div>d</div>e</div>") == "a\nb\nc\nd\ne"
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(main_text(long)) == 5 * 200_000 - 1


def test_site_tree_cuts_what_markup_does_not_name(spark):
    shell = '<body><div class="x1"><p>Our site since {y}</p></div><div class="x2"><p>Story {i} of its own</p></div><div class="x3">Call us today</div></body>'
    pages = [(i, f"http://h.org/{i}", shell.format(i=i, y=1999)) for i in range(12)] + [(99, "http://one.org/", shell.format(i=99, y=1999)), (100, None, None), (100, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'q' AS host", "1 AS noise", "2 AS text")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == 15
    for i in range(12):
        assert got[i].text == f"Story {i} of its own" and got[i].n_chars == len(got[i].text)
    assert got[99].text == "Our site since 1999\nStory 99 of its own\nCall us today"
    assert got[100].text == "" and got[100].n_chars == 0
    paths = html_text.Page(shell, paths=True).paths
    tree = {paths[r.node]: r for r in html_text.style_tree(df).collect() if r.host == "h.org" and r.node}
    assert tree["/body/div.x3"].best < 0.2 and tree["/body/div.x2/p"].content == 1 and tree["/body"].best == tree["/body/div.x2/p"].importance
    assert html_text.extract(df.limit(0)).count() == 0


def test_copies_of_an_article_stay(spark):
    pages = [(i, f"http://h.org/{i}", "<nav>m</nav><article><h1>A</h1><p>Same text</p></article>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {"A\nSame text"}


def test_pages_against_their_articles(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for r in df.collect():
        body = "".join(re.findall(r"<article[^>]*>(.*?)</article>", r.html, flags=re.S))
        parts = re.split(r"</?(?:p|h1)>", body)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def plain_tree(pages):
    """path -> importance by walking nested elements of well-formed pages, one host."""
    from html.parser import HTMLParser

    seen, styles, texts = {}, {}, {}
    for n, page in enumerate(pages):
        stack = [["", []]]

        class Walk(HTMLParser):
            def handle_starttag(self, tag, attrs):
                name = "/" + ".".join([tag, *[v for k, v in attrs if k == "class"]])
                stack[-1][1].append(name)
                stack.append([stack[-1][0] + name, []])

            def handle_endtag(self, tag):
                path, kids = stack.pop()
                seen.setdefault(path, set()).add(n)
                kids = tuple(k for i, k in enumerate(kids) if not i or kids[i - 1] != k)
                styles.setdefault(path, {}).setdefault(kids, set()).add(n)

            def handle_data(self, data):
                if data.strip():
                    texts.setdefault(stack[-1][0], {}).setdefault(data.strip(), set()).add(n)

        Walk().feed(page)
    own = {}
    for path, there in seen.items():
        m = len(there)
        k = [len(x) for x in texts.get(path, {}).values()]
        j = [len(x) for x in styles[path].values()]
        content = sum(x * (1 - math.log(x) / math.log(m)) for x in k) / sum(k) if k and m > 1 else 1.0
        shape = -sum(x / sum(j) * math.log(x / sum(j)) for x in j) / math.log(m) if m > 1 else 1.0
        own[path] = (sum(k), *(1 - (1 - min(x, 1.0)) * (m - 1) / (m + 1) for x in (content, shape)), 0.1 * m)
    composite = {}
    for path in own:
        under = [own[q] for q in own if q == path or q.startswith(path + "/")]
        composite[path] = sum(c * x + w * y for c, x, y, w in under) / sum(c + w for c, _, _, w in under)
    return {p: (composite[p], max(composite[q] for q in own if q == p or q.startswith(p + "/"))) for p in own}


def test_tree_and_cut_against_a_plain_tree(spark):
    rng = random.Random(5)
    pages = []
    for i in range(40):
        story = "".join(f"<p>{rng.choice(['tale', 'news', 'note'])} {i} {k}</p>" for k in range(rng.randint(1, 4)))
        boxes = "".join(f'<div class="b{k}">{rng.choice(["one", "two", str(i)])}</div>' for k in range(rng.randint(0, 3)))
        pages.append(f'<body><div class="top"><ul><li>Home</li><li>Topic {rng.randint(0, 2)}</li></ul></div><div class="mid"><section>{story}</section>{boxes}</div><div class="end"><div>Since {rng.choice([1, 1, 1, 2])}</div></div></body>')
    df = spark.createDataFrame([(i, "http://h.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    plain, paths = plain_tree(pages), {}
    for p in pages:
        paths |= html_text.Page(p, paths=True).paths
    tree = {paths[r.node]: (r.importance, r.best) for r in html_text.style_tree(df).collect()}
    assert tree.keys() == plain.keys()
    assert all(abs(x - y) < 1e-9 for p in plain for x, y in zip(tree[p], plain[p]))
    noise = {p for p, (_, best) in plain.items() if best < html_text.LEAST}
    assert "/body/div.top/ul/li" in noise and "/body/div.mid/section/p" not in noise
    for r in html_text.extract(df).collect():
        page = html_text.Page(pages[r.page_id], paths=True)
        assert r.text == "\n".join(t for node, t, _, _ in page.blocks if paths[node] not in noise)


def test_deep_and_broken_pages_in_linear_time():
    start = time.time()
    n = 100_000
    assert main_text('<div class="a">' * n + "x" + "</div>" * n) == "x"
    assert main_text("<b>" * n + "y </b>" * n + "</i>" * n).split() == ["y"] * n
    assert main_text("<li><ul>" + "<div>" * 1000 + "<li>z</li></q>" * n).count("z") == n
    assert main_text("<p>" + "<i>" * n + "<p>".join("ab") ) == "a\nb"
    assert time.time() - start < 60


def test_unclosed_tags_in_linear_time():
    """Begins of tags that never end, with quotes in all states: ten times the page, about ten times the time."""
    parts = ['<p class="x" ', "<a ", "<!x ", "</a ", "<a b='", '<a "', "<a <b ' \" ", "<script </script ", '<p class="x>', "<i '\">"]
    for part in parts:
        for tail in ("", ">", '">', "'>", "\"'>z"):
            took = []
            for n in (8_000, 80_000):
                start = time.time()
                main_text(part * n + tail)
                took.append(time.time() - start)
            assert took[0] < 2 and took[1] < 20, (part, tail, took)


def test_odd_tags_as_before():
    """A start tag may hold `<` outside quotes; what never ends is text."""
    assert main_text('<p a <b c="d>">x</p>y') == "x\ny"
    assert main_text('1 < 2 <p>a "b" <c</p>') == '1 < 2\na "b"'
    assert main_text("<p>a</p><b 'open") == "a\n<b 'open"
    assert main_text("<p>a</p>b <!-- c") == "a\nb"
    assert main_text("<p>a <i 'x>b</i> c' >d</p>") == "a d"


def test_article_keeps_what_names_no_noise():
    page = '<article><p>Let <math><mi>x</mi></math> be.</p><object>Chart: 5</object><p class="share-price">Up</p><div class="related-work">Older</div><div class="ad">Buy</div></article>'
    assert main_text(page) == "Let x be.\nChart: 5\nUp\nOlder"
