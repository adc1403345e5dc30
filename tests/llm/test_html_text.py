import html
import random
import re

from talus.llm import html_text as H

from .common import clashing, rows


def by_markup(page):
    """What stands in <article>, by its tags alone: the synthetic pages always mark it."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_pages(spark, sf):
    want = {r.page_id: by_markup(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op4_html_text(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_any_chunk_size_gives_the_same(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows(H.extract(df, chunk=3)) == rows(H.extract(df.repartition(5), chunk=64))


def test_blocks_and_frames():
    page = """<!doctype html><title>T</title><body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav>
    <div class="cookie-notice">We use cookies</div><main><header><h1>A &amp; B</h1></header><p>One<br>two  &lt;three&gt;&nbsp;x
    <p>If a < b <b>then</b> it<i>al</i>ic<aside>side</aside><p>End<form><p>Name <input></form><script>var t = "</p><p>no";</script>
    <div id="comments"><p>first!</p></div><table><tr><td>c1<td>c2</table></main><footer>(c)</footer></body>"""
    assert H.main_text(H.blocks(page), []).split("\n\n") == ["A & B", "One two <three> x", "If a < b then italic", "End", "c1", "c2"]
    assert H.blocks(None) == H.blocks("") == H.blocks("<!-- x") == []
    assert H.main_text(H.blocks("<p>open <b>bold"), []) == "open bold"
    assert H.main_text(H.blocks("plain &copy; text"), []) == "plain © text"


def test_article_text_stays_whatever_its_classes():
    page = """<article><div class="entry-header"><h1>Title</h1></div><p class="share-price">Price rose<p class="legal-opinion">Held
    <p id="copyright-law">Law<section class="related-work">Work</section><p title=it's>It <math><mi>x</mi>+<mn>1</mn></math> is<p data-a="a>b" data-b='c>d'>quoted
    <div class="ad-slot">Buy</div><section class="comments-section"><p>first!</section></article>"""
    assert H.main_text(H.blocks(page), []).split("\n\n") == ["Title", "Price rose", "Held", "Law", "Work", "It x+1 is", "quoted"]
    assert H.main_text(H.blocks('<div class="site-header">x</div><div class="siteHeader">x</div><div class="share-price">y</div>'), []) == "y"
    assert H.blocks("<p " + "a=\"b\" " * 3000 + "c") == H.blocks("<p " + "a=\"b\" " * 3000 + "c")  # no end of the tag: linear, not exponential


def test_large_templates_and_copies_are_told_apart(spark):
    """A short article in a long template, and the same with pages that copy one another's articles."""
    template = [f"<div>Template line {i} with quite some words in it</div>" for i in range(30)]
    page = lambda n: "".join(template[:15]) + f"<p>Short story number {n} alone</p><p>It ends {n}</p>" + "".join(template[15:])
    data = [(i, f"http://h.example/{i:03d}", page(i // 2)) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in rows(H.extract(spark.createDataFrame(data, "page_id long, url string, html string"), chunk=7))}
    assert all(got[i] == f"Short story number {i // 2} alone\n\nIt ends {i // 2}" for i in range(60))


def test_differencing_against_brute_force(spark):
    """The whole query's rule once more, plainly: neighbours in order, subsequences by the table of lengths."""
    def subsequence(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    rng = random.Random(3)
    lines = {}
    for i in range(200):  # every line of a page differs from its others, so that the shared set is the same for all subsequences
        own = [f"Own line {i} {k} y{'x' * rng.randrange(30)}" for k in range(rng.randrange(1, 5))]
        top, foot = [f"Top {k} of the site" for k in range(rng.randrange(3, 6))], [f"Foot {k} of the site" for k in range(rng.randrange(2, 5))]
        lines[i] = top + own + foot
    data = [(i, f"http://h{i % 3}.example/p{i // 3:03d}", "".join(f"<p>{x}</p>" for x in lines[i])) for i in range(200)]
    got = {r["page_id"]: r["text"] for r in rows(H.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(6), chunk=9))}
    for i in range(200):
        mine = lines[i]
        near = [lines[j] for j in (i - 6, i - 3, i + 3, i + 6) if j in lines]
        shared = [[x for x in mine if x in o] for o in near]
        assert all(len(s) == subsequence(mine, o) for s, o in zip(shared, near))
        size = lambda s: sum(map(len, s))
        least = min(shared, key=size)
        rest = size(mine) - size(least)
        gone = {x for s in shared if rest >= 0.02 * size(mine) and not size([x for x in s if x not in least]) >= 0.7 * rest for x in s}
        assert got[i] == "\n\n".join(x for x in mine if x not in gone)


def test_very_long_page(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of many</p>" for i in range(30000)) + "</article>"
    data = [(i, f"http://h.example/{i}", f"<nav>menu</nav>{long}") for i in range(3)] + [(5, "http://h.example/9", "<p>short</p>")]
    got = {r["page_id"]: r for r in rows(H.extract(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert all(got[i]["text"].count("\n\n") == 29999 and got[i]["n_chars"] == len(got[i]["text"]) for i in range(3)) and got[5]["text"] == "short"


def test_lines_shared_with_neighbours_go(spark):
    page = lambda i: f"<body><p>Welcome to the site<p>Menu of the day<div>Story {i} begins here and is long</div><p>Middle {i} of it</p><div>All about us</div>"
    data = [(i, f"http://h.example/{i:03d}", page(i)) for i in range(150)] + [(900, "http://lone.example/", page(900)), (901, None, None), (902, "x", ""), (901, None, "<p>q")]
    got = {}
    for r in rows(H.extract(clashing(spark, data, "page_id long, url string, html string"))):
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[i] == [f"Story {i} begins here and is long\n\nMiddle {i} of it"] for i in range(150))
    assert got[900][0].startswith("Welcome") and sorted(got[901]) == ["", "q"] and got[902] == [""]
    assert rows(H.extract(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_common_subsequence_against_brute_force():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        got = H.common(a, b)
        assert len(got) == length(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
