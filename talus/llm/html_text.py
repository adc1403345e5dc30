"""Operator 4: main text of web pages by differencing each page with its neighbours by URL path."""

from __future__ import annotations

import hashlib
import html as _html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ._base import own, table, written

#: Pages on each side that a page is compared with; bytes of html of a run of neighbouring pages; runs and pages of a run at least.
SIDE, RUN_BYTES, MAX_RUNS, CHUNK = 2, 8 << 20, 1 << 16, 64
#: Share of its text, apart from the template's, from which on a page is a copy of the same article; share of all of it.
COPY, WHOLE = 0.7, 0.98

# HTML's elements whose content is no text, that end a block, that never have content, and that hold no article text.
_RAW = frozenset("script style noscript template svg iframe object canvas textarea title select option datalist audio video map".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside form menu dialog button search fieldset legend label input".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# A heuristic of our own: words that name such parts in class and id attributes, and words that only say where or how.
# A name counts when it consists of both kinds only ("site-header", "share-buttons"), not "share-price" or "legal-opinion".
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead toolbar comment comments respond disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip copyright legal".split()
)
_PLACE_WORDS = frozenset("site page main top bottom left right global primary secondary box slot section list container wrapper wrap block area inner outer bar links link item items panel unit buttons button icons form content".split())
# Inside an article that the page marks, only names of adverts and reader comments count.
_NEVER_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsored comments disqus".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _is_chrome(tag: str, raw: str, inside: bool) -> bool:
    if tag in _CHROME or (tag == "header" and not inside):
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    a = _attributes(raw)
    if a.get("role", "").lower() in _CHROME_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    words = _NEVER_ARTICLE if inside else _CHROME_WORDS
    for name in (a.get("class", "") + " " + a.get("id", "")).split():
        parts = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if any(w in words for w in parts) and all(w in words or w in _PLACE_WORDS for w in parts):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, part of the page's frame) of each block of a page in order."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, inside, frame
    inside = frame = False
    skip = ""
    page = page or ""

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                out.append((text, inside, frame))

    at, end = 0, len(page)
    while at < end:
        if skip:  # raw text up to its own end tag
            m = re.compile(rf"</{re.escape(skip)}\s*>", re.I).search(page, at)
            at, skip = (m.end() if m else end), ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        if not m[2]:
            if m[0][0] != "<" or m[0] == "<":
                held.append(_html.unescape(m[0]) if "&" in m[0] else m[0])
            elif m[0].startswith("<![CDATA["):
                held.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (tag in _BLOCK or not any(t in _BLOCK for t, _, _ in stack[depth:])):
                _, inside, frame = stack[depth]
                del stack[depth:]
            continue
        if tag in _RAW:
            skip = tag if not m[3].rstrip().endswith("/") else ""
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # end tags that may be left out
                stops = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr"}.get(tag, "").split()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        _, inside, frame = stack[i]
                        del stack[i:]
                        break
                    if stack[i][0] in stops or (stack[i][0] in _BLOCK and tag == "p"):
                        break
        if tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        stack.append((tag, inside, frame))
        frame = frame or _is_chrome(tag, m[3], inside)
        inside = inside or tag in ("article", "main")
    flush()
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of lines, as pairs of places (Hunt and Szymanski 1977)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(len(a), len(b)) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)  # descending
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(lo, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(lo)] + middle[::-1] + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def main_text(page: list[tuple[str, bool, bool]], neighbours: list[list[tuple[str, bool, bool]]]) -> str:
    """The page's blocks without its frame and without the lines that it shares, in order, with a neighbour.

    The neighbour that shares least shows the template.  A neighbour that shares COPY or more of the page's own text
    apart from that is a copy of the same article and proves nothing of it; if even the least shares WHOLE of it, all are.
    Where a page marks its article, that markup outweighs differences: text outside belongs to the frame, and a sentence
    inside stays though a neighbour's article has it too.
    """
    lines = [t for t, _, _ in page]
    marked = any(i and not f for _, i, f in page)
    own_text = [not f and (i or not marked) for _, i, f in page]
    weight = lambda at: sum(len(lines[i]) for i in at if own_text[i])
    total = weight(range(len(lines)))
    shared = [{i for i, _ in common(lines, [t for t, _, _ in other])} for other in neighbours]
    template = min(shared, key=weight, default=set())
    rest, gone = total - weight(template), set()
    for s in shared:
        copied = rest < (1 - WHOLE) * total or weight(s - template) >= COPY * rest > 0
        gone.update(i for i in s if not (own_text[i] and (copied or page[i][1])))
    return "\n\n".join(t for i, (t, o) in enumerate(zip(lines, own_text, strict=True)) if o and i not in gone)


def _parts(url):
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(rest, "^//([^/?#]*)", 1))
    return host, F.regexp_extract(rest, "^(?://[^/?#]*)?([^?#]*)", 1)


def _splits(rows: DataFrame, least: int) -> list[tuple]:
    """Place keys of each run of pages, in one order over all pages: its first, its SIDE-th, its SIDE-th last, its last.

    Runs hold about RUN_BYTES of html, and MAX_RUNS are made at most, so that what goes to the driver and the workers is
    bounded; only the place columns are sorted; a host that holds most pages spreads over many runs.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "url", "known", "key"]
    small = written(rows.select(*order, F.octet_length("html").alias("size")).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "order")
    at, total, base = 0, 0, []
    for r in small.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("size")).orderBy("part").collect():  # a row for each partition
        base.append((r["part"], at))
        at, total = at + r["n"], total + (r["size"] or 0)
    runs = min(MAX_RUNS, -(-total // RUN_BYTES)) or 1
    size = max(least, 2 * SIDE, -(-at // runs))
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base long")
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = small.withColumn("inner", inner).join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("inner"))
    inside = F.col("place") % size
    ends = placed.where(inside.isin(0, SIDE - 1, size - SIDE, size - 1) | (F.col("place") >= at - SIDE)).select("place", *order)
    tuples = {r["place"]: tuple(r[1:]) for r in ends.collect()}
    out = []
    for i in range(0, at, size):
        last = min(i + size, at) - 1
        out.append((tuples[i], tuples[min(i + SIDE - 1, last)], tuples[max(last - SIDE + 1, i)] if last - SIDE + 1 >= i else tuples[i], tuples[last]))
    return out


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", chunk: int = CHUNK) -> DataFrame:
    """key, url, text, n_chars: the article of each page, blocks joined by an empty line; empty if there is none.

    Each page is compared with the SIDE pages before and after it on the same host, in order of URL path (then URL,
    key and html).  Null html counts as empty, a null or relative URL as one host without a name; repeated keys and URLs
    are pages of their own; other columns are ignored; an empty table gives no rows.

    Pages are parsed where they are read; only their blocks move, once, each run of neighbouring pages to one task, with
    the pages next to the run's ends.  A task reads its run in order and holds 2 * SIDE + 1 pages at a time.
    """
    W.small_batches(df.sparkSession)
    rows = own(df, key=key, url=url, html=html)
    kinds = dict(rows.dtypes)
    host, path = _parts(F.col("url"))
    rows = rows.select("key", F.col("url").alias("given"), F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"), F.col("key").isNotNull().alias("known"), "html")
    splits = _splits(rows, chunk)
    runs = df.sparkSession.sparkContext.broadcast(splits)
    kinds_out = f"chunk int, home int, key {kinds['key']}, given {kinds['url']}, url string, host string, path string, known boolean, tie string, texts array<string>, inside array<boolean>, frame array<boolean>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = lambda t: t[:4] + ((t[4],) if t[3] else ())
        firsts, heads, tails, lasts = ([order(t[i]) for t in runs.value] for i in range(4))
        for b in batches:
            found = [blocks(x) for x in b["html"]]
            b["tie"] = [hashlib.sha256((x or "").encode("utf-8", "replace")).hexdigest()[:16] for x in b.pop("html")]
            for i, name in enumerate(("texts", "inside", "frame")):
                b[name] = [[x[i] for x in f] for f in found]
            places = [order(t) for t in zip(b["host"], b["path"], b["url"], b["known"], b["key"], strict=True)]
            # Equal places share a run: the one in which the first of them begins, or which it begins.
            home = [max(bisect_right(firsts, p) - 1, 0) for p in places]
            home = [bisect_left(firsts, firsts[h]) if firsts[h] == p and h and lasts[h - 1] == p else h for h, p in zip(home, places, strict=True)]
            to = [[h] + [h - 1] * (h > 0 and p <= heads[h]) + [h + 1] * (h + 1 < len(firsts) and p >= tails[h]) for h, p in zip(home, places, strict=True)]
            b["home"], b["chunk"] = home, to
            out = b.explode("chunk", ignore_index=True).astype({"chunk": "int32"})
            yield out[["chunk", "home", "key", "given", "url", "host", "path", "known", "tie", "texts", "inside", "frame"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: list[tuple] = []  # pages around the one that is next, in order
        nothing = (None, None, False, None, None, [])

        def answer(page: tuple) -> list[tuple]:
            near.append(page)
            if len(near) <= SIDE:
                return []
            run, host, mine, key, given, found = near[-SIDE - 1]
            if not mine:
                got = []
            else:
                text = main_text(found, [p[5] for i, p in enumerate(near) if i != len(near) - SIDE - 1 and p[:2] == (run, host)])
                got = [(key, given, text, len(text))]
            if len(near) > 2 * SIDE:
                del near[0]
            return got

        names = ["key", "url", "text", "n_chars"]
        for b in batches:
            out = []
            for run, home, key, given, host, texts, inside, frame in zip(*(b[c] for c in ("chunk", "home", "key", "given", "host", "texts", "inside", "frame")), strict=True):
                out += answer((run, host, home == run, key, given, list(zip(texts, inside, frame, strict=True))))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([x for _ in range(SIDE) for x in answer(nothing)], columns=names)

    parsed = rows.mapInPandas(parse, kinds_out)
    dealt = parsed.repartitionById(max(1, len(splits)), "chunk").sortWithinPartitions("chunk", "host", "path", "url", "known", "key", "tie")
    got = dealt.select("chunk", "home", "key", "given", "host", "texts", "inside", "frame").mapInPandas(compare, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long")
    return got.withColumnRenamed("key", key).withColumnRenamed("url", url)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
