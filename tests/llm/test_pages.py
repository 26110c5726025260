"""Page texts: alignment against a table, neighbours against one sorted list, markup and made sites by hand."""

import os
import random
import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import page_text

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "page_id long, url string, html string, text string, host string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "b") for r in rows], SCHEMA)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    pairs = page_text.common_lines(a, b)
    assert len(pairs) == longest(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def by_hand(rows):
    """All pages in one sorted list, each compared with two before and two after it on its host."""
    pages = []
    for page_id, url, html in rows:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        pages.append((host, path, -1 if page_id is None else page_id, page_id, url, page_text.text_lines(html)))
    pages.sort(key=lambda p: p[:3])
    out = []
    for k, page in enumerate(pages):
        texts, shared, n = [l[0] for l in page[5]], [0] * len(page[5]), 0
        for j in (k - 2, k - 1, k + 1, k + 2):
            if 0 <= j < len(pages) and page[0] and pages[j][0] == page[0] and [l[0] for l in pages[j][5]] != texts:
                n += 1
                first, second = sorted((j, k))
                for x, y in page_text.common_lines([l[0] for l in pages[first][5]], [l[0] for l in pages[second][5]]):
                    shared[x if first == k else y] += 1
        text = page_text.main_text(page[5], shared, n)
        out.append((page[3], page[4], text, len(text)))
    return out


def check(spark, rows):
    got = page_text.page_texts(frame(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    found = sorted(map(tuple, got.collect()), key=key)
    assert found == sorted(by_hand(rows), key=key)
    return {r[0]: r[2] for r in found}


SITE = """<html><head><title>{t}</title><style>p {{}}</style></head><body class="has-sidebar"><div id="x1"><a href=/>Home</a><a href=/b>Blog</a></div>
<div class="q7">We keep your data for a year.</div><div><h1>{t}</h1>{body}</div><div class="q9"><p>Read more of our stories.</p></div>
<div class="comments"><p>{t}: first comment!</p></div><div>Made by Example &amp; Co.</div></body></html>"""


def test_a_site_without_article_markup(spark):
    rng = random.Random(1)
    bodies = {k: [f"Paragraph {k} of {rng.random()} &lt;b&gt;", f"<b>Bold</b>ly {k}<br>said {k} &eacute;"] for k in range(40)}
    bodies[7] = bodies[8] = bodies[9]  # copies of one article
    rows = [(k, f"http://www.a.example/{k // 10}/{k:03d}", SITE.format(t=f"Title {k}", body="".join(f"<p>{p}" for p in ps))) for k, ps in bodies.items()]
    found = check(spark, rows)
    for k, ps in bodies.items():
        if k not in (7, 8, 9):
            assert found[k] == unescape(" ".join([f"Title {k}"] + [re.sub("<br>", " ", re.sub("</?b>", "", p)) for p in ps]))


def test_copies_inside_articles_stay(spark):
    page = lambda t: f"<body><nav>Menu {t}</nav><header>Site</header><article><header><h1>{t}</h1></header><p>Quoted line.</p><div>Share this page</div><section class='comments'><p>Nice!</p></section></article><footer>End</footer>"
    rows = [(k, f"https://b.example/{k}", page(f"T{k % 5}")) for k in range(30)]
    assert set(check(spark, rows).values()) == {f"T{k} Quoted line." for k in range(5)}


def test_odd_pages(spark):
    rows = [
        (1, "http://c.example/1", None), (2, "http://c.example/2", ""), (3, None, "<p>alone</p>"), (4, "no host", "<main>x<!-- y --><script>'<p>'</script>z</main>"), (None, "http://c.example/", "a<br>b"),
        (None, "http://c.example/", "a<br>b"), (None, None, None), (7, "http://c.example/3", "<b>" * 3000 + "deep" + "<p>"), (7, "http://c.example/3", "other"), (8, "http://d.example/l", "<p>" + "long words " * 300_000),
        (9, "http://e.example/", "<article><p>&amp;amp; &#233;&nbsp;x \n y</p><p hidden>h</p><div style='display: none'>n</div><p>cut <a href='"),
    ]
    found = check(spark, rows)
    assert found[1] == found[2] == "" and found[3] == "alone" and found[4] == "xz" and found[8] == ("long words " * 300_000).strip() and found[9] == "&amp; é x y cut"
    assert check(spark, []) == {}


def test_hot_host_over_many_blocks(spark):
    rng = random.Random(2)
    rows = [(k, f"http://hot.example/{rng.randint(0, 400)}/{k % 7}", f"<div>{rng.choice('abc')} all</div><p>{rng.random()}<div>site {k % 3}</div>") for k in range(1500)]
    cuts, edges = page_text._blocks(frame(spark, rows).select(page_text.host_of(page_text.F.col("url")).alias("host"), page_text.path_of(page_text.F.col("url")).alias("path"), page_text.F.col("page_id").alias("key_id")))
    assert len(cuts) > 10 and len(edges) > 40
    check(spark, rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    found = check(spark, rows)
    for page_id, _, html in rows:  # the article's element, its markup taken away
        inner = re.search(r"(?s)<article>(.*?)</article>", html)[1]
        plain = unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner)))
        assert found[page_id] == " ".join(plain.split())
