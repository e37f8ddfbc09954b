"""Vector searches, page texts and the pipeline, on small tables."""

import numpy as np
import pytest

from gridloom.llm.ann import hilbert_keys, nearest
from gridloom.llm.html import extract, main_text
from gridloom.llm.topk import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, rank int, score double, query_id long"


def vectors(spark, n=700, copies=150, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[rng.choice(n, copies, replace=False)] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1, 0.0, 7) for i in range(n)]
    odd = [(None, rows[0][1]), (1000, None), (1020, [*rows[0][1][:-1], float("nan")]), (1040, [*rows[0][1][:-1], float("inf")]), (1060, [None, *rows[0][1][1:]]), (1100, [])]
    return x.astype(float), spark.createDataFrame(rows + [(i, v, None, None, None) for i, v in odd], SCHEMA)


def brute(scores, ids, q, k):
    order = np.lexsort((ids, -scores))
    return [(int(ids[j]), scores[j]) for j in order if ids[j] != q][:k]


def test_top_k(spark):
    x, df = vectors(spark)
    q = np.floor(1024 * x).astype(np.int64)
    got = {}
    for r in exact_top_k(df, every=50, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: brute(q @ q[i], np.arange(700), i, 10) for i in range(0, 700, 50)}


def test_top_k_refines_and_blocks(spark):
    x, df = vectors(spark, 200, 60, 5)
    q = np.floor(1024 * x).astype(np.int64)
    got = {}
    for r in exact_top_k(df, every=20, k=7, block_bytes=3 * 8 * 16, counts=12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: brute(q @ q[i], np.arange(200), i, 7) for i in range(0, 200, 20)}


def test_top_k_of_extreme_components(spark):
    """Components whose thousandfold is no double, scores beyond 64 bits, ties there, and vectors of several lengths."""
    big = 1.7e308
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 1.0]), (3, [1.0, 1.0]), (4, [big, big]), (5, [0.25, -3.0]), (100, [1.0, 0.5]), (200, [2.0]), (201, [3.0]), (202, [-4.0]), (300, []), (301, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = int(np.finfo(np.float64).max)

    def whole(x):
        y = 1024.0 * x
        return int(np.sign(y)) * most if np.isinf(y) else int(np.floor(y))

    want = {}
    for i, v in rows:
        if i % 100 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(whole(a) * whole(b) for a, b in zip(v, w)))), j) for j, w in rows if j != i and len(w) == len(v))
            want[i] = [(j, -x) for x, j in s][:3]
    got = {}
    for r in exact_top_k(df, every=100, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_nearest_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (3, [0.0, 0.0]), (20, [2.0]), (21, [-1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, every=20, k=3).collect())
    assert got == [(0, 1, 1, 0.5), (20, 1, 2, 2.0), (20, 2, 21, -2.0)]


def test_nearest_recall_on_the_table(spark):
    """Against brute force, on all queries of the 64-dimensional table."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.select("vec_id", "embedding").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = np.flatnonzero(ids % 20 == 0)
    hit = sum(len(got[ids[i]] & {a for a, _ in brute(x @ x[i], ids, ids[i], 20)}) for i in queries)
    assert hit >= 0.9 * 20 * len(queries)


def test_few_or_no_rows(spark):
    for search in (exact_top_k, nearest):
        assert search(spark.createDataFrame([], SCHEMA)).collect() == []
        few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, 1), (3, [0.5, 0.5], 1, 0.0, 1), (5, [0.5, 0.5], 1, 0.0, 1)], SCHEMA)
        assert [(r.query_id, r.rank, r.vec_id) for r in search(few).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 5)]
        assert search(few.where("vec_id <> 0")).collect() == []


def test_nearest_recall_and_ties(spark):
    x, df = vectors(spark)
    hit = total = 0
    got = {}
    for r in nearest(df, every=20, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i in range(0, 700, 20):
        want = brute(x @ x[i], np.arange(700), i, 20)
        hit += len({a for a, _ in got[i]} & {a for a, _ in want})
        total += 20
        assert all(abs(s - x[a] @ x[i]) < 1e-9 for a, s in got[i]) and i not in {a for a, _ in got[i]}
        assert got[i] == sorted(got[i], key=lambda r: (-r[1], r[0]))
    assert hit >= 0.9 * total and len(got[0]) == 20
    copies = np.flatnonzero((x == x[0]).all(1))[1:21]
    assert [a for a, _ in got[0]] == copies.tolist()


def test_nearest_clusters_have_narrow_windows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24)) * 4
    x = (centres[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    x, hit = x.astype(float), 0
    got = {}
    for r in nearest(df, every=100, k=20, half=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in range(0, 4000, 100):
        hit += len(got[i] & {a for a, _ in brute(x @ x[i], np.arange(4000), i, 20)})
    assert hit >= 0.9 * 20 * 40


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><div class='ad'>Buy this very long advert text now and again and again.</div><article><h1>T &amp; x</h1><p><b>One  two.<br><p>Three\n four.</article><footer>&copy; me</footer>", "T & x One two. Three four."),
    ("<body>just text &lt;b&gt;</body>", "just text <b>"),
    ("plain", "plain"),
    ("", ""),
    (None, ""),
    ("<script>var a='</p>';</script><style>p{}</style><!-- x > y --><p>a<b>b</b>c<p>d", "abc d"),
    ("<div id=page><div id=content><p>Alpha beta gamma delta, epsilon.<p>Zeta.</div><div id='sidebar-left'><p>Links here and there</div><div class=comments><p>I like it, I like it a lot, more than anything else on this page, really.</div></div>", "Alpha beta gamma delta, epsilon. Zeta."),
    ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep er"),
    ("<article><p>form<form><p>no</form><p hidden>no<p style='display: none'>no</p><aside>no</aside><p>yes &#x48;&nbsp;i", "form yes H i"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
    ('<article><p class="comment-free">Hello this is text.</p><p>And <a href=x>some</a> more of it, as it goes on.</p><p>More.</article>', "Hello this is text. And some more of it, as it goes on. More."),
    ('<main><p id="search-results">' + "A long paragraph of plain text, " * 20 + "</p><p>tail</p></main>", "A long paragraph of plain text, " * 20 + "tail"),
    ('<article><p>' + "The text of the article, sentence by sentence. " * 9 + '</p><p class="ad-slot">Buy now!</p><div id="user-comments">I like it very much indeed, more than all else here.</div><p>End.</article>', "The text of the article, sentence by sentence. " * 9 + "End."),
    ('<body><div class="share-links-x"><a href=1>one</a> <a href=2>two</a></div><div><p>' + "Words of the page that are its main text. " * 5 + '</p><p>Its end.</p></div></body>', "Words of the page that are its main text. " * 5 + "Its end."),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_pages(spark):
    df = spark.createDataFrame([(i, "u" if i % 2 else None, h, 5) for i, (h, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, n_chars int")
    got = extract(df).collect()
    assert len(got) == 2 * len(PAGES) and all(r.n_chars == len(r.text) for r in got)
    assert extract(df.where("false")).collect() == []


@pytest.mark.parametrize("piece", ["<div></b>", "<span></i></div x>", "<ul><li>", "<table><tr><td>x<p>", "<p><b class=comments>"])
def test_nesting_takes_linear_time(piece):
    import time

    began = time.time()
    main_text(piece * 32_000 + "text")
    assert time.time() - began < 4


def brute_density(html):
    """Composite density sums of every element of a well-formed page of block elements and links, from the definition."""
    import math
    import xml.etree.ElementTree as ET

    root = ET.fromstring(html)

    def counts(e):
        own = len((e.text or "").strip()) + sum(len((c.tail or "").strip()) for c in e)
        c, t, lc, lt = own, 0, 0, 0
        for k in e:
            a, b, x, y = counts(k)
            c, t, lc, lt = c + a, t + b + 1, lc + x, lt + y
        return (c, t, c, lt + 1) if e.tag == "a" else (c, t, lc, lt)

    body = counts(root)
    ratio = body[2] / max(1, body[0])

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = 1 + math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
        return c / max(1, t) * math.log(math.e - 1 + max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    def own(e):
        return len((e.text or "").strip()) + sum(len((c.tail or "").strip()) for c in e)

    return max(root.iter(), key=lambda e: sum(density(*counts(k)) for k in e) + density(own(e), 1, 0, 0))


def test_density_equals_brute_force():
    """The chosen subtree's words are all there, on random pages of nested blocks and links."""
    import random

    rnd = random.Random(31)

    def block(depth):
        inner = [f"w{rnd.randrange(10**6)} " * rnd.randint(0, 12)]
        for _ in range(rnd.randint(0, 4) if depth else 0):
            inner.append(f"<a> l{rnd.randrange(10**6)} </a>" if rnd.random() < 0.3 else block(depth - 1))
        return f"<div>{''.join(inner)}</div>"

    for _ in range(150):
        html = f"<body>{''.join(block(4) for _ in range(3))}</body>"
        best = brute_density(html)
        want = " ".join("".join(" " + x + " " for x in best.itertext()).split())
        assert set(want.split()) <= set(main_text(html).split())


def test_generated_pages(spark):
    import re
    from html import unescape

    for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))).split())


def test_equal_vectors_under_other_ids_are_found(spark):
    """A query's own row is there more often than neighbours are asked for."""
    from gridloom.llm.ann import nearest

    vectors = [(0, [1.0, 0.0])] * 9 + [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in nearest(df, every=20, k=3, half=100).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
