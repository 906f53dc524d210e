"""Decontamination, near-duplicates, page differencing."""

from __future__ import annotations

import itertools
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from permspark.llm import components, decontaminate as D, html_text as H, ordered, queries, simhash as S
from tests.llm import brute

random.seed(5)
VOCABULARY = [f"w{k}" for k in range(300)]


def sentence(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


# --- decontamination


def test_masks_meet_every_substitution():
    for gone in itertools.combinations(range(D.WINDOW), D.SUBSTITUTIONS):
        places = ({a + o for o in m} for m in D.MASKS for a in range(D.WINDOW - max(m)))
        assert any(not p & set(gone) for p in places)


@pytest.mark.parametrize("n", range(1, D.WINDOW))
def test_masks_of_short_items_meet_every_substitution(n):
    masks = [set(kept) for size, kept in D.patterns([n]) if size == n]
    assert all(any(not m & set(gone) for m in masks) for gone in itertools.combinations(range(n), D.allowed(n)))
    assert D.allowed(n) == (n >= 5) and min(map(len, masks)) >= min(n, 3)


def leak_tables(spark):
    items = [(k, sentence(n)) for k, n in enumerate([13, 14, 30, 8, 10, 12, 7, 45, 9, 11, 6, 5, 4, 3, 2, 1])] + [(20, None), (21, ""), (None, sentence(20)), (7, sentence(15))]
    docs = [(k, sentence(60)) for k in range(30)]
    for k, (_, text) in enumerate(items):
        w = (text or "").split()
        for gone in range(4):
            v = list(w)
            for at in random.sample(range(len(v)), min(gone, len(v))):
                v[at] = "other"
            docs.append((100 + 10 * k + gone, f"{sentence(9)}, {' '.join(v).upper()}! {sentence(9)}"))
    docs += [docs[31], (None, docs[35][1]), (500, None), (501, ""), (502, " \n "), (503, " ".join(VOCABULARY * 40))]
    extra = [F.lit(1).alias(c) for c in ("words", "pos", "seed", "item_id")]
    a = spark.createDataFrame(docs, "doc_id long, text string").select("*", *extra)
    b = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(2).alias("n"), F.lit(3).alias("window"))
    return docs, items, a, b


def test_sql_of_leaks_equals_brute_force(spark):
    docs, items, _, _ = leak_tables(spark)
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.register(name, pd.DataFrame(rows, columns=[key, "text"]).astype({key: "Int64"}))
    got = {(d, i): (n, a, b) for d, i, n, a, b in con.execute(f"SELECT doc_id, item_id, n_places, first_word, last_word FROM ({queries.OP1_SQL})").fetchall()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in brute.leaks(docs, items).items()}


@pytest.mark.parametrize("block", [D.BLOCK, 40])
def test_leaks_equal_brute_force(spark, block):
    docs, items, a, b = leak_tables(spark)
    got = {(r.doc_id, r.item_id): (r.n_places, r.first_word, r.last_word) for r in D.find_leaks(a, b, block=block).collect()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in brute.leaks(docs, items).items()}


@pytest.mark.parametrize("block", [D.BLOCK, 1])
def test_hits_of_a_long_document_do_not_hold_it(spark, block):
    """18 000 hits in 19 000 words; with all words beside each hit they would take some 8 GB at once."""
    item = sentence(16)
    text = " ".join([item] * 1200)
    a = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(2, item)], "item_id long, text string")
    found = D.find_leaks(a, b, block=block)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Project \[_k0#\S+, words#\d+, pos#\d+, at#", plan)
    (got,) = found.collect()
    assert (got.n_places, got.first_word, got.last_word) == (1200 * 4, 0, 1199 * 16 + 3)


def test_large_benchmarks_broadcast_only_a_bitmap(spark):
    """Blocks of windows had two broadcasts and a scan of the documents each."""
    docs, items, a, b = leak_tables(spark)
    plan = D.find_leaks(a, b, block=20)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"BroadcastExchange", plan)) == 1
    seeds = spark.range(5000).select(F.xxhash64("id").alias("seed"))
    rows = D.bitmap(seeds, 13).collect()
    assert sorted((r.row, len(r.bits)) for r in rows) == [(k, 2**D.ROW) for k in range(2**3)]
    bits = [x for r in sorted(rows) for x in r.bits]
    passed = lambda s: all(bits[(s % 2**64) >> 51] >> (s >> k & 63) & 1 for k in (0, 6, 12))
    assert all(passed(r.seed) for r in seeds.collect())
    assert sum(passed(r.s) for r in spark.range(5000, 25000).select(F.xxhash64("id").alias("s")).collect()) < 200


def test_without_leaks_keeps_clean_rows(spark):
    docs, items, a, b = leak_tables(spark)
    bad = {d for d, _ in brute.leaks(docs, items, least=D.TOLERANT)}
    kept = D.without_leaks(a, b)
    assert kept.columns == a.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(d for d, _ in docs if d is not None and d not in bad)
    assert D.without_leaks(a, b.limit(0)).count() == len(docs)
    assert D.find_leaks(a.limit(0), b).count() == 0


# --- near-duplicates


def near_docs():
    docs = [(k, sentence(random.randint(1, 80))) for k in range(40)]
    for k in range(12):
        w = docs[k][1].split()
        for j in range(3):
            v = list(w)
            v[random.randrange(len(v))] = "x"
            docs.append((200 + 10 * k + j, " ".join(v)))
    base = sentence(400).split()
    for k in range(40):
        v = list(base)
        for _ in range(k % 4):
            v[random.randrange(len(v))] = f"y{k}"
        docs.append((1000 + k, " ".join(v)))
    return docs + [(3, docs[3][1]), (900, None), (901, ""), (902, "\t\n"), (None, docs[5][1]), (None, sentence(30)), (903, docs[0][1].upper())]


@pytest.mark.parametrize("cell", [S.CELL, 3])
def test_components_equal_brute_force(spark, cell):
    docs = near_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("cell", F.lit("a"))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in S.near_duplicates(df, cell).collect())
    assert got == sorted((str(d), brute.fingerprint(t), g) for (d, t), g in zip(docs, brute.groups(docs)))
    kept = S.one_of_each(df, cell)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({g for (d, _), g in zip(docs, brute.groups(docs)) if d is not None and d == g})
    assert kept.filter("doc_id IS NULL").count() == 2


def test_one_of_each_keeps_texts_of_repeated_and_missing_ids(spark):
    a, b, c, d = (sentence(60) for _ in range(4))
    rows = [(7, a), (7, b), (3, a), (None, b), (None, c), (None, c), (None, a), (8, d), (8, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.one_of_each(df, unnamed=True)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, a), (7, b), (None, c), (8, d)], key=str)
    assert kept.columns == df.columns


def test_near_duplicates_of_nothing(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cells_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, size=400, dtype=np.int64)
    flips = [np.bitwise_xor(base, np.int64(sum(1 << int(b) for b in rng.choice(63, size=n, replace=False)))) for n in (1, 2, 3, 3, 4)]
    prints = np.unique(np.concatenate([base, *flips]))
    keys = S.cell_keys(S.distance_table(prints))
    u = prints.view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= S.DISTANCE, 1))
    assert len(near) > 1000
    assert all((keys[a] == keys[b]).any() for a, b in near)
    for a, b in near[:200]:
        assert set(S.links_in(prints[[a, b]])) | {(int(prints[b]), int(prints[a]))} >= {(int(prints[a]), int(prints[b]))}


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(40)] + [(500 + k, 500) for k in range(50)] + [(7, 7), (900, 900)]
    random.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {500 + k: 500 for k in range(50) if k} | {500: 500}


# --- ordered helpers


def test_prefix_sums_and_neighbours(spark):
    rows = [(random.choice(["a", "a", "a", "b", None]), k, random.randint(0, 9)) for k in random.sample(range(300), 200)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {r.k: r.s for r in ordered.prefix_sums(df, ["g"], ["k"], {"v": "s"}).collect()}
    assert got == {k: sum(v for g2, k2, v in rows if g2 == g and k2 < k) for g, k, _ in rows}
    beside = {r.k: (r.before and r.before.k, r.after and r.after.k) for r in ordered.neighbours(df, ["g"], ["k"], "v").collect()}
    for g in ("a", "b", None):
        keys = sorted(k for x, k, _ in rows if x == g)
        for a, b, c in zip([None, *keys], keys, [*keys[1:], None]):
            assert beside[b] == (a, c)


# --- page differencing


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    for _ in range(400):
        k = random.choice([1, 3, 10])
        a, b = ([random.randint(0, k) for _ in range(random.randint(0, 80))] for _ in range(2))
        for most in (1 << 26, 200, 16):
            shared = H.shared_lines(a, b, most)
            rest = iter(b)
            assert len(shared) == lcs(a, b) and shared == sorted(set(shared))
            assert all(any(x == y for y in rest) for x in (a[i] for i in shared))


MARKED = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div id="sidebar-left"><p>Side</p></div><main><article><header><h1>Tit&eacute;l &amp; more</h1></header><p>One
 two&nbsp;<b>three</b><p>Four<br>five <!-- x --><script>var a = "</p>";</script><div class="ad">Buy</div><aside>By</aside>
<form><p>Mail</p></form><p>a &lt; b < c</p></article><section class="comments"><p>First!</p></section></main><footer>End</footer></body></html>"""


def test_marked_article():
    marked, _, texts = H.candidates(MARKED)
    assert marked and texts == ["Titél & more", "One two three", "Four five", "a < b < c"]
    cut = MARKED[: MARKED.index("five")]
    assert H.candidates(cut)[2] == ["Titél & more", "One two three", "Four"]
    assert H.candidates("<article><p>x &am")[2] == ["x &am"] and H.candidates("<article><p>x<p class=")[2] == ["x"]
    assert H.candidates(None)[2] == H.candidates("")[2] == H.candidates("<nav>x</nav>")[2] == []


def test_differencing_deletes_templates_and_keeps_copies(spark):
    page = "<body><div><p>Welcome to the site</p></div><div>{}</div><p>Terms apply</p></body>"
    rows = [(k, f"http://a.org/news/{k}", page.format(f"<p>{sentence(20)}</p><p>{sentence(20)}</p>")) for k in range(6)]
    rows += [(10, "http://b.org/x", MARKED), (11, "http://b.org/y", MARKED), (12, "http://c.org/1", rows[0][2]), (13, "http://c.org/2", rows[0][2])]
    rows += [(20, None, "<p>alone</p>"), (21, "nowhere", None), (None, "http://d.org/", "<p>d</p>"), rows[0], (30, "http://e.org/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("lines"), F.lit(3).alias("text"))
    out = H.extract(df)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    for k in range(6):
        wanted = "\n\n".join(H.candidates(rows[k][2])[2][1:-1])
        assert got[k] == [(wanted, len(wanted))] * (2 if k == 0 else 1)
    assert got[10] == got[11] == [("\n\n".join(H.candidates(MARKED)[2]),) + (len("\n\n".join(H.candidates(MARKED)[2])),)]
    assert got[12][0][0].startswith("Welcome") and got[21] == got[30] == [("", 0)] and got[20] == [("alone", 5)] and got[None] == [("d", 1)]
    assert H.extract(df.limit(0)).count() == 0


def test_differencing_of_marked_pages(spark):
    page = "<body><article><p>Share this story with your friends</p>{}<p>Copyright of the example press</p></article></body>"
    body = [[sentence(30), sentence(30), sentence(30)] for _ in range(3)]
    html = lambda x: page.format("".join(f"<p>{t}</p>" for t in x))
    edited = [*body[0][:2], sentence(30)]
    rows = [(k, f"http://a.org/n/{k}", html(b)) for k, b in enumerate([body[0], body[1], body[2], body[2]])]
    rows += [(k, f"http://b.org/n/{k}", html(b)) for k, b in enumerate([edited, body[0], body[1]], 10)]
    rows += [(20, "http://c.org/1", html(body[0])), (21, "http://c.org/2", html(body[0]))]
    rows += [(30 + k, f"http://d.org/{k}", f"<p>Welcome to the site</p><p>{'terms and ' * 10}</p><p>{k} {sentence(8)}</p>") for k in range(3)]
    got = {r.page_id: r.text.split("\n\n") for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(3)] == body  # 2 has a copy beside it, whose other neighbour shows the template
    assert got[11] == body[0]  # an edited copy on one side
    assert got[20] == got[21] == H.candidates(rows[7][2])[2]  # nothing but copies
    assert got[31] == H.candidates(rows[-2][2])[2][2:]  # a template longer than the text


def test_marked_pages_lose_template_lines_alone(spark):
    """Pages of one host share sentences with both neighbours, some of them often; planted lines are on at least half of the pages."""
    common, planted = [sentence(9) for _ in range(3)], "Read more stories of this kind"
    rows, want = [], {}
    for k in range(30):
        body = [sentence(20), common[k // 10], sentence(15)]  # ten pages in a row have one sentence in common
        lines = [planted, *body] if k % 5 else body
        rows.append((k, f"http://a.org/n/{k:02}", f"<body><nav>Menu</nav><article>{''.join(f'<p>{x}</p>' for x in lines)}</article></body>"))
        want[k] = body
    got = {r.page_id: r.text.split("\n\n") for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    alone = {k for k in range(1, 29) if {k - 1, k + 1} & {0, 5, 10, 15, 20, 25} and k % 5}  # a neighbour lacks the planted line
    assert all(got[k] == ([planted, *want[k]] if k in alone else want[k]) for k in range(30))


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" * 40_000 + "</i>" * 40_000 + "x", "<ul><p><li>" + "<div>" * 60_000 + "x", "<ul><li>" * 40_000 + "x", "<font><p>" * 40_000 + "</font>" * 40_000 + "x"])
def test_deep_pages_take_little_time(page):
    start = time.perf_counter()
    assert H.candidates(page)[2] == ["x"] and time.perf_counter() - start < 10


def test_wrappers_keep_their_article():
    text = lambda page: H.candidates(page)[2]
    side = '<div class="sidebar"><p>Side</p></div>'
    for wrapper in ('form action="/"', 'div class="has-sidebar"', 'div class="elementor-widget-container"', 'div id="content" class="widget"', 'div role="dialog"'):
        for inner in ("<article><p>One two</p></article>", "<main><p>One two</p></main>"):
            assert text(f"<body><{wrapper}><nav>Menu</nav>{inner}{side}</{wrapper.split()[0]}><footer>End</footer></body>") == ["One two"], wrapper
    assert text('<article class="post comments-open sponsored"><p>One</p></article><footer>End</footer>') == ["One"]
    assert text(f"<form><p>A page without marks, of some length</p>{side}</form><p>End</p>")[0].startswith("A page")
    # an article elsewhere, comments and teasers don't reopen
    assert text(f'<article><p>One</p></article><form><article><p>{"Two " * 50}</p></article></form>') [0] == "One"
    assert text('<p>One</p><section class="comments"><article><p>First! ' + "x " * 50 + "</p></article></section>") == ["One"]
    assert text("<div><p>One two three four</p></div><aside><article>Next</article></aside>") == ["One two three four"]


def test_embedded_elements_keep_their_text():
    text = lambda page: H.candidates(page)[2]
    assert text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><object data=f><p>Table</p></object></article>") == ["so x=1 holds", "Table"]
    for tag in ("math", "object", "canvas", "select", "svg", "video", "template"):
        assert text(f"<article><p>One</p><{tag}><p>Two</p></article>") == ["One", "Two"], tag
    assert text("<article><p>One <select><option>a</select><svg><title>t</title><text>u</text></svg>two</p></article>") == ["One two"]
