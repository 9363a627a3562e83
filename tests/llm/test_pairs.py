"""Jaccard join, components, HTML extraction and exact search."""

import re
import time
from collections import Counter
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import html_extract, jaccard_join, topk
from scholia.llm.common import BATCH_BYTES, bounded_batches
from scholia.llm.components import components
from scholia.llm.queries import ORACLES, QUERIES
from scholia.llm.shingles import shingle_sets
from tests.oracle import same

R = Random(3)


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], "doc_id long, text string, n int, node int, component int, key string")


def shingles(t, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {d: root(d) for d in up}


def texts():
    word = lambda: R.choice("abcdefgh") + R.choice("xyzw") + str(R.randrange(60))
    passage = [word() for _ in range(60)]
    out, doc = [], 0
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 4, max(1, size // 12), max(1, size // 25)):
                w = list(base)
                for _ in range(edits):
                    k = R.randrange(len(w) + 1)
                    w[k : k + R.randrange(2)] = [word() for _ in range(R.randrange(2))]
                out.append((doc, " ".join(w)))
                doc += 7
    out += [(10_000 + i, " ".join([word() for _ in range(R.randrange(5, 70))] + passage)) for i in range(40)]
    chain = [word() for _ in range(120)]
    for i in range(30):  # neighbours link, ends do not
        chain = chain[2:] + [word(), word()]
        out.append((20_000 + i, " ".join(chain)))
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "A"), (5, "a"), (None, "a"), (6, "a\x85b c"), (8, "long " * 3000), (9, "LONG " * 2999), (11, "same id one two three four five"), (11, "another text with the same id at all"), (12, "another text with the same id at all")]
    return out + odd + out[:3]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_groups(spark, n, num, den):
    rows = texts()
    got = jaccard_join.similar_groups(table(spark, rows), n, num, den).collect()
    want = groups(rows, n, num, den)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, len(shingles(t, n)), want.get(d)) for d, t in rows)


@pytest.mark.parametrize("limit", [0, 9, 60])
def test_any_light_limit_gives_the_same_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "light_limit", lambda *a: limit)
    monkeypatch.setattr(jaccard_join, "FEW_IDS", 0)
    rows = texts()
    want = groups(rows, 4, 85, 100)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(table(spark, rows), 4, 85, 100).where("doc_id is not null").collect()} == want


@pytest.mark.parametrize(("num", "den"), [(1, 2), (1, 3)])
@pytest.mark.parametrize("limit", [None, 0, 3])
def test_low_thresholds(spark, monkeypatch, num, den, limit):
    """Sets of one to a few elements, of which one shared element may suffice; None: the cost model's own limit."""
    if limit is not None:
        monkeypatch.setattr(jaccard_join, "light_limit", lambda *a: limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    r = Random(limit or 0)
    rows = [(1, "a"), (2, "a b"), (3, "zz yy"), (4, "zz yy xx"), (5, "q"), (6, "q w e"), (7, "m n o"), (8, "n o p"), (9, "o p m n")]
    rows += [(10 + i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(i // 12) for _ in range(r.randrange(1, 9)))) for i in range(120)]
    want = groups(rows, 1, num, den)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(table(spark, rows), 1, num, den).collect()} == want


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n, k in ((20, 3), (300, 40), (2000, 700), (5, 5)):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        y = np.concatenate([x[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])
        differ = sum(int(a ^ b).bit_count() for a, b in zip(jaccard_join.parity(x).view(np.uint64).tolist(), jaccard_join.parity(y).view(np.uint64).tolist()))
        assert differ <= len(set(x.tolist()) ^ set(y.tolist())) and (differ > k // 2 or n == 5)
    assert not jaccard_join.parity(np.zeros(0, np.uint64)).any()


def test_near_copies_that_link_with_each_other_alone(spark):
    """Members that do not link with their lists' heads meet in blocks; of these pairs next to none is made that is no link."""
    words = [f"w{i}" for i in range(200)]
    r = Random(8)
    rows = []
    for i in range(150):
        w = list(words)
        for k in r.sample(range(200), 8):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 150, 3)]
    join = jaccard_join.JaccardJoin(table(spark, rows), 4, 85, 100)
    made = []
    links = join._links
    join._links = lambda pairs: made.append(jaccard_join.scratch(pairs, "made")) or links(made[-1])
    members, _ = join.run()
    assert {r["doc_id"]: r["component"] for r in members.collect()} == groups(rows, 4, 85, 100)
    assert made[1].count() < 20 * 150


@pytest.mark.parametrize(("n", "num", "den", "block"), [(4, 85, 100, 1000), (5, 4, 5, 7)])
def test_all_links(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = texts()
    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    want = {d: set() for d, _ in sets}
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and den * len(x & y) >= num * len(x | y):
            want[a].add(b)
            want[b].add(a)
    got = jaccard_join.link_counts(table(spark, rows), n, num, den).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == Counter((d, len(shingles(t, n)), len(want.get(d, ()))) for d, t in rows)
    assert jaccard_join.link_counts(table(spark, rows).limit(0), n, num, den).count() == 0


def test_one_of_each(spark):
    d = table(spark, [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q r s t u v w"), (None, "a b c d e f g"), (9, None)])
    kept = jaccard_join.keep_one_of_each(d)
    assert kept.columns == d.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "9", "None"]
    assert jaccard_join.keep_one_of_each(d.limit(0)).count() == 0
    texts = [(1, "a b c d e f g"), (1, "k l m n o p q"), (1, "k l m n o p q"), (1, None), (1, ""), (2, "K l m n o p q"), (3, "r s t u v w x")]
    several = jaccard_join.keep_one_of_each(table(spark, texts))
    assert Counter((r["doc_id"], r["text"]) for r in several.collect()) == Counter({(1, "a b c d e f g"): 1, (1, "k l m n o p q"): 1, (1, None): 1, (1, ""): 1, (3, "r s t u v w x"): 1})
    others = spark.createDataFrame([(1, "t", "b"), (1, "t", "a"), (1, "t", None)], "doc_id long, text string, lang string").repartition(3)
    assert [r["lang"] for r in jaccard_join.keep_one_of_each(others).collect()] == [None]
    assert jaccard_join.similar_groups(d.limit(0)).count() == 0


def test_light_limit_follows_cost():
    sizes = dict.fromkeys(range(1, 400), 10)
    limits = [jaccard_join.light_limit(sizes, x, 85, 100) for x in (0.5, 3, 20, 100)]
    assert limits == sorted(limits) and limits[0] < limits[-1]


def test_copies_and_a_full_sketch_make_no_more_keys(spark, monkeypatch):
    """Where a bucket's mean is high, by copies or by other elements, sets still stand in lists: 2-subsets of long prefixes are many times the entries."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 120)) for _ in range(20)]
    seen, limit = [], jaccard_join.light_limit
    monkeypatch.setattr(jaccard_join, "light_limit", lambda *a: seen.append(limit(*a)) or seen[-1])
    docs = spark.createDataFrame([(k * 20 + i, t) for k in range(60) for i, t in enumerate(texts)], "doc_id long, text string")
    join = jaccard_join.JaccardJoin(docs, 4, 85, 100)
    # 117 shingles, of which a link shares 100: 18 entries, but 171 subsets of two
    assert {len(r["keys"]) for r in join._entries().collect()} == {18}
    assert seen[0] < 117
    members, _ = join.run()
    assert {(r["node"], r["component"]) for r in members.collect()} == {(i, i) for i in range(20)}
    # as many copies as are not sent round
    monkeypatch.setattr(jaccard_join, "FEW_COPIES", 0)
    again, _ = join.run()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, members.collect()))


def test_components(spark):
    edges = [(R.randrange(60), R.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_sets_count_like_python():
    rows = [t for _, t in texts()] + ["x " * 400_000 + "end"]
    for n in (1, 4, 5):
        assert [len(s) for s in shingle_sets(rows, n)] == [len(shingles(t, n)) for t in rows]


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_mixing", "op6_ngram_jaccard", "op7_line_dedup", "op9_url_filter", "op10_topk_search"])
def test_against_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body class="with-sidebar"><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies, please accept them. Thanks.</div><!-- no --><aside id="sidebar"><p>Popular, posts. Here, there.</p></aside>
%s<div class="ad">Buy now, cheap, today!</div><footer>&copy; Site</footer></body></html>"""
BODY = "<h1>Head&shy;line &amp; more</h1><p>First long paragraph, with many words,\n and commas.&nbsp; It goes on, really, until it stops.<p>Short.<p>Another <b>long</b> one, with text; it has punctuation, too. And <a href=x>a link</a> inside &lt;b&gt;."
TEXT = "Head\xadline & more First long paragraph, with many words, and commas. It goes on, really, until it stops. Short. Another long one, with text; it has punctuation, too. And a link inside <b>."


@pytest.mark.parametrize("page", [
    PAGE % f"<article>{BODY}</article>",
    PAGE % f"<main><div class='c1'>{BODY}</div><form>Subscribe, please: <input><button>Go</button></form></main>",
    PAGE % f"<div class='post'>{BODY}</div><section id='comments'><article class='comment'><p>I disagree, strongly, with this. Nice, though.</p></article></section>",
    PAGE % f"<article><header>{BODY[:BODY.index('<p>')]}</header>{BODY[BODY.index('<p>'):]}</article><div class='related'><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>",
    PAGE % f"<div class='site-header'>Site, name. And more.</div><div id='pageContent'><div class='post-content'>{BODY}</div><div class='page-footer'>Foot, note. And so on, here.</div></div><div class='mainMenu'><p>Some, menu. Text, here.</p></div>",
    PAGE % f"<div><div>{BODY}</div></div><div class='adContainer main'><p>Win, now. Really, do.</p></div><div role='complementary'>More, of it. Here, too.</div>",
    (PAGE % f"<article>{BODY}")[: (PAGE % f"<article>{BODY}").index("<div class=\"ad\"") + 6],
])
def test_main_text(page):
    assert html_extract.main_text(page) == TEXT


def test_container_does_not_override_the_paths():
    first, second = "An introduction, with some words; it leads in, gently, to the rest.", "The text itself, which is long, and has commas; it goes on, and on. " * 6
    page = "<html><body><div class='%s'><p>" + first + "</p></div><div class='%s'><p>" + second + "</p></div></body></html>"
    assert html_extract.main_text(page % ("intro", "text")) == " ".join(f"{first} {second}".split())
    parts = page.replace("<div class='%s'>", "<article>").replace("</div>", "</article>")
    assert html_extract.main_text(parts) == " ".join(f"{first} {second}".split())
    links = "<ul>" + "<li><a href=x>Elsewhere</a></li>" * 8 + "</ul>"
    assert html_extract.main_text(f"<body><div class=text><p>{second}</p><p>Short.</p>{links}<p>{second}</p></div></body>") == " ".join(f"{second} Short. {second}".split())


def test_path_scores_decide(spark, sf):
    page = PAGE % f"<article>{BODY}</article>"
    assert " ".join(b.text for b in html_extract.blocks(page)) != TEXT  # the menu, the notice and the advert are among the blocks
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert all(len(html_extract.select(b)) < len(b) for b in map(html_extract.blocks, pages))


def test_pages_without_telling_names():
    """No article, main, nav or class names: ratios alone tell prose from link lists, buttons of text and one-line boxes."""
    menu = "<div><div><a href=1>Home</a></div><div><a href=2>World</a></div><div><a href=3>Sport</a></div></div>"
    box = "<div><div><div>Buy now</div></div></div>"
    foot = "<div><div><div>Imprint</div><div>Terms</div><div>Site 2024</div></div></div>"
    page = f"<html><body>{menu}{box}<div><div>{BODY}</div></div>{foot}</body></html>"
    assert html_extract.main_text(page) == TEXT
    scores = html_extract.path_scores(html_extract.blocks(page))
    assert len(set(scores.values())) > 3


@pytest.mark.parametrize("attrs", ["title=don't", "title = don't", "x='a>b' y=it's", 'x="a > b" title=a=\'b', "title=\"it's\"", "data-x=5' z"])
def test_quotes_begin_values_only(attrs):
    page = f"<article><p {attrs}>First, para. It is long.</p><p>It's the second, one.</p><p>Third, one.</p></article>"
    assert html_extract.main_text(page) == "First, para. It is long. It's the second, one. Third, one."


def test_deep_nesting_is_linear():
    def took(n):
        start = time.perf_counter()
        for open_, close in (("<div>", "</div>"), ("<ul><li>", ""), ("<div><p>a<b>", ""), ("<svg>", "")):
            html_extract.main_text(open_ * n + "word, and more." + close * n)
        return time.perf_counter() - start

    took(1000)
    assert html_extract.main_text("<div>" * 100_000 + "word, and more." + "</div>" * 100_000) == "word, and more."
    assert took(50_000) < 25 * max(took(5_000), 0.05)


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain, only"), (3, "u", "plain, only"), (4, "u", "<p>a<p>b<div"), (5, "u", "<script>x"), (6, "u", "<article>" + "<p>word, and more.</p>" * 20_000), (7, "u", "<div " * 50 + "<<>>&am; &#x41;")]
    pages = spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[5] == "" and by[3] == "plain, only" and by[4] == "a b" and by[6] == " ".join(["word, and more."] * 20_000)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_extract_given_pages(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = r["html"].split("<article>", 1)[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"<(/?p|/?h1|br)>", " ", body))).split())
        assert html_extract.main_text(r["html"]) == want


def test_search_odd_rows(spark):
    rows = [(i, [R.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(6)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None, 2.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (20, [1.0] * 6, 0), (304, [], 0), (None, [1.0] * 6, 0)]
    v = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rank int, score int")
    scaled = topk.scaled(v)
    fine = [(i, np.floor(64 * np.array(e))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for q, x in fine:
        if q % 20 == 0:
            scored = sorted((-int(sum(a * b for a, b in zip(x, y))), i) for i, y in fine if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    for sizes in ((512, 8192), (4, 50)):
        got = topk.search(scaled, scaled.where("vec_id % 20 = 0"), 20, *sizes).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == Counter(want)
    assert topk.search(scaled.limit(0), scaled.limit(0)).count() == 0
    few = scaled.where("vec_id in (0, 1, 2)")
    assert topk.search(few, few.where("vec_id = 0")).count() == 2


def test_search_own_row_only(spark, tmp_path):
    """By the contract every row but the query's own is a candidate: rows that repeat its id, or have none, are too."""
    rows = [(i, [R.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(6)]) for i in range(100)]
    rows += [(20, [1.0] * 6), (40, rows[40][1]), (40, rows[40][1]), (None, [1.0] * 6), (None, rows[60][1]), (60, None), (2**60 + 1, [1.0] * 6), (80, [0.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    fine = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if e is not None]
    want = []
    for at, (q, x) in enumerate(fine):
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for j, (i, y) in enumerate(fine) if j != at)[:20]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(scored)]
    vectors = topk.scaled(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    blocks = topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20, 4, 16, own_row=True)
    for got in (QUERIES["op10_topk_search"](spark, str(tmp_path)), blocks):
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == Counter(want)


def test_search_loses_no_query_in_many_partitions(spark):
    """Cells of both sides must meet when partitions are not coalesced."""
    rows = [(i, [float(R.randrange(-9, 9)) for _ in range(4)]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = topk.search(v, v.where("vec_id % 20 = 0"), 20, 5, 50).collect()
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)
    want = []
    for q, x in rows[::20]:
        scored = sorted((-int(sum(a * b for a, b in zip(x, y))), i) for i, y in rows if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == Counter(want)


def test_accumulate_is_exact():
    for top in (3, 5000, 2**26, 2**40):
        rng = np.random.default_rng(top)
        q, b = rng.integers(-top, top, (3, 8)).astype(float), rng.integers(-top, top, (20, 8)).astype(float)
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in q]
        assert [[int(x) for x in r] for r in topk.accumulate(q, b)] == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    line = "a line of more than forty characters that many documents share"
    rows = [(i, f"the number {i} of words and that was {' '.join(R.choice(('the', 'and', 'of', 'that')) + str(R.randrange(900)) for _ in range(60))}\n{line}", "en", f"s{i % 3}", 5) for i in range(60)]
    rows += [(100, rows[7][1].replace(line, "") + line, "en", "s1", 5), (101, None, "en", "s1", 0), (102, "12 34", "en", "s2", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    seen, docs = {}, frame
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.scratch(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name].columns == frame.columns
    assert {r["doc_id"] for r in seen["language_id"].collect()} == set(range(60)) | {100}
    assert sum(line in r["text"] for r in seen["line_dedup"].collect()) == 1
    near = {r["doc_id"] for r in seen["ngram_jaccard_join"].collect()}
    assert near == set(range(60))
    assert docs.count() > 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_arrow_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    try:
        spark.conf.unset(key)
        bounded_batches(spark)
        long_rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), BATCH_BYTES // 50).alias("t"))
        counts = [r["n"] for r in long_rows.mapInArrow(sizes, "n long").collect()]
        assert sum(counts) == 200 and max(counts) <= 100
        spark.conf.set(key, "123456")
        bounded_batches(spark)
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key)


def test_large_scratch_tables_leave_no_shuffle_files(spark, monkeypatch):
    """The shuffle files behind a large table go once it is written, so those of the join's steps do not lie side by side."""
    import time

    from scholia.llm import common

    monkeypatch.setattr(common, "LARGE_S", 0, raising=False)
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        found = [files.apply(k) for k in range(files.size())]
        return sum(f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))

    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffled()
    common.scratch(spark.range(200_000).selectExpr("hash(id) as h", "id").repartition(4, "h"), "t")
    for _ in range(10):
        if shuffled() - before < 20_000:
            break
        time.sleep(0.5)
    assert shuffled() - before < 20_000


def test_join_deletes_its_entries(spark):
    """Tables of keys and sets are gone when the groups are known, and the groups are right."""
    import os

    from scholia.llm import common

    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, text), (4, "other words stand in this one"), (5, None)], "doc_id long, text string")
    common.clear_scratch(spark)
    members, _ = jaccard_join.JaccardJoin(docs).run()
    folder = f"{common.shared_dir(spark)}/scholia-{spark.sparkContext.applicationId}".removeprefix("file:")
    left = {name.rsplit("-", 1)[0] for name in os.listdir(folder)}
    assert "sizes" in left and not left & {"entries", "listed", "shared", "sets", "pairs"}
    assert sorted((r["doc_id"], r["component"]) for r in members.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
