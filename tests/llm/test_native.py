"""URL filter, quality cascade, mixing and line dedup against brute force and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from scholia.llm import line_dedup, mixing, quality, url_filter
from scholia.llm.queries import RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
FOLD = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, u long, _row int, key string"


def docs(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "x", 2, 3, "k") for d, t, s in rows], DOCS)


LONG = "this line is long enough to be counted as a key by the rule"
ODD = [
    (1, None, "a"), (2, "", "b"), (3, " \n\t\r\n ", None), (4, "one", "a"), (4, "one", "a"), (None, "no id here", "c"), (5, "x\x85y é\xa0z", "c"),
    (6, "a b c a b c d", "a"), (7, "\n".join([LONG, "short", LONG.upper() + "  "]), "b"), (8, LONG, "b"), (9, LONG + "\n\n", "c"), (10, "\t" + LONG, "d"), (11, "z\n" + LONG, "d"),
    (12, "word " * 30_000, "a"), (13, "same line here\nsame line here\nother " + "w " * 60, "b"), (14, "### $$$ %%% " * 40, "b"), (15, "good words only " + " ".join(f"w{i}" for i in range(80)), "a"),
]


def base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality(spark):
    got = quality.cascade(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = Counter((d, *base(t)) for d, t, _ in ODD)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert 15 in kept and 14 not in kept
    assert quality.cascade(docs(spark, ODD).limit(0)).count() == 0
    plan = quality.order_rules(docs(spark, ODD))
    assert {x["rule"].name for x in plan} == {r.name for r in quality.RULES} and all(0 <= x["share"] <= 1 for x in plan)


def test_later_rules_are_not_evaluated_on_rejected_rows(spark):
    d = docs(spark, ODD)
    passing = {r["doc_id"] for r in quality.judged(d, []).collect() if r["kept"]}
    assert passing
    boom = quality.Rule("boom", "raise_error(concat('evaluated on ', n_words)) is null")
    everything, nothing = quality.Rule("everything", "size(_words) > 0"), quality.Rule("nothing", "size(_words) < 0")
    assert not any(r["kept"] for r in quality.judged(d, [everything, boom]).collect())
    for order in ([boom], [boom, everything], [nothing, boom]):
        with pytest.raises(Exception, match="evaluated on"):
            quality.judged(d, order).collect()


def test_order_follows_price_and_selectivity(spark):
    assert quality.greedy({0b01: 10, 0b10: 30, 0: 60}, [1.0, 1.0]) == [1, 0]
    assert quality.greedy({0b01: 10, 0b10: 30, 0: 60}, [1.0, 9.0]) == [0, 1]
    # what the first rule rejects counts no more: the third then rejects more than the second
    assert quality.greedy({0b011: 50, 0b100: 20, 0b010: 5}, [1.0, 1.2, 1.0]) == [0, 2, 1]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60 + i % 40)), "a") for i in range(300)]
    dear = quality.Rule("dear", "size(array_sort(flatten(transform(sequence(1, 40), i -> transform(_words, w -> concat(w, i)))))) % 2 = n_words % 2 and n_words < 80")
    cheap = quality.Rule("cheap", "n_words < 80")
    for rules in ((dear, cheap), (cheap, dear)):
        plan = quality.order_rules(docs(spark, rows), rules)
        assert [x["rule"].name for x in plan] == ["cheap", "dear"] and plan[1]["seconds"] > plan[0]["seconds"]
    kept = Counter(r["kept"] for r in quality.cascade(docs(spark, rows), (dear, cheap)).collect())
    assert kept == Counter(r["kept"] for r in quality.judged(docs(spark, rows), [cheap, dear]).collect())


def test_rules_with_work_of_their_own(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    digits = " ".join(f"{i}.{i}" for i in range(90)) + " " + " ".join(f"w{i}" for i in range(60))
    cut = "\n".join(f"line{i} of{i} a{i} page{i} ... " for i in range(30))
    rows = [(1, prose, "a"), (2, digits, "a"), (3, cut, "a"), (4, cut.replace("...", "…"), "a"), (5, cut.replace("...", "."), "a"), (6, prose.replace("word", "слово"), "a")]
    assert {r["doc_id"] for r in quality.cascade(docs(spark, rows)).collect() if r["kept"]} == {1, 5, 6}


def lines_brute(rows):
    holders, out = defaultdict(set), []
    key = lambda x: x.strip(SPACE).translate(FOLD)
    for d, t, _ in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    holders[key(x)].add(d)
    for d, t, _ in rows:
        ls = (t or "").split("\n")
        kept = ls if d is None else [x for x in ls if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("share", [1000, 1])
def test_line_dedup(spark, monkeypatch, share):
    rows = ODD + [(100 + i, "\n".join([f"head {i}", LONG, "q" * 45, LONG]), "z") for i in range(1200)]
    if share == 1:
        monkeypatch.setattr(line_dedup, "HOT_SHARE", 10**9)  # more than 1000 rows make a hash hot
    d = docs(spark, rows)
    got = line_dedup.digest(d, line_dedup.keep_bitmaps(d)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == Counter(lines_brute(rows))
    out = line_dedup.dedup_lines(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes and out.count() == len(rows)
    texts = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect())
    assert texts == Counter((a, e) for a, _, _, e in lines_brute(rows))


def test_line_dedup_positions_past_a_word(spark):
    rows = [(i, "\n".join([f"l{i}-{k}" for k in range(130)] + [LONG] + ["end"]), "a") for i in range(6)]
    d = docs(spark, rows)
    got = line_dedup.digest(d, line_dedup.keep_bitmaps(d)).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == sorted(lines_brute(rows))
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_water_fill():
    sizes, weights = {"a": 1000, "b": 10, "c": 10, None: 5}, {"a": 1, "b": 2, "c": 3, None: 1}
    t = mixing.water_fill(sizes, weights)
    assert sum(t.values()) == 1025 and t["b"] == 30 and t["c"] == 30 and t[None] == 15 and t["a"] == 950
    assert mixing.water_fill({"a": 0}, {"a": 1}) == {"a": Fraction(0)} and mixing.water_fill({}, {}) == {}
    assert mixing.cyclic_weights(["b", None, "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}


@pytest.mark.parametrize("few", [4096, 2])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "_FEW", few)
    rows = ODD + [(1000 + i, "w " * (i % 50), "abcdefg"[i % 7] if i % 3 else "hot") for i in range(3000)]
    d = docs(spark, rows)
    got = mixing.mix_table(d).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_table(d.repartition(7)).collect()))
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
    out = mixing.mix(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    assert Counter(r["doc_id"] for r in out.collect()) == +sum((Counter({r["doc_id"]: r["reps"]}) for r in got), Counter())
    assert mixing.mix_table(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1, 3])
def test_any_number_of_sources(spark, monkeypatch, few):
    """Planned as a table and broadcast in pieces, the mix is that of the driver's plan."""
    rows = ODD + [(1000 + i, "w " * (i % 50), f"s{i % 11}" if i % 3 else "hot") for i in range(2000)]
    d = docs(spark, rows)
    facts = lambda: sorted(map(str, mixing.mix_table(d).collect()))
    taken = lambda: Counter(str(r) for r in mixing.mix(d).collect())
    want, mixed = facts(), taken()
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    assert facts() == want and taken() == mixed
    assert mixing.mix_table(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    given = spark.createDataFrame([("hot", 5), ("a", 1), (None, 2)], "source string, weight long")
    many = sorted(map(str, mixing.mix_table(d, weights=given).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1000)
    assert many == sorted(map(str, mixing.mix_table(d, weights=given).collect()))


def test_mixing_moves_no_text(spark):
    out = mixing.mix(docs(spark, ODD + [(1000 + i, "w " * (i % 50), "abc"[i % 3]) for i in range(300)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not moves and plan.count("BroadcastExchange") >= 1
    # what is broadcast is the table of sources
    for part in plan.split("BroadcastExchange")[1:]:
        assert "upto" in part.split("Scan")[1] and "text" not in part.split("Scan")[1].split("ReadSchema")[-1].split("\n")[0]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "http://EXAMPLE.com/en/1?x=/en/", "https://www.example.com/en/2", "http://a.b.example.com/en", "http://badexample.com/en/", "ftp://x.net/es/1#a",
            "http://x.net/esx", "http://net/fr/", "http://x.com", "http://É.org/é?q", "http://h/a\nb#c", "a://b://c/d", "http://casino-bonus.example.org/casino/slots", "x" * 20_000]
    pages = spark.createDataFrame([(i, u, "h", "x", "y") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string, rule string")
    got = url_filter.judge(pages, RULES).collect()
    assert len(got) == 2 * len(urls)
    rules = url_filter.parse_rules(RULES)
    weights, bias = url_filter.train()
    for r in got:
        host, path = url_brute(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fit = next(((n, v) for n, h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
        grams = url_filter._grams(host, path)
        z = sum(weights[url_filter._bucket(g)] for g in grams) + bias * max(len(grams), 1)
        assert (r["rule"], r["verdict"]) == (fit[0], fit[1] or ("block" if z > 0 else "allow"))
    assert {r["rule"] for r in got if r["page_id"] == 5} == {"www.example.com/en/"}
    assert {r["verdict"] for r in got if r["page_id"] == 15} == {"block"}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert url_filter.train([]) == ([0] * url_filter.BUCKETS, 0)


def test_url_model_learns_its_table():
    w, b = url_filter.train()
    rows = url_filter.labelled_urls()
    right = sum(((sum(w[url_filter._bucket(g)] for g in url_filter._grams(h, p)) + b * len(url_filter._grams(h, p))) > 0) == bool(y) for h, p, y in rows)
    assert right >= 0.95 * len(rows)


def test_facts_of_sources_start_no_python_worker(spark):
    for rows in ([("b", 5), (None, 3), ("a", 0)], []):
        facts = mixing._few_facts(spark.createDataFrame(rows, "source string, source_size long"), None, 3)
        assert "ExistingRDD" not in facts._jdf.queryExecution().toString()
        assert sorted(map(str, facts.select("source", "source_size").collect())) == sorted(f"Row(source={s!r}, source_size={n})" for s, n in rows)
