"""Quality rules as a short-circuit cascade.

Every rule owns its work: an expression over the text, its words and the base counts. On a bounded sample
of rows that pass the base, a rule's price is the time of many evaluations less that of none, and one
table of which rules reject which rows gives every rule's share behind any others. Rules then run in the
order of rejection per price, greedily, each only on rows that the base and the rules before it let
through; the base counts are columns of the result and made for every row. The order saves work and never
changes a verdict. Native: higher-order functions and SQL expressions only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
#: Expected rows of the sample on which prices and selectivities are estimated, and how often a rule is evaluated on each to be timed.
SAMPLE_ROWS, REPEAT = 2000, 20


def words(text: Column) -> Column:
    """[^\\x20\\x09-\\x0D]+ of the text; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " +", -1), lambda w: w != "")


def _chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id and the base counts of each row; null texts count as empty ones."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", t.alias("_t")).withColumn("_w", words(F.col("_t")))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", SPACE, "")).cast("long"),
        "n_symbols": _chars_of(F.col("_t"), SYMBOLS).cast("long"),
        "_lines": F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, SPACE, "") != ""),
    })
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # 3-word windows are compared by 64-bit hashes, never by text: a chance equality among a text's n windows has odds of n * n / 2**65
    d = d.withColumn("_h", F.expr("case when n_words >= 3 then transform(sequence(0, int(n_words) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) else array() end"))
    d = d.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(_repeat_words()).cast("long"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("_t").alias("_text"), F.col("_w").alias("_words"))


def _repeat_words() -> Column:
    """Words in windows whose hash is found twice or more: hashes sorted with their positions, equal neighbours marked."""
    return F.expr(r"""
      size(array_distinct(flatten(transform(
        filter(
          transform(array(array_sort(filter(transform(_h, (h, i) -> struct(h as h, i as i)), x -> true))), s ->
            filter(transform(s, (x, k) -> case
              when (k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h) then x.i end), p -> p is not null))[0],
          p -> true),
        p -> array(p, p + 1, p + 2)))))""")


@dataclass(frozen=True)
class Rule:
    """name, and SQL that is true where the rule rejects, over _text, _words, n_words and the other base counts."""

    name: str
    rejects: str


#: Production rules, lenient: prose of any language passes them.
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    Rule("repeated_lines", r"100 * n_dup_lines > 30 * (1 + length(_text) - length(replace(_text, '\n', '')))"),
    # half of the words have no letter: neither A-Z, a-z nor anything beyond ASCII
    Rule("few_letters", r"2 * regexp_count(_text, '(?<![^\\x20\\x09-\\x0D])[\\x00-\\x08\\x0E-\\x1F\\x21-\\x40\\x5B-\\x60\\x7B-\\x7F]++(?![^\\x20\\x09-\\x0D])') > n_words"),
    # half of the lines break off
    Rule("cut_lines", r"2 * regexp_count(_text, '(?:[.][.][.]|…)[\\x20\\x09\\x0B-\\x0D]*+(?=\\n|\\z)') > 1 + length(_text) - length(replace(_text, '\n', ''))"),
    Rule("too_long", "n_words > 1000000"),
)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def prices(sample: DataFrame, rules) -> list[float]:
    """Seconds of one evaluation of each rule: the better of two jobs that evaluate it REPEAT times a row, less one that evaluates nothing."""
    rows = max(sample.count() * REPEAT, 1)
    again = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))).alias("_again"))

    def took(condition: Column) -> float:
        seconds = []
        for _ in range(2):
            start = time.perf_counter()
            again.agg(F.count_if(condition)).first()
            seconds.append(time.perf_counter() - start)
        return min(seconds)

    nothing = took(F.col("_again") < 0)
    return [max(took(F.expr(r.rejects)) - nothing, 0.0) / rows for r in rules]


def greedy(rejected: dict[int, int], price: list[float]) -> list[int]:
    """Order of rules: next is always the one that rejects most of what is left per price. rejected: rows by the set of rules (bits) that reject them."""
    left, order, floor = dict(rejected), [], 1e-9
    while len(order) < len(price):
        worth = {k: sum(n for bits, n in left.items() if bits >> k & 1) / max(price[k], floor) for k in range(len(price)) if k not in order}
        best = max(worth, key=lambda k: (worth[k], -price[k], -k))
        order.append(best)
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in the order of evaluation, with their price in seconds and their share of rejected rows; an empty sample leaves them as they are.

    The sample is each row with the same seeded chance, about sample_rows in all, of which those that pass
    the base are judged: no rule is evaluated on others. Only the order of evaluation depends on it.
    """
    total = docs.count()
    # kept before it is filtered: a filter below the counts would count again for every word
    kept = with_base(docs.sample(min(1.0, sample_rows / max(total, 1)), seed=4)).repartition(8).persist()
    sample = kept.where(~base_failed())
    try:
        bits = sum((F.expr(r.rejects).cast("long") * F.lit(1 << k) for k, r in enumerate(rules)), F.lit(0).cast("long"))
        rejected = {int(r["bits"]): r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
        n = sum(rejected.values())
        price = prices(sample, rules) if n else [0.0] * len(rules)
    finally:
        kept.unpersist()
    order = greedy(rejected, price) if n else range(len(rules))
    return [{"rule": rules[k], "share": sum(c for b, c in rejected.items() if b >> k & 1) / max(n, 1), "seconds": price[k]} for k in order]


def cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept: one row for each row of docs, texts read whole.

    A null or empty text has no words and fails the base; repeated rows are judged alike; an empty table
    gives an empty result; other columns are not read.
    """
    return judged(docs, [x["rule"] for x in order_rules(docs, rules, sample_rows)])


def judged(docs: DataFrame, ordered: list[Rule]) -> DataFrame:
    """The cascade in a given order: CASE evaluates a rule only on rows that no earlier condition has decided."""
    verdict = F.when(base_failed(), False)
    for r in ordered:
        verdict = verdict.when(F.expr(r.rejects), False)
    return with_base(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"))


QUALITY_SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as wl from t),
b as (select rid, doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(wl) - len(list_distinct(wl)))::bigint as n_dup_lines, len(ls) as nl,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as lettered, len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) as cut from w),
x as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as win from x),
r as (select rid, i, count(*) over (partition by rid, win) as n from g),
p as (select rid, count(distinct q)::bigint as n from (select rid, unnest([i, i + 1, i + 2]) as q from r where n > 1) group by rid),
f as (select b.*, coalesce(p.n, 0)::bigint as n_repeat_words from b left join p using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words or word_chars > 20 * n_words or word_chars < 2 * n_words or 100 * n_dup_lines > 30 * nl
    or 2 * lettered < n_words or 2 * cut > nl or n_words > 1000000) as kept
from f
"""
