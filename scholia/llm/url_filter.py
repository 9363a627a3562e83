"""URL filtering: longest matching host/path rule, else logistic regression on hashed character n-grams.

Native: parsing, rules, hashing and scoring are column expressions; the model is a constant array of
integer weights, fitted on the driver to a small labelled table of URLs that is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import ascii_lower

#: Weights are fixed-point integers: sums are exact, so every engine and every order agrees.
SCALE = 1_000_000
BUCKETS, GRAM = 512, 3

#: A small labelled URL table (1 = block), host and path as they would be parsed.
_ALLOW_HOSTS = "news.example.org www.library.example.org docs.example.net blog.garden.example.net m.history.example.net science.example.org wiki.example.org shop.example.net uni.example.org museum.example.net press.example.net forum.example.org".split()
_ALLOW_PATHS = "/en/12 /de/7.html /fr/881/ /es/45 /articles/2021/climate /wiki/Main_Page /blog/a-day-out /docs/intro.html /about / /en/302.html /research/paper".split()
_BLOCK_HOSTS = "casino-bonus.example.net free-poker.example.org xxx-cams.example.net adult-tube.example.org cheap-pills.example.net viagra-store.example.org track.clickads.example.net warez-crack.example.org hot-dating.example.net bet-slots.example.org keygen-serial.example.net adserver.example.org".split()
_BLOCK_PATHS = "/casino/slots /poker/bonus /xxx/video /porn/tube /pills/viagra /cheap/cialis /adclick?x /warez/crack /dating/hot /bet/jackpot /keygen/serial /banner/ads".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, blocked) rows: each host with three paths of its own kind, and harmless paths on harmful hosts."""
    rows = []
    for hosts, paths, label in ((_ALLOW_HOSTS, _ALLOW_PATHS, 0), (_BLOCK_HOSTS, _BLOCK_PATHS, 1)):
        for i, host in enumerate(hosts):
            rows += [(host, paths[(i + k) % len(paths)], label) for k in range(3)]
    return rows + [(host, _ALLOW_PATHS[i], 1) for i, host in enumerate(_BLOCK_HOSTS)]


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % BUCKETS


def _grams(host: str, path: str) -> list[str]:
    s = f"^{host}|{path}$"
    return [s[i : i + GRAM] for i in range(len(s) - GRAM + 1)]


def train(rows: Sequence[tuple[str, str, int]] | None = None, epochs: int = 300, rate: float = 0.5, l2: float = 1e-3) -> tuple[list[int], int]:
    """(weights, bias) in fixed point, by full-batch gradient descent; rows None: labelled_urls(). No rows: all zero."""
    rows = labelled_urls() if rows is None else list(rows)
    data = [([_bucket(g) for g in _grams(h or "", p or "")], y) for h, p, y in rows]
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(epochs if data else 0):
        grad, gb = [l2 * x for x in w], 0.0
        for feats, y in data:
            n = max(1, len(feats))
            z = b + sum(w[f] for f in feats) / n * 10
            e = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) / len(data)
            gb += e
            for f in feats:
                grad[f] += 10 * e / n
        w = [x - rate * 10 * g for x, g in zip(w, grad, strict=True)]
        b -= rate * gb
    return [round(x * SCALE) for x in w], round(b / 10 * SCALE)


@functools.cache
def default_model() -> tuple[tuple[int, ...], int]:
    """train() on labelled_urls(), once a process."""
    weights, bias = train()
    return tuple(weights), bias


def parse_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(rule, host, path, verdict), longest rule first, ties by code point; at most 1000 of them: they become one expression."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    out = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules]
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z folded; null or no ://: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def model_score(host: Column, path: Column, model: tuple[list[int], int]) -> Column:
    """Fixed-point logit times the number of n-grams; its sign is the verdict."""
    weights, bias = model
    s = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    table = F.array(*map(F.lit, weights))
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - F.lit(GRAM - 1), F.lit(1)))
    bucket = lambda i: F.conv(F.substring(F.md5(F.substring(s, i, GRAM).cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
    total = F.aggregate(starts, F.lit(0).cast("long"), lambda a, i: a + F.element_at(table, bucket(i) + 1))
    return total + F.lit(bias) * F.size(starts)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: tuple[list[int], int] | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict ('allow' or 'block').

    Null urls and urls without :// have empty host and path, fit no rule and go to the model; an empty
    table gives an empty result; repeated rows are judged alike; other columns are not read.
    """
    model = default_model() if model is None else model
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, said = F.lit(None).cast("string"), F.when(model_score(host, path, model) > 0, "block").otherwise("allow")
    for name, h, p, verdict in reversed(parse_rules(rules)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, said = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"))


def judge_sql(rules: Sequence[tuple[str, str]], model: tuple[list[int], int] | None = None) -> str:
    """The same in DuckDB's SQL."""
    weights, bias = default_model() if model is None else model
    fits = [(n, f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))", v) for n, h, p, v in parse_rules(rules)]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{lower}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, '^' || host || '|' || path || '$' as s from b),
d as (select *, list_sum(list_transform(range(1, greatest(length(s) - {GRAM - 2}, 2)), lambda i: ({list(weights)}::bigint[])[('0x' || substr(md5(substr(s, i::bigint, {GRAM})), 1, 4))::bigint % {BUCKETS} + 1])) + {bias} * greatest(length(s) - {GRAM - 1}, 1) as z from c)
select page_id, host, path, case {' '.join(f"when {f} then '{n}'" for n, f, _ in fits)} end as rule,
  case {' '.join(f"when {f} then '{v}'" for _, f, v in fits)} when z > 0 then 'block' else 'allow' end as verdict from d"""
