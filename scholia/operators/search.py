"""BM25 search: rewrite on the driver against the lexicon, then one declarative plan for every mode."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import df_penalty
from scholia.operators.fuzzy import TERMS, fuzzy_candidates
from scholia.operators.index import Index
from scholia.plans.search_plan import SearchPlan, is_query_stopword, parse_search

K1, B = 1.2, 0.75
STOPWORD_WEIGHT, PHRASE_GAIN = 0.35, 0.85
#: Up to so many terms a raw corpus is scored by a scan.
FEW_TERMS = 32
#: Up to so many hits of a page are fetched by id.
FEW_HITS = 10_000
#: The bounded phrase path re-ranks this many times the page, within these limits.
RERANK, RERANK_LEAST, RERANK_MOST = 16, 256, 4096


@dataclass
class Profile:
    """How a query went: the path, its timers in milliseconds and its counters."""

    path: str = "empty"
    timers: dict[str, float] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def as_row(self) -> dict:
        return {"path": self.path} | {f"{k}_ms": round(v, 3) for k, v in self.timers.items()} | self.counters


def idf(df: Column, n: int) -> Column:
    return F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1.0)


def term_score(df: Column, tf: Column, length: Column, n: int, avg: float) -> Column:
    norm = K1 * ((1 - B) + B * F.greatest(length.cast("double"), F.lit(1.0)) / F.lit(avg or 1.0))
    return idf(df, n) * df_penalty(df / F.lit(float(n))) * tf * (K1 + 1) / (tf + norm)


@dataclass
class Facts:
    """Of a corpus: documents, average length, and how many documents hold each known term."""

    n: int
    avg: float
    df: dict[str, int]


def facts_of(index: Index, terms: list[str]) -> Facts:
    """From a stored index by lookup; from a raw corpus in one scan without a shuffle, where the terms are few."""
    if index.stored or len(terms) > FEW_TERMS:
        n, avg = index.corpus()
        return Facts(n, avg, {r["term"]: r["df"] for r in index.lexicon.where(F.col("term").isin(terms)).collect()})
    r = index.documents.agg(F.count("*").alias("n"), F.avg("doc_length").alias("a"), *[F.count_if(F.array_contains("tokens", t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return Facts(r["n"], r["a"] or 0.0, {t: r[f"t{i}"] for i, t in enumerate(terms) if r[f"t{i}"]})


def expand(index: Index, plan: SearchPlan, profile: Profile) -> tuple[list[tuple[str, float]], Facts] | None:
    """(term, boost) to score by, and the corpus; None: no result can exist."""
    terms = list(plan.terms)
    wanted = [F.col("term").startswith(p) for p in plan.prefixes] + [F.col("term").contains(s) for s in plan.substrings]
    if wanted:
        either = wanted[0]
        for c in wanted[1:]:
            either = either | c
        grown = [r["term"] for r in index.lexicon.where(either).select("term").orderBy("term").collect()]
        ordered = [t for p in plan.prefixes for t in grown if t.startswith(p)] + [t for s in plan.substrings for t in grown if s in t]
        terms = list(dict.fromkeys(terms + ordered))
    kept = [t for t in terms if not is_query_stopword(t)] or terms
    profile.counters["raw_query_terms"] = len(kept)
    if not kept:
        profile.path = "invalid_query"
        return None
    facts = facts_of(index, kept)
    scoring: dict[str, float] = {}
    rewrites = 0
    for t in kept:
        if t in facts.df:
            scoring[t] = 1.0
            continue
        size = len(t.encode())
        near = []
        if plan.fuzzy and 3 <= size <= 32 and not is_query_stopword(t):
            near = fuzzy_candidates(index.lexicon, "term", "df", t, plan.max_edits, TERMS).collect()
        if not near:
            if plan.mode == "and":
                profile.path = "no_hits"
                return None
            continue
        rewrites += 1
        profile.notes.append(f"{t} -> {near[0]['term']}")
        most = 1 if plan.mode == "and" else min(3, plan.expansions) if size <= 5 else plan.expansions
        for r in near[:most]:
            scoring[r["term"]] = max(scoring.get(r["term"], 0.0), r["boost"])
            facts.df[r["term"]] = r["df"]
    profile.counters |= {"scoring_terms": len(scoring), "fuzzy_rewrites": rewrites}
    if not scoring:
        profile.path = "no_hits"
        return None
    return list(scoring.items()), facts


def _is(term: str):
    return lambda x: x == term


def scored(index: Index, scoring: list[tuple[str, float]], mode: str, corpus: Facts) -> DataFrame:
    """doc_id, score, matched, year of every hit; from a scan also its title, journal and title_key.

    Scores are rounded to 9 places, so that documents with equal texts tie whatever the order of addition.
    """
    n, avg = corpus.n, corpus.avg
    rows = [(term, corpus.df[term], boost * (STOPWORD_WEIGHT if is_query_stopword(term) else 1.0)) for term, boost in scoring]
    facts = index.documents.select("doc_id", "title", "journal", "year", "doc_length", "title_key", "tokens")
    if not index.stored and len(rows) <= FEW_TERMS:
        # a scan: each document scores itself
        held = facts.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t, *_ in rows])))
        held = held.withColumns({f"_tf{i}": F.size(F.filter("tokens", _is(t))) for i, (t, *_) in enumerate(rows)})
        score, matched = F.lit(0.0), F.lit(0).cast("long")
        for i, (_, df, weight) in enumerate(rows):
            score = score + term_score(F.lit(df), F.col(f"_tf{i}"), F.col("doc_length"), n, avg) * weight
            matched = matched + (F.col(f"_tf{i}") > 0).cast("long")
        by_doc = held.withColumns({"score": F.round(score, 9), "matched": matched})
        out = by_doc.select("doc_id", "title", "journal", "year", "title_key", "score", "matched")
        return out.where(F.col("matched") == len(rows)) if mode == "and" else out
    # weights has a row for each query term: its size is the query's
    weights = F.broadcast(index.documents.sparkSession.createDataFrame(rows, "term string, df long, weight double"))
    hits = index.postings.where(F.col("term").isin([t for t, *_ in rows])).join(weights, "term")
    parts = hits if index.stored else hits.join(facts.select("doc_id", "doc_length", "year"), "doc_id")
    part = term_score(F.col("df"), F.col("tf"), F.col("doc_length"), n, avg) * F.col("weight")
    by_doc = parts.groupBy("doc_id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("matched"), F.first("year").alias("year"))
    return by_doc.where(F.col("matched") == len(rows)) if mode == "and" else by_doc


def with_texts(index: Index, hits: DataFrame, most: int | None, order: list[Column]) -> DataFrame:
    """hits with title, journal and title_key. Of a stored index the first `most` in order, if these are few: their rows alone are read."""
    if "title" in hits.columns:
        return hits
    texts = index.documents.select("doc_id", "title", "journal", "title_key")
    if most is None or most > FEW_HITS:
        return hits.join(texts, "doc_id")
    rows = hits.orderBy(*order).limit(most).collect()
    page = hits.sparkSession.createDataFrame(rows, hits.schema)
    return texts.where(F.col("doc_id").isin([r["doc_id"] for r in rows])).join(F.broadcast(page), "doc_id")


def phrase_gain(phrases: list[list[str]], padded: Column) -> Column:
    gain = F.lit(0.0)
    for p in phrases:
        gain = gain + F.when(padded.contains(f" {' '.join(p)} "), PHRASE_GAIN * len(p)).otherwise(0.0)
    return gain


def search(index: Index, query: str | SearchPlan) -> tuple[DataFrame, Profile]:
    """(hits, profile): rank, doc_id, score, year, title, journal, matched of the page asked for, in order."""
    profile, start = Profile(), time.perf_counter()
    plan = parse_search(query) if isinstance(query, str) else query
    profile.timers["parse"] = (time.perf_counter() - start) * 1000
    start = time.perf_counter()
    found = expand(index, plan, profile)
    profile.timers["rewrite"] = (time.perf_counter() - start) * 1000
    spark = index.documents.sparkSession
    if found is None:
        return spark.createDataFrame([], "rank long, doc_id long, score double, year int, title string, journal string, matched long"), profile
    scoring, facts = found
    hits = scored(index, scoring, plan.mode, facts)
    bounded = plan.mode == "or" and plan.sort == "relevance" and bool(plan.page or plan.size or plan.limit)
    padded = F.concat(F.lit(" "), F.col("title_key"), F.lit(" "))
    first = [F.desc("score")]
    offset, limit = plan.window(hits.count() if plan.needs_total else 1 << 62)
    best = [F.desc("year"), F.desc("score"), F.asc("doc_id")] if plan.sort == "newest" else [F.desc("score"), F.desc("year"), F.asc("doc_id")]
    if not plan.phrases:
        hits = with_texts(index, hits, None if limit is None else offset + limit, best)
    else:
        if bounded:
            offset_, limit_ = plan.window(1 << 62)
            most = min(max(RERANK * (offset_ + (limit_ or 0)), RERANK_LEAST), RERANK_MOST)
            hits = with_texts(index, hits, most, best).orderBy(F.desc("score"), F.desc("year"), "doc_id").limit(most)
            hits = hits.withColumn("has_phrase", phrase_gain(plan.phrases, padded) > 0)
            first = [F.desc("has_phrase"), F.desc("score")]
        else:
            hits = with_texts(index, hits, None, best)
        hits = hits.withColumn("score", F.round(F.col("score") + phrase_gain(plan.phrases, padded), 9))
    order = [F.desc("year"), *first, F.asc("doc_id")] if plan.sort == "newest" else [*first, F.desc("year"), F.asc("doc_id")]
    if plan.mode == "or":
        hits = hits.withColumn("matched", F.lit(len(scoring)).cast("long"))
    page = hits.orderBy(*order)
    page = page.offset(offset) if offset else page
    page = page.limit(limit) if limit is not None else page
    profile.path = "newest" if plan.sort == "newest" else "phrase" if plan.phrases else f"bm25_{plan.mode}"
    if limit is None:
        return page.select(F.lit(None).cast("long").alias("rank"), "doc_id", "score", "year", "title", "journal", "matched"), profile
    # a page is small: its rank is a window over its own rows
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + F.lit(offset).cast("long"))
    return ranked.select("rank", "doc_id", "score", "year", "title", "journal", "matched"), profile


def total_hits(index: Index, query: str) -> DataFrame:
    """total_hits of a query, without ranking."""
    plan, profile = parse_search(query), Profile()
    found = expand(index, plan, profile)
    if found is None:
        return index.documents.sparkSession.createDataFrame([(0,)], "total_hits long")
    scoring = found[0]
    hits = index.postings.where(F.col("term").isin([t for t, _ in scoring])).groupBy("doc_id").agg(F.count("*").alias("m"))
    return hits.where(F.col("m") >= (len(scoring) if plan.mode == "and" else 1)).agg(F.count("*").alias("total_hits"))
