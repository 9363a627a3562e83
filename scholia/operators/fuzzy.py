"""Typo-tolerant lookup in a lexicon: rarest trigrams, overlap and length bounds, then bounded edit distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import byte_levenshtein, distance_boost, py_trigrams, trigrams


@dataclass(frozen=True)
class FuzzyRules:
    """Fixed values of one kind of lookup."""

    grams: int
    verify: int
    keep: int
    slack: int
    short: int
    gram_limit: int
    overlap: tuple[float, float]
    prior: tuple[float, float]
    starts: float = 1.0


TERMS = FuzzyRules(grams=4, verify=128, keep=24, slack=2, short=5, gram_limit=200_000, overlap=(0.80, 0.20), prior=(0.90, 0.20))
AUTHORS = FuzzyRules(grams=5, verify=160, keep=10, slack=3, short=6, gram_limit=180_000, overlap=(0.76, 0.24), prior=(0.88, 0.24), starts=1.08)


def fuzzy_candidates(lexicon: DataFrame, key: str, weight: str, typo: str, max_edits: int, rules: FuzzyRules) -> DataFrame:
    """key, weight, dist, boost of the best matches, best first.

    lexicon has one row a key with its frequency in `weight`. The typo's trigrams are literals, so the
    lexicon is scanned once for their frequencies and once for the matches; nothing but counts is shuffled.
    """
    typo_bytes = len(typo.encode())
    edits = min(1, max_edits) if typo_bytes <= rules.short else max_edits
    all_grams = py_trigrams(typo)
    empty = lexicon.select(key, weight, F.lit(0).alias("dist"), F.lit(0.0).alias("boost")).limit(0)
    if edits <= 0 or not all_grams:
        return empty
    own = lexicon.select(key, weight, F.array_intersect(trigrams(F.col(key)), F.array(*map(F.lit, all_grams))).alias("grams"))
    facts = own.agg(F.max(weight).alias("top"), *[F.count_if(F.array_contains("grams", g)).alias(f"g{i}") for i, g in enumerate(all_grams)]).first()
    found = [(facts[f"g{i}"], i) for i in range(len(all_grams)) if 0 < facts[f"g{i}"] <= rules.gram_limit]
    active = [all_grams[i] for _, i in sorted(found)[: rules.grams]]
    if not active:
        return empty
    least = max(1, len(all_grams) // 3)
    hits = own.withColumn("overlap", F.size(F.array_intersect("grams", F.array(*map(F.lit, active)))))
    gap = F.abs(F.octet_length(key) - typo_bytes)
    near = hits.where((F.col("overlap") >= least) & (gap <= edits + rules.slack)).orderBy(F.desc("overlap"), gap, key).limit(rules.verify)
    near = near.withColumn("dist", byte_levenshtein(F.col(key), F.lit(typo), edits)).where("dist >= 0")
    prior = F.log1p(F.col(weight).cast("double")) / F.log1p(F.lit(float(max(1, facts["top"]))))
    boost = distance_boost(F.col("dist")) * (rules.overlap[0] + rules.overlap[1] * F.col("overlap") / len(all_grams)) * (rules.prior[0] + rules.prior[1] * F.least(F.greatest(prior, F.lit(0.0)), F.lit(1.0)))
    boost = boost * F.when(F.col(key).startswith(typo), rules.starts).otherwise(1.0)
    return near.select(key, weight, "dist", boost.alias("boost")).orderBy(F.desc("boost"), key).limit(rules.keep)
