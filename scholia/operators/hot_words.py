"""Yearly hot words: alias canonicalisation, term filter, counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import py_tokens

#: Stopwords that are always there; a file given by the caller adds to them.
BASE_STOPWORDS = "a about an and as at be by for from in into is it of on or our that the their this to via we with you your".split()
ACADEMIC_STOPWORDS = """algorithm algorithms analysis approach approaches based framework frameworks method methods model models new novel paper papers
    research results study system systems toward towards using""".split()
#: Words of announcements rather than topics.
TEMPLATE_WORDS = """challenge challenges conference conferences dataset datasets demo demos during international issue issues part parts poster posters
    proceeding proceedings session sessions shared special symposium symposia task tasks track tracks tutorial tutorials volume volumes""".split()
#: Abbreviations whose plural is the same topic, and the phrases they stand for.
ABBREVIATIONS = "bert cnn gan gcn gnn gpt llm lstm nlp rnn vae".split()
PHRASES = {
    "long short term memory": "lstm",
    "convolutional neural network": "cnn",
    "convolutional neural networks": "cnn",
    "generative adversarial network": "gan",
    "generative adversarial networks": "gan",
    "graph convolutional network": "gcn",
    "graph convolutional networks": "gcn",
    "graph neural network": "gnn",
    "graph neural networks": "gnn",
    "large language model": "llm",
    "large language models": "llm",
    "natural language processing": "nlp",
    "recurrent neural network": "rnn",
    "recurrent neural networks": "rnn",
    "variational autoencoder": "vae",
    "variational autoencoders": "vae",
}


@dataclass
class Vocabulary:
    """Stopwords and aliases; both are configuration, not data, and fit any closure."""

    stopwords: set[str] = field(default_factory=lambda: set(BASE_STOPWORDS) | set(ACADEMIC_STOPWORDS))
    aliases: dict[str, str] = field(default_factory=lambda: {a + s: a for a in ABBREVIATIONS for s in ("", "s")} | dict(PHRASES))

    def with_stopwords(self, lines: list[str]) -> Vocabulary:
        """Every word of every line; lines that start with # are comments."""
        more = {t for line in lines if not line.lstrip().startswith("#") for t in py_tokens(line)}
        return Vocabulary(self.stopwords | more, dict(self.aliases))

    def with_aliases(self, lines: list[str]) -> Vocabulary:
        """`phrase => token` lines; later ones win over equal keys."""
        more = {}
        for line in lines:
            left, arrow, right = line.partition("=>")
            key, value = " ".join(py_tokens(left)), "_".join(py_tokens(right))
            if arrow and key and value and not line.lstrip().startswith("#"):
                more[key] = value
        return Vocabulary(set(self.stopwords), self.aliases | more)

    def pattern(self) -> re.Pattern | None:
        """One alternation over padded tokens, longest phrases first, then by code point."""
        phrases = sorted((a for a in self.aliases if " " in a), key=lambda a: (-a.count(" "), a))
        return re.compile(r"(?<= )(?:" + "|".join(map(re.escape, phrases)) + r")(?= )") if phrases else None

    def canonical(self, tokens: list[str]) -> list[str]:
        """Leftmost longest phrases first, then single tokens; what a rule made is not matched again."""
        if not tokens:
            return []
        pattern = self.pattern()
        text, out, at = f" {' '.join(tokens)} ", [], 0
        for m in pattern.finditer(text) if pattern else ():
            out += [self.aliases.get(t, t) for t in text[at : m.start()].split()] + [self.aliases[m[0]]]
            at = m.end()
        return out + [self.aliases.get(t, t) for t in text[at:].split()]


def canonical_tokens(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Aliases applied to array<string>; only rows that hold a phrase's first word leave the JVM."""
    firsts = sorted({a.split(" ")[0] for a in vocabulary.aliases if " " in a})
    single = {a: v for a, v in vocabulary.aliases.items() if " " not in a and a != v}

    @F.pandas_udf("array<string>")
    def rewrite(col: pd.Series) -> pd.Series:
        return col.map(lambda t: vocabulary.canonical(list(t)) if t is not None else None)

    needs = F.arrays_overlap(tokens, F.array(*map(F.lit, firsts))) if firsts else F.lit(False)
    table = F.create_map(*[F.lit(x) for kv in single.items() for x in kv]) if single else None
    plain = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t)) if single else tokens
    return F.coalesce(rewrite(F.when(needs, tokens)), plain)


def is_topic(term: Column, vocabulary: Vocabulary) -> Column:
    stop = sorted(vocabulary.stopwords | set(TEMPLATE_WORDS))
    return (F.octet_length(term) > 1) & ~term.isin(stop) & ~term.rlike("^[0-9]+$")


def year_terms(documents: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """year, term, freq over non-empty titles."""
    vocabulary = vocabulary or Vocabulary()
    d = documents.where("title <> ''").select("year", F.explode(canonical_tokens(F.col("tokens"), vocabulary)).alias("term"))
    return d.where(is_topic(F.col("term"), vocabulary)).groupBy("year", "term").agg(F.count("*").alias("freq"))


def docs_per_year(documents: DataFrame) -> DataFrame:
    return documents.where("title <> ''").groupBy("year").agg(F.count("*").alias("docs"))


def hot_words(documents: DataFrame, year: int, k: int = 10, vocabulary: Vocabulary | None = None) -> DataFrame:
    """term, freq, trend_score of a year's k most frequent terms."""
    return top_of_year(year_terms(documents.where(F.col("year") == year), vocabulary), year, k)


def top_of_year(terms: DataFrame, year: int, k: int = 10) -> DataFrame:
    """The same from year_terms, stored or not."""
    top = terms.where(F.col("year") == year).orderBy(F.desc("freq"), "term").limit(k)
    return top.select("term", "freq", F.col("freq").cast("double").alias("trend_score"))


def hot_words_by_year(documents: DataFrame, k: int = 10, vocabulary: Vocabulary | None = None) -> DataFrame:
    return top_by_year(year_terms(documents, vocabulary), k)


def top_by_year(terms: DataFrame, k: int = 10) -> DataFrame:
    """Spark keeps k rows a task and year before it ranks (WindowGroupLimit)."""
    w = Window.partitionBy("year").orderBy(F.desc("freq"), "term")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
