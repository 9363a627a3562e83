"""The search query language, parsed on the driver into a small plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from scholia.functions.text import LOWER, UPPER, py_tokens

#: Words that queries are freed of unless nothing else is left.
QUERY_STOPWORDS = frozenset("a an and are as at be by for from in into is it of on or that the their this to via we with you".split())
_RESERVED = frozenset(("", "*", "~", '"', ":", "mode", "sort", "fuzzy", "fuzzyexp"))
MAX_EDITS, MAX_EXPANSIONS, DEFAULT_PAGE = 2, 12, 20


def _lower(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def _number(word: str, name: str) -> int | None:
    m = re.fullmatch(rf"{name}:([0-9]+)", word)
    return int(m[1]) if m and int(m[1]) < 2**64 else None


def is_query_stopword(token: str) -> bool:
    return len(token.encode()) <= 1 or token in QUERY_STOPWORDS


@dataclass
class SearchPlan:
    """What a query asks for; terms are normalised, distinct and in order."""

    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    substrings: list[str] = field(default_factory=list)
    ignored_substrings: list[str] = field(default_factory=list)
    mode: str = "or"
    sort: str = "relevance"
    fuzzy: bool = True
    max_edits: int = MAX_EDITS
    expansions: int = 4
    limit: int = 20
    offset: int = 0
    page: int = 0
    size: int = 0

    def window(self, total: int) -> tuple[int, int | None]:
        """(offset, limit) into total hits; limit None: all. A page beyond the last is the last."""
        if self.page or self.size:
            size = self.size or self.limit or DEFAULT_PAGE
            pages = max(1, -(-total // size))
            return (min(self.page or 1, pages) - 1) * size, size
        return min(self.offset, total), self.limit or None

    @property
    def needs_total(self) -> bool:
        """Only a page past the first can lie beyond the last."""
        return (self.page or 0) > 1


def parse_search(query: str) -> SearchPlan:
    plan = SearchPlan()
    for quoted in re.findall(r'"([^"]*)"', query):
        phrase = py_tokens(quoted)
        if len(phrase) >= 2:
            plan.phrases.append(phrase)
    explicit, joins, rest = False, set(), []
    for raw in query.split():
        raw = raw.replace('"', "")
        word = _lower(raw)
        if not word:
            continue
        if word in ("mode:and", "mode:or"):
            plan.mode, explicit = word[5:], True
        elif word in ("sort:newest", "sort:relevance"):
            plan.sort = word[5:]
        elif word in ("fuzzy:on", "fuzzy:off"):
            plan.fuzzy = word == "fuzzy:on"
        elif (n := _number(word, "fuzzy")) is not None:
            plan.fuzzy, plan.max_edits = True, min(MAX_EDITS, n)
        elif (n := _number(word, "fuzzyexp")) is not None:
            plan.expansions = max(1, min(MAX_EXPANSIONS, n))
        elif any((n := _number(word, name)) is not None and not setattr(plan, name, n) for name in ("limit", "offset", "page", "size")):
            pass
        elif word in ("and", "or"):
            joins.add(word)
        elif word.endswith("*"):
            if word[:-1] not in _RESERVED:
                plan.prefixes.append(word[:-1])
        elif len(word) >= 3 and word[0] == word[-1] == "~":
            needle = word[1:-1]
            if needle not in _RESERVED:
                (plan.substrings if len(needle.encode()) >= 3 else plan.ignored_substrings).append(needle)
        else:
            rest.append(raw)
    if not explicit:
        plan.mode = "and" if joins == {"and"} else "or"
    plan.terms = list(dict.fromkeys(py_tokens(" ".join(rest))))
    return plan


@dataclass
class AuthorPlan:
    author: str = ""
    fuzzy: bool = True
    max_edits: int = MAX_EDITS


def parse_author(query: str) -> AuthorPlan:
    plan, words = AuthorPlan(), []
    for raw in query.split():
        word = _lower(raw)
        if word in ("fuzzy:on", "fuzzy:off"):
            plan.fuzzy = word == "fuzzy:on"
        elif (n := _number(word, "fuzzy")) is not None:
            plan.fuzzy, plan.max_edits = True, min(MAX_EDITS, n)
        else:
            words.append(raw)
    plan.author = " ".join(py_tokens(" ".join(words)))
    return plan
