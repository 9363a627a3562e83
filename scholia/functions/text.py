"""Text normalisation and similarity as column expressions, with driver-side twins for query strings.

Keys and tokens follow one rule everywhere: A-Z folded, [0-9a-z_] and every non-ASCII code point kept, any
other ASCII code point a separator, decodable entities replaced verbatim. Lengths, trigrams and edit
distances are in bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
#: The five named entities.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = r"^&(?:#([0-9]{1,8})|#[xX]([0-9a-fA-F]{1,8})|(amp|lt|gt|quot|apos));"


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would fold all of Unicode."""
    return F.translate(c, UPPER, LOWER)


def _spaced(c: Column) -> Column:
    return F.regexp_replace(ascii_lower(c), SEPARATORS, " ")


def _with_entities(c: Column) -> Column:
    """Normalised text in which each & starts a decoded entity or separates."""

    def piece(p: Column) -> Column:
        whole = F.regexp_extract(p, _ENTITY, 0)
        dec, hexa, name = (F.regexp_extract(p, _ENTITY, k) for k in (1, 2, 3))
        digits = F.when(dec != "", F.conv(dec, 10, 16)).otherwise(F.upper(hexa))
        code = F.conv(digits, 16, 10).cast("long")
        valid = (digits != "") & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        named = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), name)
        rest = _spaced(F.substring(p, F.length(whole) + 1, F.length(p)))
        return (
            F.when(~p.startswith("&"), _spaced(p))
            .when(name != "", F.concat(named, rest))
            .when(valid, F.concat(char, rest))
            .otherwise(F.concat(F.lit(" "), _spaced(F.substring(p, F.lit(2), F.length(p)))))
        )

    return F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")


def tokens(c: Column) -> Column:
    """array<string> of normalised tokens; null: none."""
    c = F.coalesce(c, F.lit(""))
    plain = F.split(ascii_lower(c), SEPARATORS)
    return F.filter(F.when(c.contains("&"), F.split(_with_entities(c), " +")).otherwise(plain), lambda t: t != "")


def norm_key(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def bytes_as_chars(c: Column) -> Column:
    """One character for each UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def trigrams(c: Column) -> Column:
    """Distinct byte trigrams, sorted, one character a byte."""
    b = bytes_as_chars(c)
    grams = F.transform(F.sequence(F.lit(1), F.length(b) - 2), lambda i: F.substring(b, i, 3))
    return F.when(F.length(b) >= 3, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<string>"))


def byte_levenshtein(a: Column, b: Column, bound: int) -> Column:
    """Edit distance in bytes, -1 beyond the bound."""
    return F.levenshtein(bytes_as_chars(a), bytes_as_chars(b), bound)


def distance_boost(d: Column) -> Column:
    return F.when(d == 0, 1.0).when(d == 1, 0.72).when(d == 2, 0.45).otherwise(0.25)


def df_penalty(ratio: Column) -> Column:
    return F.when(ratio >= 0.30, 0.20).when(ratio >= 0.15, 0.40).when(ratio >= 0.05, 0.65).otherwise(1.0)


def year_of(c: Column) -> Column:
    """Optional minus and leading digits; nothing, junk before them or overflow: 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*(-?[0-9]+)", 1).try_cast("int"), F.lit(0))


def xml_decode(c: Column) -> Column:
    """The five named entities, each once: &amp;lt; becomes &lt;."""
    for name in ("lt", "gt", "quot", "apos", "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(NAMED[name]))
    return c


def py_tokens(text: str) -> list[str]:
    """tokens() for one string on the driver."""

    def entity(m: re.Match) -> str:
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else " " + spaced(m[0][1:])

    def spaced(s: str) -> str:
        return re.sub(SEPARATORS, " ", s.translate(str.maketrans(UPPER, LOWER)))

    out = []
    for p in re.split("(?=&)", text):
        m = re.match(_ENTITY, p)
        out.append(entity(m) + spaced(p[m.end() :]) if m else spaced(p))
    return [t for t in "".join(out).split(" ") if t]


def py_trigrams(text: str) -> list[str]:
    b = text.encode().decode("latin-1")
    return sorted({b[i : i + 3] for i in range(len(b) - 2)})
