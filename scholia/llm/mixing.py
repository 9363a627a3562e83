"""Mixing sources to target weights by capped water-filling.

Targets: a source's share follows its weight, is clamped at `epochs` times its size, and the excess is
shared again by weight until nothing is above. Documents are then repeated whole `floor(target / size)`
times, and one further time where their seeded hash lies below a threshold of the source, which is
found so that the words taken miss the target by less than one document. Thresholds come from sums by
hash prefix (12 bits a level), so no source, however large, meets in one task. Texts never move: the
table of sources is broadcast, whole where it is small and else in pieces of bounded size.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import WORD, numbered, scratch

#: Up to so many sources, of so many bytes of names, are planned on the driver and broadcast whole; beyond that they are planned as a table and broadcast in pieces.
FEW_SOURCES, FEW_BYTES = 100_000, 16 << 20
_BITS, _ALL, _FEW = 12, 60, 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: str) -> Column:
    """A 60-bit number for each document, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def cyclic_weights(names: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3, 1, ... over the names by code point, null last."""
    order = sorted(names, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def water_fill(sizes: dict[str | None, int], weights: dict[str | None, int], epochs: int = 3, total: int | None = None) -> dict[str | None, Fraction]:
    """Exact targets; total None: all sizes. Sources without words get 0."""
    left, targets = Fraction(sum(sizes.values()) if total is None else total), {}
    open_ = {s for s in sizes if weights.get(s, 0) > 0}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] > epochs * sizes[s]}
        if not over:
            targets |= {s: unit * weights[s] for s in open_}
            break
        targets |= {s: Fraction(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return {s: targets.get(s, Fraction(0)) for s in sizes}


_FACTS = "source string, source_size long, target double, whole int, twice long"
_TYPES = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "whole": pa.int32(), "twice": pa.int64()}


def _few_facts(sums: DataFrame, weights: DataFrame | None, epochs: int) -> DataFrame:
    """Targets of sources that fit the driver."""
    sizes = {r["source"]: int(r["source_size"]) for r in sums.collect()}
    given = cyclic_weights(list(sizes)) if weights is None else {r["source"]: r["weight"] for r in weights.collect()}
    facts = []
    for s, t in water_fill(sizes, given, epochs).items():
        n = sizes[s]
        whole = int(t // n) if n else 0
        need = t - whole * n  # words of the fractional repetition
        # a document is in it if before + upto <= 2 * need, in integers: so the last one is rounded, not cut
        facts.append((s, n, t.numerator / t.denominator, whole, int(2 * need // 1)))
    # an Arrow table: rows of a Python list are turned by Python workers of another kind, whose daemon stays in each executor
    columns = [list(c) for c in zip(*facts, strict=True)] or [[] for _ in _TYPES]
    return sums.sparkSession.createDataFrame(pa.table(dict(zip(_TYPES, map(pa.array, columns, _TYPES.values()), strict=True))), _FACTS)


def _many_facts(sums: DataFrame, weights: DataFrame | None, epochs: int) -> DataFrame:
    """The same of any number of sources: the level of the water is two numbers, which rise until no further source is above them."""
    if weights is None:
        weighed = numbered(sums, [F.col("source").isNull(), F.col("source")]).select("source", "source_size", (1 + F.col("number") % 3).alias("weight"))
    else:
        given = weights.select(F.col("source").alias("_source"), "weight")
        weighed = sums.join(given, sums["source"].eqNullSafe(given["_source"]), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    weighed = scratch(weighed, "weights")
    whole_number = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    size, weight = F.col("source_size").cast("decimal(20,0)"), F.col("weight").cast("decimal(18,0)")
    total = int(weighed.agg(F.sum(size)).first()[0] or 0)
    left, sharing = total, int(weighed.agg(F.sum(weight)).first()[0] or 0)
    while sharing:
        # left / sharing is what a unit of weight gets; products of big numbers stay decimals of 38 digits
        above = (weight > 0) & (size * whole_number(epochs * sharing) < weight * whole_number(left))
        held, out = weighed.where(above).agg(F.sum(size), F.sum(weight)).first()
        then = total - epochs * int(held or 0), int(weighed.agg(F.sum(weight)).first()[0]) - int(out or 0)
        if then == (left, sharing):
            break
        left, sharing = then
    num = weight * whole_number(left)
    shares = whole_number(max(sharing, 1))
    capped = (weight > 0) & (size * whole_number(epochs * max(sharing, 1)) < num) if sharing else weight > 0
    target = F.when(weight <= 0, F.lit(0.0)).when(capped, (size * epochs).cast("double")).otherwise(num.cast("double") / shares.cast("double"))
    # whole and need in integers: num = shares * need_words, of which source_size * whole are whole repetitions
    words = F.floor(2 * num / shares)
    whole = F.when((weight <= 0) | (size == 0), F.lit(0)).when(capped, F.lit(epochs)).otherwise(F.floor(num / (shares * size))).cast("int")
    twice = F.when((weight <= 0) | capped | (size == 0), F.lit(0)).otherwise(words - 2 * whole * F.col("source_size")).cast("long")
    return weighed.select("source", "source_size", target.alias("target"), whole.alias("whole"), twice.alias("twice"))


def plan(docs: DataFrame, weights: DataFrame | None = None, epochs: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sized, sources): sized has doc_id, source, size and u for each row; sources has, for each source,
    source_size, target, whole (repetitions for every document) and upto (a document with u <= upto gets one more).

    weights: source, weight; None: 1, 2, 3, 1, ... by code point. Null texts have size 0; null is a source
    like another, the last; a source without words has target 0. Repeated rows share their fate. An empty
    table gives two empty ones. Any number of sources is planned.
    """
    sized = scratch(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded(F.col("doc_id"), seed).alias("u")), "sizes")
    sums = scratch(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    facts = scratch((_few_facts if _pieces(sums) == 1 else _many_facts)(sums, weights, epochs), "facts")
    few = _pieces(facts) == 1
    found = facts.select("source", "twice", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    # level by level: the sums below each prefix name the one prefix in which the threshold lies
    for shift in range(_ALL - _BITS, -1, -_BITS):
        sums = _inside(sized, found, shift + _BITS, few).groupBy("source", F.shiftright("u", shift).alias("p")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("twice").alias("twice"), F.first("base").alias("base"))
        w = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("upto", F.col("base") + F.sum("n").over(w)).where(2 * F.col("upto") > F.col("twice"))
        edge = over.groupBy("source").agg(F.min_by(F.struct("p", (F.col("upto") - F.col("n")).alias("base"), "rows"), "p").alias("e")).select(F.col("source").alias("_source"), "e.*")
        joined = facts.join(edge, facts["source"].eqNullSafe(edge["_source"]), "left")
        # no edge (-1): the threshold is above all documents
        found = scratch(joined.select("source", "twice", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("p", F.lit(-1)).alias("prefix"), F.coalesce("rows", F.lit(0)).alias("rows")), "found")
        if shift == 0 or (found.agg(F.max("rows")).first()[0] or 0) <= _FEW:
            break
    # the last prefix holds few rows a source (or equal hashes): the exact end
    inside = _inside(sized, found.drop("rows"), shift, few).groupBy("source", "u").agg(F.sum("size").alias("n"), F.first("twice").alias("twice"), F.first("base").alias("base"))
    w = Window.partitionBy("source").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("upto", F.col("base") + F.sum("n").over(w)).where(2 * F.col("upto") - F.col("n") <= F.col("twice")).groupBy("source").agg(F.max("u").alias("u"))
    last = last.select(F.col("source").alias("_last"), "u")
    ends = found.select(F.col("source").alias("_source"), "prefix")
    out = facts.join(ends, facts["source"].eqNullSafe(ends["_source"])).join(last, facts["source"].eqNullSafe(last["_last"]), "left")
    upto = F.coalesce("u", F.when(F.col("prefix") < 0, F.lit(1 << 62)).otherwise(F.shiftleft("prefix", shift) - 1))
    return sized, scratch(out.select("source", "source_size", "target", "whole", upto.alias("upto")), "sources")


def _inside(sized: DataFrame, found: DataFrame, shift: int, few: bool) -> DataFrame:
    """Rows whose hash has the prefix of their source; a join by source and prefix, so that a large source is many keys."""
    right = found.select(F.col("source").alias("_source"), "twice", "base", "prefix")
    return sized.join(F.broadcast(right) if few else right, sized["source"].eqNullSafe(right["_source"]) & (F.shiftright(sized["u"], shift) == right["prefix"])).drop("_source", "prefix")


def _pieces(sources: DataFrame) -> int:
    """In how many pieces of bounded size a table of sources is broadcast."""
    n, size = sources.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()
    return max(1, -(-n // FEW_SOURCES), -(-(size or 0) // FEW_BYTES))


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df's rows with the facts of their source; null meets null. df is scanned once for each piece of the sources and never shuffled."""
    right = sources.withColumnRenamed("source", "_source")
    pieces, out = _pieces(sources), None
    for k in range(pieces):
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces)) == k  # noqa: B023, E731
        left, part = (df, right) if pieces == 1 else (df.where(own("source")), right.where(own("_source")))
        met = left.join(F.broadcast(part), left["source"].eqNullSafe(part["_source"])).drop("_source")
        out = met if out is None else out.unionByName(met)
    return out


def repetitions() -> Column:
    return (F.col("whole") + (F.col("u") <= F.col("upto")).cast("int")).alias("reps")


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, reps, taken for each row of docs."""
    sized, sources = plan(docs, **how)
    out = _with_source(sized, sources)
    return out.select("doc_id", "source", "size", "source_size", "target", repetitions(), (F.col("size") * repetitions()).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """docs with each row as often as the mix takes it, and none other. Texts are neither shuffled nor broadcast."""
    _, sources = plan(docs, seed=seed, **how)
    columns = docs.columns
    kept = docs.select(F.struct("*").alias("_row"), "source", seeded(F.col("doc_id"), seed).alias("u"))
    out = _with_source(kept, sources).select("_row", repetitions()).where("reps > 0")
    return out.select(F.col("_row"), F.explode(F.sequence(F.lit(1), F.col("reps"))).alias("_rep")).select(*[F.col("_row").getField(c).alias(c) for c in columns])


#: The same for cyclic weights, 3 epochs and seed 'mix' in DuckDB's SQL.
MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || 'mix'), 1, 15))::bigint as u from documents),
s as (select source, sum(size)::hugeint as n, (1 + (row_number() over (order by source nulls last) - 1) % 3)::hugeint as w from d group by source),
o as (select *, row_number() over (order by n / w, source nulls last) as k from s),
c as (select *, (sum(n) over ()) - 3 * coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest, sum(w) over (order by k rows between current row and unbounded following) as ws from o),
f as (select *, rest * w > 3 * n * ws as capped from c),
g as (select min(case when not capped then k end) as k0 from f),
t as (select source, n, w, case when k < coalesce(k0, 1 << 30) then 3 * n else (select rest from f, g where k = k0) * w end::hugeint as num,
    case when k < coalesce(k0, 1 << 30) then 1 else (select ws from f, g where k = k0) end::hugeint as den from f, g),
r as (select *, case when n = 0 then 0 else num // (den * n) end as whole from t),
e as (select d.doc_id, d.size, r.*, sum(d.size) over (partition by d.source order by d.u) as upto, sum(d.size) over (partition by d.source order by d.u range between current row and current row) as own
    from d join r on d.source is not distinct from r.source)
select doc_id, size, n::bigint as source_size, num::double / den::double as target,
    (size * (whole + case when den * (2 * upto - own) <= 2 * (num - whole * n * den) then 1 else 0 end))::bigint as taken from e
"""
