"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The mix is the vector of document rates, between 0 and a cap, of least relative entropy to
taking every document once, subject to one token constraint per source.  Its dual has one
multiplier a source and is convex; Newton's steps (kept inside a bracket) run over the
(source, size) cells of the corpus until the constraints hold.  A document's rate is the tilt
``exp(multiplier * size)``, up to the cap, so a source that gives less than it holds gives up
its long documents first.  Rates become whole copies by systematic rounding along the size
order within a source: the running sum of copies stays within one of the running sum of
rates, so a source's words miss its target by less than its longest document; the documents above
and below the mean size have starts of their own, and of ``STARTS`` squared pairs of starts
each source takes the one whose words come nearest.

The rank along that order comes from two levels of counts, (source, size) and
(source, size, salt), so a source that holds a third of all rows is never one task's work.

Defined results: null text has size 0; documents of size 0 have rate 1; a null source is a
source of its own, the last; rows with equal ids are separate documents; a very long text is
counted whole; a corpus without words takes each (empty) document once; an empty table gives an
empty result; further columns are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoflow.llm.common import WORD, staged, text_or_empty

#: Source weights in code-point order of the sources, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: No target and no document exceeds this many times its size.
MOST = 3
#: Row numbers within one (source, size) cell are dealt over so many keys.
SALTS = 256
#: Parts of one copy in which rates are counted.
PARTS = 1_000_000
#: Starts of the systematic rounding that are tried in each half of a source.
STARTS = 32
_KEY = "__source_key"


def words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def targets(cells: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, capped, the excess reshared by weight.

    The fixed point of capping and resharing is a water level: sources in order of
    cap / weight are full until the level that the others share fits under their caps.
    One row per source.
    """
    total = cells.groupBy("source", _KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    w = Window.orderBy("fill", F.col("source").asc_nulls_last())
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("fill"), F.col("level"))
    first = F.first("fits", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("fits", fits).withColumn("level", first).select("source", _KEY, "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def balance(cells: DataFrame, goals: DataFrame, most: int = MOST, tolerance: float = 1e-10, most_steps: int = 80) -> DataFrame:
    """Newton's iterations on the dual: source, source_size, target, unit and the multiplier ``lam``.

    Of all rates of a source between 0 and ``most`` whose tokens add up to its target, those of least
    relative entropy to taking each document once are ``least(most, exp(lam * size / unit))``;
    ``unit`` (the source's mean size) only scales the multiplier.  The dual's slope is the tokens at
    ``lam`` less the target; a Newton step that leaves the bracket known so far is halved into it.
    At ``ln(most) / (least size / unit)`` every document is at the cap, so the root lies below.
    """
    spread = cells.where("size > 0").groupBy(_KEY).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"), F.min("size").alias("least"))
    top = F.lit(math.log(most)) * F.col("unit") / F.col("least")
    began = goals.join(F.broadcast(spread), _KEY, "left").withColumn("hi", F.coalesce(top, F.lit(0.0)))
    # the lower end doubles until the tokens fall below the target
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    began = began.withColumn("lam", F.when(full, F.col("hi")).otherwise(0.0)).withColumn("lo", F.lit(None).cast("double")).withColumn("unit", F.coalesce("unit", F.lit(1.0)))
    kept = ["source", _KEY, "source_size", "target", "unit", "least", "hi", "lo", "lam"]
    state = staged(began.select(*kept), "dual", 1)
    filled = cells.where("size > 0").select(_KEY, "n", "size")
    for _ in range(most_steps):
        # one row per source meets one row per (source, size)
        tilted = filled.join(F.broadcast(state), _KEY).withColumn("scaled", F.col("size") / F.col("unit"))
        below = F.col("lam") * F.col("scaled") < math.log(most)
        rate = F.when(below, F.exp(F.col("lam") * F.col("scaled"))).otherwise(F.lit(float(most)))
        words = F.col("n") * F.col("size")
        moved = tilted.groupBy(_KEY).agg(F.sum(words * rate).alias("mass"), F.sum(F.when(below, words * F.col("scaled") * rate).otherwise(0.0)).alias("bend"))
        seen = state.join(F.broadcast(moved), _KEY, "left").withColumn("gap", F.coalesce(F.col("target") - F.col("mass"), F.lit(0.0)))
        seen = seen.withColumn("off", F.when(F.col("target") > 0, F.abs(F.col("gap")) / F.col("target")).otherwise(0.0))
        seen = seen.withColumn("lo", F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.col("gap") / F.col("bend")
        inside = (F.col("bend") > 0) & (newton < F.col("hi")) & (F.col("lo").isNull() | (newton > F.col("lo")))
        halved = F.when(F.col("lo").isNull(), F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when(F.col("off") <= tolerance, F.col("lam")).when(inside, F.when(F.col("lo").isNull(), F.greatest(newton, F.col("lam") * 2 - 1)).otherwise(newton)).otherwise(halved)
        state = staged(seen.withColumn("lam", step).select(*kept, "off"), "dual", 1)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("off")
    return state.select("source", _KEY, "source_size", "target", "unit", "lam")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken; ``docs`` has doc_id, source and size.

    Rates count in millionths, so that running sums are whole numbers and reruns agree whatever
    the order of addition.
    """
    keyed = docs.withColumn(_KEY, F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")))
    keyed = keyed.withColumn("__salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    fine = staged(keyed.groupBy("source", _KEY, "size", "__salt").agg(F.count("*").alias("n")), "cells")
    cells = staged(fine.groupBy("source", _KEY, "size").agg(F.sum("n").alias("n")), "sizes")
    solved = balance(cells, targets(cells, weights, most), most)
    tilt = F.round(F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(math.log(most)))) * PARTS)
    rated = cells.select(_KEY, "size", "n").join(F.broadcast(solved), _KEY).withColumn("rate", F.least(tilt, F.lit(most * PARTS)).cast("long"))
    upto = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy(_KEY).orderBy("size"))
    summed = rated.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n") * F.col("rate"))
    # small and large documents have starts of their own: of all pairs the one whose words come nearest to the target
    starts = [k * PARTS // STARTS for k in range(STARTS)]
    words = [F.expr(f"size * ((upto + {u}) div {PARTS} - (before + {u}) div {PARTS})") for u in starts]
    large = F.col("size") > F.col("unit")
    tried = summed.groupBy(_KEY).agg(F.first("target").alias("target"), *[F.array(*[F.sum(F.when(large == side, w).otherwise(0)) for w in words]).alias(name) for name, side in (("low", False), ("high", True))])
    pairs = f"transform(sequence(0, {STARTS - 1}), i -> array_min(transform(sequence(0, {STARTS - 1}), j -> struct(abs(low[i] + high[j] - target) as off, i as i, j as j))))"
    best = tried.withColumn("best", F.expr(f"array_min({pairs})"))
    started = best.select(_KEY, *[F.expr(f"best.{x} * {PARTS} div {STARTS}").alias(name) for x, name in (("i", "low"), ("j", "high"))])
    begin = F.when(large, F.col("high")).otherwise(F.col("low"))
    told = summed.join(F.broadcast(started), _KEY).select(_KEY, "size", "source_size", "target", "rate", (F.col("before") + begin).alias("__before"))
    before_salt = F.sum("n").over(Window.partitionBy(_KEY, "size").orderBy("__salt")) - F.col("n")
    offsets = fine.select(_KEY, "size", "__salt", before_salt.alias("before_salt"))
    plan = offsets.join(told, [_KEY, "size"]).select(_KEY, "size", "__salt", "source_size", "target", "rate", (F.col("__before") + F.col("before_salt") * F.col("rate")).alias("__before"))
    own = Window.partitionBy(_KEY, "size", "__salt").orderBy(F.col("doc_id").asc_nulls_last())
    mixed = keyed.join(plan, [_KEY, "size", "__salt"]).withColumn("__upto", F.col("__before") + F.row_number().over(own) * F.col("rate"))
    copies = F.expr(f"__upto div {PARTS} - (__upto - rate) div {PARTS}")
    mixed = mixed.withColumn("copies", copies).withColumn("rate", F.col("rate") / F.lit(float(PARTS)))
    return mixed.withColumn("taken", F.col("copies") * F.col("size")).drop(_KEY, "__salt", "__before", "__upto")


def oracle(steps: int = 60) -> str:
    """The same mix in SQL: the multiplier by halving its bracket, one query level a step."""
    head = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM total),
levelled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
goal AS (SELECT k, source, source_size, coalesce(least(cap, weight * (SELECT lv FROM levelled WHERE lv <= cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1)), cap) AS target FROM levelled),
cells AS MATERIALIZED (SELECT k, size, count(*) AS n FROM sized JOIN total ON sized.source IS NOT DISTINCT FROM total.source GROUP BY k, size),
shape AS (SELECT k, sum(n * size) / sum(n)::DOUBLE AS unit, min(size) AS least FROM cells WHERE size > 0 GROUP BY k),
s0 AS (SELECT g.k, target, source_size, coalesce(unit, 1) AS unit, -60.0::DOUBLE AS lo, coalesce(ln(3.0::DOUBLE) * unit / least, 0) AS hi FROM goal g LEFT JOIN shape USING (k))"""
    mass = "sum(n * size * CASE WHEN mid * size / unit < ln(3.0::DOUBLE) THEN exp(mid * size / unit) ELSE 3.0 END)"
    steps_sql = "".join(
        f""",
s{i + 1} AS MATERIALIZED (SELECT s.k, target, source_size, unit, CASE WHEN coalesce(m, target) <= target THEN mid ELSE lo END AS lo, CASE WHEN coalesce(m, target) > target THEN mid ELSE hi END AS hi
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM s{i}) s LEFT JOIN (SELECT c.k, {mass} AS m FROM cells c JOIN (SELECT *, (lo + hi) / 2 AS mid FROM s{i}) x ON c.k = x.k GROUP BY c.k) y ON s.k = y.k)"""
        for i in range(steps)
    )
    return head + steps_sql + rf""",
rated AS (SELECT c.k, c.size, c.n, unit, source_size, target, CAST(least(round(exp(least((CASE WHEN target >= source_size * 3.0 * (1 - 1e-12) THEN hi ELSE lo END) * c.size / unit, ln(3.0::DOUBLE))) * {PARTS}), {MOST * PARTS}) AS BIGINT) AS rate FROM cells c JOIN s{steps} s ON c.k = s.k),
summed AS (SELECT *, CAST(sum(n * rate) OVER (PARTITION BY k ORDER BY size) AS BIGINT) AS upto FROM rated),
tried AS (SELECT k, size > unit AS large, i, sum(size * ((upto + i * {PARTS} // {STARTS}) // {PARTS} - (upto - n * rate + i * {PARTS} // {STARTS}) // {PARTS})) AS w
          FROM summed, range({STARTS}) t(i) GROUP BY k, large, i),
sides AS (SELECT k, i, coalesce(sum(w) FILTER (large), 0) AS high, coalesce(sum(w) FILTER (NOT large), 0) AS low FROM tried GROUP BY k, i),
begun AS (SELECT a.k, a.i * {PARTS} // {STARTS} AS low, b.i * {PARTS} // {STARTS} AS high FROM sides a JOIN sides b ON a.k = b.k JOIN goal ON a.k = goal.k
          QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY abs(a.low + b.high - target), a.i, b.i) = 1),
placed AS (SELECT summed.*, upto - n * rate + CASE WHEN size > unit THEN high ELSE low END AS before FROM summed JOIN begun USING (k)),
ranked AS (SELECT d.doc_id, d.size, t.k, row_number() OVER (PARTITION BY t.k, d.size ORDER BY coalesce(((d.doc_id % {SALTS}) + {SALTS}) % {SALTS}, 0), d.doc_id NULLS LAST) AS r
           FROM sized d JOIN total t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, ranked.size, source_size, round(target, 4) AS target,
       CAST(((before + r * rate) // {PARTS} - (before + (r - 1) * rate) // {PARTS}) * ranked.size AS BIGINT) AS taken
FROM ranked JOIN placed ON ranked.k = placed.k AND ranked.size = placed.size
"""


ORACLE = oracle()
