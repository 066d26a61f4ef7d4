"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Every source has a weight; together they share all words.  A source may be repeated at most
`epochs` times: its target is min(epochs * size, level * weight), where the level is the one at
which the targets add up to the total.  That is the fixed point of clamping the sources that are
above their cap and resharing the excess by weight until none is above.

A target is met by whole repetitions of the source and one fractional one.  The fractional one takes
documents in the order of a seeded MD5 of their id until its words are spent; running sums are made
from buckets of that order, so that no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stash

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights=(1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null a source too.

    Sources rank by code point, null last, and weigh `weights`, repeating.  There is one row for each
    source here, never one for each document, so the windows over all of it stay as small as the list of sources.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = (totals.withColumn("_w", F.element_at(w, (rank % len(weights) + 1).cast("int")))
              .withColumn("_cap", (F.col("source_size") * epochs).cast("double")))
    fill = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # the level rises while the sources before are rightly clamped and falls once one is clamped that is not above its cap
    return (ranked.withColumn("_level", level)
            .withColumn("_final", F.max("_level").over(everything))
            .select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_final")).alias("target")))


def mix(docs: DataFrame, weights=(1, 2, 3), epochs: int = 3, seed: int = 7, cut: bool = True,
        buckets: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats) for every row of docs(doc_id, text, source).

    `taken` is the number of words that the mix takes of a row and `repeats` how often the whole row
    is in it.  With `cut`, the row at which the fractional repetition ends is taken in part, so that the
    words taken of a source are its target rounded to whole words; without it a row is taken whole if at least half of it fits.

    Null text: size 0, taken 0.  Null source: a source of its own.  Null doc_id: ordered by an empty id.
    Repeated rows are rows of their own, told apart by nothing but their share of the order.  An
    empty table gives an empty result.  `carry` names further columns to return, under their names.
    """
    part = only(docs, "doc_id", "text", "source", *carry)
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stash(part.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("_h"), *carry), "mix")
    width = (buckets - 1).bit_length()
    bucket = F.shiftright(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 16 - width)
    sized = sized.withColumn("_b", bucket)
    cells = sized.groupBy("source", "_b").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, epochs)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_words").over(upto), F.lit(0).cast("bigint")))
    cells = cells.alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source")).select(
        F.col("c.source").alias("_s"), F.col("c._b").alias("_cb"), "_ahead", "source_size", "target")
    inner = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0).cast("bigint")))
    rows = rows.join(cells, F.expr("source <=> _s and _b = _cb"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    left = (F.round("target") - F.col("_whole") * F.col("source_size")).cast("bigint") - F.col("_ahead") - F.col("_in")
    rows = rows.withColumn("_whole", whole).withColumn("_left", left)
    extra = F.least(F.greatest(F.col("_left"), F.lit(0).cast("bigint")), F.col("size"))
    more = (F.col("_left") * 2 >= F.col("size")) & (F.col("_left") > 0)
    if not cut:
        extra = F.when(more, F.col("size")).otherwise(F.lit(0).cast("bigint"))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("_whole") * F.col("size") + extra).alias("taken"),
                       (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("int").alias("repeats"), *carry)


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat('7:', coalesce(cast(doc_id as varchar), ''))) as h from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select source, source_size, (3 * source_size)::double as cap,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from totals),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last
             rows between unbounded preceding and 1 preceding), 0))::double
         / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as lvl
  from ranked),
goal as (
  select source, source_size, least(cap, w * (max(lvl) over ())) as target
  from filled),
ordered as (
  select s.doc_id, s.size, g.source_size, g.target,
         case when g.source_size > 0 then floor(g.target / g.source_size)::bigint else 0 end as whole,
         coalesce(sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size
                  rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from sized s join goal g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (whole * size + least(greatest(round(target)::bigint - whole * source_size - ahead, 0), size))::bigint as taken
from ordered
"""
