"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key; within its source the documents are ordered by that key, a
distributed prefix sum of their sizes gives each its place on the source's word axis, and the
source's budget cuts the axis: whole rounds (epochs) first, then the prefix that fills the rest. The
document on the cut is taken in part, so a source's total is its rounded target exactly.

Scale: the key space is cut into equal ranges, more of them for more rows, so the sort of one source runs as many
independent tasks however large the source is; only one row per (source, range) goes through the second level
of the prefix sum, and one row per source through the budget. Texts are never shuffled.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; a repeated row is a document of its own; ties of the key are broken by
doc_id, then size, and equal rows beyond that are interchangeable; very long texts are counted whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, pick, text_or_empty

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 20240101
#: Rows in one range of keys, about, if all were of one source.
RANGE_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def budgets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of `sizes` (source, size): source, source_size, target (double).

    The sources in code point order (null last) weigh `weights`, repeating. They share the sum of all
    sizes; a target stops at max_epochs times its source's size, and what it leaves is shared again by
    weight. Sorted by size over weight, the stopped sources are a prefix, so prefix sums find the
    fixed point without a loop. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = W.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
    by_ratio = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    left = F.sum("source_size").over(everyone) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    cap = (max_epochs * F.col("source_size")).cast("double")
    per = per.withColumn("_left", left.cast("double")).withColumn("_weight_left", weight_left)
    stops = cap * F.col("_weight_left") <= F.col("_left") * F.col("weight")
    per = per.withColumn("_stops", stops)
    # the first source that isn't stopped fixes the share of all after it
    at = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "_left", "_weight_left")
    first = F.min(F.when(~F.col("_stops"), at)).over(everyone)
    share = F.col("weight") * first["_left"] / first["_weight_left"]
    return per.select(
        "source",
        "source_size",
        F.when(F.col("source_size") == 0, 0.0).when(F.col("_stops"), cap).otherwise(share).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    digits: int | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document that the mix takes).

    digits: leading hexadecimal digits of the random key that name a range, so each source is cut into
    16**digits ranges (by default as the number of rows asks); a matter of layout alone, the result is the same for any.
    """
    rows = cut(sized(pick(docs, "doc_id", "source", "text"), seed).drop("text"))
    return cut_at_budgets(rows, weights, max_epochs, digits or digits_for(rows.count())).select("doc_id", "size", "source_size", "target", "taken")


def digits_for(n_rows: int) -> int:
    """Hexadecimal digits that give ranges of RANGE_ROWS rows or fewer, two at least."""
    return max(2, math.ceil(math.log(max(1, n_rows / RANGE_ROWS), 16)))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size (words) and key (16 random hexadecimal digits that depend on doc_id and seed alone; without an id on the
    text, so that such rows spread over the ranges)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty()))))
    return docs.withColumns({"size": word_count(text_or_empty()), "key": F.substring(F.md5(named), 1, 16)})


def cut_at_budgets(
    rows: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, digits: int = 2
) -> DataFrame:
    """rows (doc_id, source, size, key and any others) with source_size, target and taken added."""
    # a source without nulls, so that window and join ask for the same partitioning and texts move once
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumns({"_source": named, "_range": F.substring("key", 1, digits)})
    per_range = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_range_size"))
    ahead = W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per_range = per_range.select(
        "_source", "_range", F.coalesce(F.sum("_range_size").over(ahead), F.lit(0)).alias("_ahead")
    )
    per_source = budgets(rows.select("source", "size"), weights, max_epochs)
    marks = per_range.join(per_source.withColumn("_source", named).drop("source"), "_source")
    within = W.partitionBy("_source", "_range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(marks, ["_source", "_range"]).withColumn("_start", F.col("_ahead") + F.col("_within"))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    return joined.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("_source", "_range", "_within", "_ahead", "_start")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, digits: int | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (columns of these names are replaced), without those of which nothing is
    taken. Texts move once, to their place in the order."""
    added = ("size", "source_size", "target", "taken")
    rest = [c for c in docs.columns if c not in ("doc_id", "source", "text", *added)]
    held = docs.select("doc_id", "source", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    rows = cut_at_budgets(sized(held, seed), weights, max_epochs, digits or digits_for(docs.count())).filter("taken > 0")
    own = [c for c in docs.columns if c not in added]
    return rows.select(*[F.col(f"rest.`{c}`") if c in rest else F.col(c) for c in own], *added)


ORACLE_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    substr(md5('20240101:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))), 1, 16) as key
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight from s
), r as (
  select *, 3 * source_size as cap, source_size / weight as ratio,
    sum(source_size) over () - 3 * coalesce(sum(source_size) over q, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over q, 0) as rest_weight
  from w
  window q as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), f as (
  select *, cap * rest_weight <= rest * weight as stops from r
), t as (
  select source, source_size, case when source_size = 0 then 0.0 when stops then cast(cap as double)
    else weight * cast(first_value(rest) over u as double) / first_value(rest_weight) over u end as target
  from f
  window u as (order by stops, ratio, source nulls last rows between unbounded preceding and unbounded following)
), p as (
  select d.doc_id, cast(d.size as bigint) as size, t.source_size, t.target, cast(round(t.target) as bigint) as total,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
      rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0
    else (total // source_size) * size + greatest(0, least(size, total - (total // source_size) * source_size - start))
    end as bigint) as taken
from p
"""
