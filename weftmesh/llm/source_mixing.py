"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of the word budget by its weight.  A source's target is
met by complete epochs over all its documents first, then by a fractional
selection: documents get the exponential key ``-ln(u) / quality weight`` (the
smallest keys are a weighted sample without replacement), are ordered by key
within the source, and are taken while their prefix sum of sizes stays within
the budget.

A source may hold any share of the rows, so its keys are never ordered in one
group: keys are cut into equal-chance ranges, sizes are summed by range, and
only the range that the budget ends in is ordered by key.

Edge cases: null text has size 0 and is never taken; a null source is a source of
its own, last in order; repeated rows each count and tie (equal rows are
interchangeable); sources of size 0 get target 0; an empty table gives an empty
result; u comes from a hash of the id and seed, so reruns agree.  Documents with
a null id share one u and are ordered among themselves by size and a hash of
their quality and other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code point order, repeating.
CYCLE = (5, 2, 1)
#: A source is repeated at most so many times.
MAX_EPOCHS = 3
#: Rows that a key range should hold.
RANGE_ROWS = 4_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's sampling weight, in (0, 1]: falls with the share of symbols among its words."""
    return 1 / (1 + 10 * F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), F.lit(0)) / F.greatest(size, F.lit(1)))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) one row a source -> adds weight and target.

    Targets are ``least(cap, level * weight)`` with the level at which they add up
    to all words: what a capped source leaves is shared by weight among the rest
    until no target is above its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.row_number().over(order) - 1) % len(cycle) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # Were all sources up to here capped, the level for the others would be this:
    level = (F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("_level", level).withColumn("_free", F.col("cap") / F.col("weight") >= F.col("_level"))
    chosen = F.min(F.when(F.col("_free"), F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("level")))).over(all_rows)["level"]
    return levels.withColumn("target", F.least("cap", F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(sized: DataFrame, seed: int = 7, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, quality) -> adds source_size, target and taken.

    ``sized`` is read several times: pass a materialized table.  Other columns are
    carried, whatever their names; those named source_size, target or taken are
    replaced.
    """
    sized = sized.drop("source_size", "target", "taken")
    own = sized.columns
    more = [c for c in own if c not in ("doc_id", "source", "size", "quality")]
    carried = F.struct(*[F.col(f"`{c}`") for c in more]) if more else F.lit(None).cast("string")
    sized = sized.select("doc_id", "source", "size", "quality", carried.alias("_carried"))
    per_source = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("_rows"), F.avg("quality").alias("_mean"))
    targets = source_targets(per_source.select("source", "source_size"), cycle, max_epochs)
    per_source = per_source.drop("source_size").withColumnRenamed("source", "_s")
    targets = targets.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    targets = materialize(targets.withColumn("_ranges", F.greatest(F.lit(1), F.ceil(F.col("_rows") / RANGE_ROWS))), "mix-targets")

    u = (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)
    key = -F.log(u) / F.col("quality")
    keyed = sized.withColumn("_key", key).join(F.broadcast(targets.withColumnRenamed("source", "_s")) if targets.count() <= 10_000 else targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Monotone in the key, and near to uniform, as keys are nearly exponential:
    spread = 1 - F.exp(-F.col("_key") * F.col("_mean"))
    keyed = keyed.withColumn("_range", F.least(F.col("_ranges") - 1, F.floor(spread * F.col("_ranges"))).cast("bigint"))

    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"), F.max("_budget").alias("_budget"))
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    ends = sums.where("_before < _budget and _before + _sum >= _budget").groupBy("source").agg(F.min(F.struct("_range", "_before")).alias("e"))
    ends = materialize(ends.select(F.col("source").alias("_s"), F.col("e._range").alias("_end"), F.col("e._before").alias("_before")), "mix-ends")
    placed = keyed.join(F.broadcast(ends) if ends.count() <= 10_000 else ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # Only the range in which the budget ends is ordered; the other rows each stand alone.
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "_tie")
    inside = F.col("_end").isNotNull() & (F.col("_range") == F.col("_end"))
    placed = placed.withColumn("_tie", F.xxhash64("quality", "_carried") if not more or "map<" not in sized.schema["_carried"].dataType.simpleString() else F.xxhash64("quality"))
    last = placed.where(inside).withColumn("_upto", F.col("_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.withColumn("_once", (F.col("_upto") - F.col("size") / 2 <= F.col("_budget")).cast("int"))
    rest = placed.where(~inside).withColumn("_upto", F.lit(0).cast("bigint")).withColumn("_once", (F.col("_end").isNotNull() & (F.col("_range") < F.col("_end"))).cast("int"))
    both = last.unionByName(rest)
    out = both.withColumn("taken", ((F.col("_epochs") + F.when(F.col("_budget") > 0, F.col("_once")).otherwise(0)) * F.col("size")).cast("bigint"))
    return out.select(*[F.col(f"_carried.`{c}`").alias(c) if c in more else F.col(c) for c in own], "source_size", "target", "taken")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", "text").withColumn("size", n_words(F.col("text"))).withColumn("quality", quality_weight(F.col("text"), F.col("size")))
    sized = materialize(sized.drop("text"), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same keys, ordered in whole sources, without ranges.
OP7_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) as n_symbols
  from documents),
weighted as (select doc_id, source, size, 1 / (1 + 10 * n_symbols::double / greatest(size, 1)) as quality from sized),
per_source as (select source, sum(size)::bigint as source_size from weighted group by source),
ranked as (select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 3.0::double * source_size as cap from per_source),
levels as (
  select *, cap / weight as ratio,
    ((sum(source_size) over ())::double - coalesce(sum(cap) over w, 0)) / ((sum(weight) over ()) - coalesce(sum(weight) over w, 0)) as level
  from ranked window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
chosen as (select arg_min(level, ratio) as level from levels where ratio >= level),
targets as (select source, source_size, least(cap, coalesce(chosen.level, 0) * weight) as target from levels, chosen),
budgets as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from targets),
keyed as (
  select d.doc_id, d.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size as budget, d.source, d.quality,
    -ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double + 1) / 4503599627370497.0::double) / d.quality as key
  from weighted d join budgets b on d.source is not distinct from b.source),
summed as (select *, sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) as upto from keyed)
select doc_id, size, source_size, target,
  ((epochs + case when budget > 0 and upto - size < budget and upto - size / 2.0 <= budget then 1 else 0 end) * size)::bigint as taken
from summed
"""
