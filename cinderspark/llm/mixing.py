"""Mixing sources to target weights in whole blocks of equal token counts.

Blocks go to sources, and within a source to its shards, by the highest quotients votes / (2 k + 1). Each
shard lays its documents out in a seeded order and takes so many full passes and, for the rest, blocks in a
seeded order.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderspark.llm.common import Scratch

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order, null last. A block is ``block`` words. Targets stop
    at ``most`` times the source. A source has one shard for ``shard`` words, ``shards`` at most."""

    weights: tuple[int, ...] = (1, 2, 3)
    share: float = 1.0
    most: int = 3
    block: int = 32
    shard: int = 250_000
    shards: int = 4096
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Add ``weight`` and ``target`` to (``source``, ``source_size``), one row per source.

    Filling up by weight with ceilings has a closed form: in rising order of ceiling / weight, the first
    sources stay at their ceilings and the level of the rest follows from what is left. The windows go over
    sources, not documents.
    """
    by_code_point = Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighed = sources.withColumn("_place", F.row_number().over(by_code_point) - 1).withColumns(
        {
            "weight": F.element_at(cycle, (F.col("_place") % len(mix.weights) + 1).cast("int")),
            "_ceiling": F.col("source_size") * float(mix.most),
        }
    )
    everything = Window.partitionBy()
    rising = Window.partitionBy().orderBy(F.col("_ceiling") / F.col("weight"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(mix.share) - F.coalesce(F.sum("_ceiling").over(rising), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    )
    open_ = F.col("_ceiling") > F.col("_level") * F.col("weight")
    first_open = F.min(F.when(open_, F.struct("_order", "_level"))).over(everything)["_level"]
    return (
        weighed.withColumns({"_level": level, "_order": F.col("_ceiling") / F.col("weight")})
        .withColumn("_final", first_open)
        .withColumn("target", F.least("_ceiling", F.coalesce(F.col("_final") * F.col("weight"), F.col("_ceiling"))))
        .select("source", "source_size", "weight", "target")
    )


def sainte_lague(votes: DataFrame, party: list[str], seats: str, of: str, within: list[str] | None = None) -> DataFrame:
    """Add whole numbers ``quota`` that share out ``seats`` by the highest quotients of ``of``; ties by ``party``.

    Rounding each share gives all but a few seats. Those missing (or too many) are the highest (lowest)
    quotients next to the rounded ones, of which each party shows as many as could change. ``seats`` is the
    same in all rows of a ``within`` group; a group without votes gets none.
    """
    within = within or []
    group = Window.partitionBy(*within)
    total = F.sum(of).over(group)
    fair = F.coalesce(F.try_divide(F.col(of) * F.col(seats), total), F.lit(0.0))
    rounded = votes.withColumns({"_fair": fair, "_total": total}).withColumn("_base", F.floor(F.col("_fair") + 0.5))
    short = F.when(F.col("_total") > 0, F.col(seats) - F.sum("_base").over(group)).otherwise(F.lit(0))
    open_ = rounded.withColumn("_short", short.cast("bigint"))
    reach = F.ceil(F.abs("_short") * F.coalesce(F.try_divide(F.col(of), F.col("_total")), F.lit(0.0))) + 2
    down = F.least(reach, F.col("_base"))
    steps = (
        F.when((F.col("_short") > 0) & (F.col(of) > 0), F.sequence(F.col("_base"), F.col("_base") + reach))
        .when((F.col("_short") < 0) & (F.col("_base") > 0), F.sequence(F.col("_base") - down, F.col("_base") - 1))
        .otherwise(F.array(F.lit(-1).cast("bigint")))
    )
    shown = open_.withColumn("_k", F.explode(steps)).withColumn(
        "_quotient", F.when(F.col("_k") >= 0, F.col(of) / (2 * F.col("_k") + 1))
    )
    best = F.when(F.col("_short") >= 0, -F.col("_quotient")).otherwise(F.col("_quotient"))
    ordered = Window.partitionBy(*within).orderBy(F.col("_k") < 0, best, *party, "_k")
    changes = (F.col("_k") >= 0) & (F.row_number().over(ordered) <= F.abs("_short"))
    change = F.sum(F.when(changes, F.signum("_short").cast("bigint")).otherwise(F.lit(0)))
    return shown.withColumn("_changes", F.when(changes, F.signum("_short").cast("bigint")).otherwise(F.lit(0))).groupBy(
        *votes.columns, "_base"
    ).agg(F.sum("_changes").alias("_change")).withColumn("quota", F.col("_base") + F.col("_change")).drop("_base", "_change")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes, repeats counted).

    A null source is a source. Null and empty texts have size 0 and are never taken. Rows that repeat are
    documents of their own. Sharding by a hash of the id splits a source however large it is.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    named = docs.select(*keep, "source", word_count(F.col("text")).alias("size"))
    sizes = scratch.keep(named, "sizes")
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / mix.block).cast("bigint")
    quotas = sainte_lague(by_source.withColumn("_seats", blocks), ["source"], "_seats", "target").withColumns(
        {"_source_quota": F.col("quota"), "_shards": F.greatest(F.lit(1), F.least(F.lit(mix.shards), F.ceil(F.col("source_size") / mix.shard))).cast("int")}
    )
    of_source = scratch.keep(quotas.select("source", "source_size", "target", "_source_quota", "_shards"), "sources")

    same = F.col("_s").eqNullSafe(F.col("source"))
    # One row per source; the planner broadcasts it while it is small.
    sharded = (
        sizes.join(of_source.withColumnRenamed("source", "_s"), same)
        .drop("_s")
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit(mix.seed), *keep), F.col("_shards")).cast("int"))
    )
    shard_sizes = sharded.groupBy("source", "_shard", "_source_quota").agg(F.sum("size").alias("_shard_size"))
    shard_quotas = scratch.keep(
        sainte_lague(
            shard_sizes.withColumn("_votes", F.col("_shard_size").cast("double")), ["_shard"], "_source_quota", "_votes", ["source"]
        ).select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_shard_size", F.col("quota").alias("_quota")),
        "shards",
    )

    words = F.least(F.col("_quota") * mix.block, F.col("_shard_size") * mix.most)
    passes = F.coalesce(F.floor(F.try_divide(words, F.col("_shard_size"))), F.lit(0))
    rest = F.round((words - F.col("_passes") * F.col("_shard_size")) / mix.block)
    drawn = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(mix.seed + 1), *keep), *keep, "size")
    laid = (
        sharded.join(shard_quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
        .withColumn("_passes", passes)
        .withColumns(
            {
                "_rest": rest,
                "_row": F.row_number().over(drawn),
                "_end": F.sum("size").over(drawn.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .withColumn("_start", F.col("_end") - F.col("size"))
    )
    last = F.floor((F.greatest(F.col("_end"), F.col("_start") + 1) - 1) / mix.block)
    spread = laid.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / mix.block), last)))
    inside = F.greatest(
        F.lit(0), F.least(F.col("_end"), (F.col("_block") + 1) * mix.block) - F.greatest(F.col("_start"), F.col("_block") * mix.block)
    )
    turn = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(mix.seed + 2), "source", "_shard", "_block"), "_block")
    chosen = F.dense_rank().over(turn) <= F.col("_rest")
    taken = spread.withColumn("_taken", F.col("_passes") * inside + F.when(chosen, inside).otherwise(F.lit(0)))
    fixed = [*keep, "size", "source_size", "target"]
    return (
        taken.groupBy("source", "_shard", "_row", *fixed)
        .agg(F.sum("_taken").cast("bigint").alias("taken"))
        .select(*keep, "source", "size", "source_size", "target", "taken")
    )
