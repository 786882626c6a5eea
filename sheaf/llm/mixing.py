"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.running import before, slots
from sheaf.llm.store import workspace, written
from sheaf.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """Weights by the sources' code-point order, repeating; the total and the most of a source, as multiples of all sizes.

    ``ramps``: for each weight, how its schedule changes over the training, which runs from 0 to 1: a source's
    weight at time u is in proportion to 1 - ramp + 2 * ramp * u. Its integral over the training is 1, so a
    ramp moves words in time and leaves the source's total alone. Ramps lie between -1 and 1.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    ramps: tuple[float, ...] = (-0.5, 0.0, 0.5)
    total: float = 1.5
    most: float = 2.0


def time_of(done: Column, ramp: Column) -> Column:
    """When a source has given the share ``done`` of its words: the inverse of the integrated schedule ramp * u^2 + (1 - ramp) * u."""
    flat = F.lit(1.0) - ramp
    return F.when(F.abs(ramp) < 1e-9, done).otherwise((F.sqrt(flat * flat + F.lit(4.0) * ramp * done) - flat) / (F.lit(2.0) * ramp))


def targets(facts: DataFrame, plan: MixPlan, at: str) -> DataFrame:
    """Each source's rank, size, weight, ramp and target words. The sources stay a table; the driver sees sums only.

    A target stops at ``plan.most`` times its source's size, and the excess is shared again by weight among
    the others until no target is above its stop.
    """
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), f"{at}/sources")
    ranked = before(ranged, [], "part", [F.col("source").isNull(), F.col("source")], F.lit(1), "rank")
    turn = F.pmod(F.col("rank"), F.lit(len(plan.weights))).cast("int") + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), turn)
    listed = written(
        ranked.select(
            "source", "source_size", pick(plan.weights).alias("weight"), pick(plan.ramps).alias("ramp"),
            (F.col("source_size") * plan.most).alias("stop")
        ),
        f"{at}/weights"
    )
    total, weight = listed.agg(F.sum("source_size") * F.lit(plan.total), F.sum("weight")).first()
    rate, last = (total / weight if weight else 0.0), None
    while rate != last:
        held = F.col("stop") < F.col("weight") * F.lit(rate)
        stopped, free = listed.agg(F.sum(F.when(held, F.col("stop"))), F.sum(F.when(~held, F.col("weight")))).first()
        last, rate = rate, ((total - (stopped or 0.0)) / free if free else rate)
    return listed.withColumn("target", F.least(F.col("stop"), F.col("weight") * F.lit(rate)))


def mixed(
    docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """Each row's share of the mix: id, source, size, source_size, target, taken, position, again_at.

    A source's documents are put in the order of a hash of their ids and read, over and over, until its target
    in words is met; the last document may be taken in part, so a source's words miss the target by less than
    one. ``taken`` counts the words read of a document, ``position`` and ``again_at`` are the training times
    (0 to 1) at which its first and second reading start, null where there is none. Sizes are words between
    ASCII white space; a null or empty text has none and takes no part, but has its row. Null sources are one
    source, the last. Null ids share one place in the order; rows repeated in full are read one after the other.
    ``row_col`` names a key of the rows of a written table, which tells rows of one id apart: it is added as ``row``.
    """
    if plan.most > 2:
        raise ValueError("a document is read twice at most, so most is 2 at most")
    at = workspace(docs.sparkSession, "mix")
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    key = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(
        *key, F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), draw.alias("draw")
    )
    n = slots(docs)
    deal = F.floor(F.conv(F.substring("draw", 1, 6), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 24)).cast("int")
    facts = written(rows.withColumn("deal", deal), f"{at}/facts")
    aims = written(
        targets(facts, plan, at).withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source"), f"{at}/targets"
    )
    named = facts.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    placed = before(
        named, ["name"], "deal", [F.col("draw"), F.col("id"), F.col("size"), *(F.col("row") for _ in key)], F.col("size"), "start"
    ).join(aims, "name")
    goal = F.floor("target")
    read = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
    begins = lambda start: F.when((F.col("size") > 0) & (start < goal), time_of(start / F.col("target"), F.col("ramp")))
    second = F.col("start") + F.col("source_size")
    return placed.select(
        "id", "source", "size", "source_size", "target", (read(F.col("start")) + read(second)).cast("long").alias("taken"),
        begins(F.col("start")).alias("position"), begins(second).alias("again_at"), *(F.col("row") for _ in key)
    )


def curriculum(mix: DataFrame) -> DataFrame:
    """One row for each reading (id, position), range-sorted by position: the order of training."""
    readings = F.array_compact(F.array("position", "again_at"))
    return mix.select("id", F.explode(readings).alias("position")).orderBy("position", "id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix, in the order of the curriculum."""
    mix = mixed(table(spark, sf_dir, "documents"))
    return mix.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 9).alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + r % 3]::DOUBLE AS weight, [-0.5, 0.0, 0.5][1 + r % 3]::DOUBLE AS ramp, 2.0::DOUBLE * source_size AS stop FROM s),
f AS (SELECT *, coalesce(sum(stop) OVER o, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free, 1.5::DOUBLE * sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY stop / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - held) / free, stop / weight) FILTER (WHERE stop / weight >= (total - held) / free), 0) AS rate FROM f),
t AS (SELECT source, source_size, ramp, least(stop, weight * rate) AS target FROM w, l),
p AS (SELECT d.*, t.source_size, t.target, t.ramp, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)))::BIGINT AS taken,
       round(CASE WHEN size > 0 AND start < floor(target) THEN CASE WHEN ramp = 0 THEN start / target
ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * (start / target)) - (1 - ramp)) / (2 * ramp) END END, 9) AS position
FROM p
"""
