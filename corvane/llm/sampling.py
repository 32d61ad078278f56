"""Problem 5: a sample that stays the same over reruns, partitionings and growth.

Frozen-batch bottom-k: rows belong to immutable arrival batches; of each batch exactly ``ceil(rate * size)`` units with
the smallest salted hash are kept. A later batch never touches an earlier one, so the union of batches only grows.

No batch is ranked as a whole: hashes are counted in 4096 ranges per batch, the ranges below the cut are taken as they
are, and only the one range that holds the cut is ranked. A batch with a third of all rows thus spreads over its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.skew import skew_join
from corvane.session import cut as cut_lineage

RANGE_DIGITS = 3  # hexadecimal: 16 ** 3 = 4096 ranges


def salted_hash(unit: Column, salt: str) -> Column:
    """md5 of salt and unit as hexadecimal text: the same on every engine, so a SQL oracle can repeat it."""
    return F.md5(F.concat(F.lit(salt), F.lit("|"), unit.cast("string")))


def frozen_bottom_k(units: DataFrame, unit: str, batch: str, rate: float, salt: str) -> DataFrame:
    """The sampled (unit, batch) of ``units``: one row per unit, with the batch it arrived in.

    Of n units in a batch ceil(rate * n) are kept. Units without a batch form no immutable batch, so each is judged by
    its own hash alone (kept if the hash, as a fraction, lies below ``rate``), which is stable too. Null units are
    never sampled. Equal hashes are ordered by the unit itself. ``units`` must have one row per unit.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    h = units.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.col(batch).alias("batch"))
    h = h.withColumn("h", salted_hash(F.col("unit"), salt)).withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    dated = h.where(F.col("batch").isNotNull())
    counts = dated.groupBy("batch", "range").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("batch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.ceil(F.lit(rate) * F.sum("n").over(Window.partitionBy("batch")) - F.lit(1e-9))
    plan = counts.select("batch", "range", (quota - F.coalesce(below, F.lit(0))).alias("left"), "n").where(F.col("left") > 0)
    taken = dated.join(plan, ["batch", "range"])
    whole = taken.where(F.col("left") >= F.col("n"))
    rank = F.row_number().over(Window.partitionBy("batch", "range").orderBy("h", "unit"))
    cut = taken.where(F.col("left") < F.col("n")).withColumn("rank", rank).where(F.col("rank") <= F.col("left"))
    fraction = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.lit(16.0**8)
    undated = h.where(F.col("batch").isNull() & (fraction < F.lit(rate)))
    return whole.select("unit", "batch").unionByName(cut.select("unit", "batch")).unionByName(undated.select("unit", "batch"))


def extended(seen: DataFrame, sampled: DataFrame, units: DataFrame, unit: str, batch: str, rate: float, salt: str) -> tuple[DataFrame, DataFrame]:
    """(seen, sampled) after a further load: only units that were not ``seen`` are judged, in the batches they have now.

    Earlier decisions are frozen, not made again: a row of a seen unit that arrives later with an earlier time moves
    nothing. ``seen`` and ``sampled``: (unit, batch). The batches of the new units are their own, even where a name
    of a batch occurred before: of n new units in a batch ceil(rate * n) are added.
    """
    new = cut_lineage(units.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.col(batch).alias("batch")).join(seen.select("unit"), "unit", "left_anti"))
    return seen.select("unit", "batch").unionByName(new), sampled.select("unit", "batch").unionByName(frozen_bottom_k(new, "unit", "batch", rate, salt))


def arrivals(entries: DataFrame, unit: str) -> DataFrame:
    """(unit, batch): each unit's first arrival day. A re-delivered or later row of a unit doesn't move it.

    Empty units are missing. The group-by combines map-side, so a name with a tenth of the rows moves as one row a task.
    """
    return (
        entries.where(F.coalesce(F.col(unit), F.lit("")) != "")
        .groupBy(F.col(unit).alias("unit"))
        .agg(F.min("ingested_at").alias("first"))
        .select("unit", F.date_format("first", "yyyy-MM-dd").alias("batch"))
    )


def sample_by_id(entries: DataFrame, rate: float = 0.1, salt: str = "corvane-id-1") -> DataFrame:
    """(theory_id, batch) of the sampled ids. Every row of a sampled id belongs to the sample."""
    return frozen_bottom_k(arrivals(entries, "theory_id"), "unit", "batch", rate, salt).withColumnRenamed("unit", "theory_id")


def sample_by_name(entries: DataFrame, rate: float = 0.1, salt: str = "corvane-name-1") -> DataFrame:
    """(normalized_name, batch) of the sampled names: all rows of a name or none."""
    return frozen_bottom_k(arrivals(entries, "normalized_name"), "unit", "batch", rate, salt).withColumnRenamed("unit", "normalized_name")


def rows_of_names(entries: DataFrame, names: DataFrame) -> DataFrame:
    """The entries whose normalized_name was sampled. A name may own a third of the rows: those of heavy names stay where they are."""
    return skew_join(entries, names.select("normalized_name").distinct(), "normalized_name").select(*entries.columns)
