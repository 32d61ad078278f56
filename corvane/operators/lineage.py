"""The path of every mention through the naming stages: one wide row, built by left joins, judged by when-chains.

A stage is skipped once an earlier one completed; it completes where the name it yields is on the canonical list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.names import final_name


def seed(mentions: DataFrame) -> DataFrame:
    """Stage 0: one row per mention id (the first delivery), with what is known about it."""
    known = ["theory_id", "original_name", "doi", "paper_focus", "mode", "confidence_is_theory"]
    order = F.struct("ingested_at", "doi", "original_name", "mode", "confidence_is_theory", "paper_focus")
    rows = mentions.where(F.coalesce(F.col("theory_id"), F.lit("")) != "").groupBy("theory_id").agg(*[F.min_by(c, order).alias(c) for c in known[1:]])
    return rows.withColumn("name", F.col("original_name")).withColumn("done_at", F.lit(None).cast("string"))


def _listed(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    names = listed.select(F.col("name").alias("__listed")).distinct()
    return rows.join(names, rows[column] == F.col("__listed"), "left")


def stage(rows: DataFrame, label: str, mapping: DataFrame, listed: DataFrame, by: str, value: str, fallback: str | None = None) -> DataFrame:
    """Add ``{label}_status`` and ``{label}_name``: the name after this stage.

    ``mapping`` (by, value) is looked up by ``name``, or by the mention's id where ``by`` is theory_id; with ``fallback``
    a second lookup by that column follows. Status: skipped, completed, mapped, or warning (no mapping found).
    """
    pairs = mapping.select(F.col(by).alias("__k"), F.col(value).alias("__v")).where(F.coalesce(F.col("__v"), F.lit("")) != "").dropDuplicates(["__k"])
    key = "theory_id" if by == "theory_id" else "name"
    out = rows.join(pairs, rows[key] == F.col("__k"), "left").drop("__k").withColumnRenamed("__v", "__new")
    if fallback:
        second = pairs.select(F.col("__k").alias("__k2"), F.col("__v").alias("__v2"))
        out = out.join(second, F.col("__new").isNull() & (F.col(fallback) == F.col("__k2")), "left").withColumn("__new", F.coalesce("__new", "__v2")).drop("__k2", "__v2")
    out = _listed(out, listed, "__new")
    done = F.col("done_at").isNotNull()
    completed = F.col("__listed").isNotNull()
    status = F.when(done, "skipped").when(completed, "completed").when(F.col("__new").isNotNull(), "mapped").otherwise("warning")
    return (
        out.withColumn(f"{label}_status", status)
        .withColumn(f"{label}_name", F.when(~done, F.coalesce("__new", "name")))
        .withColumn("name", F.when(~done, F.coalesce("__new", "name")).otherwise(F.col("name")))
        .withColumn("done_at", F.when(~done & completed, F.lit(label)).otherwise(F.col("done_at")))
        .drop("__new", "__listed")
    )


def verdict(rows: DataFrame, validations: DataFrame, listed: DataFrame) -> DataFrame:
    """The last stage: final_name, its normal form, final_status and warnings.

    ``validations``: original_name, is_valid_theory (valid, invalid, doubted), is_listed, listed_name. A completed mention
    is valid. Otherwise a listed name that the list has counts as mapped; one it lacks is a warning.
    """
    v = validations.select(F.col("original_name").alias("__o"), "is_valid_theory", "is_listed", "listed_name").dropDuplicates(["__o"])
    out = rows.join(v, rows.name == F.col("__o"), "left")
    out = _listed(out, listed, "listed_name")
    done = F.col("done_at").isNotNull()
    on_list = F.coalesce(F.col("is_listed"), F.lit(False)) & F.col("__listed").isNotNull()
    last = F.when(done, "skipped").when(F.col("__o").isNull(), "missing").when(on_list, "mapped_to_ontology").when(F.coalesce(F.col("is_listed"), F.lit(False)), "warning").otherwise(F.col("is_valid_theory"))
    final = F.when(done, F.col("name")).when(on_list, F.col("listed_name")).otherwise(F.col("name"))
    status = F.when(done | on_list, "valid").when(F.col("is_valid_theory") == "valid", "valid").when(F.col("is_valid_theory").isNotNull(), "not valid").otherwise("unknown")
    return (
        out.withColumn("last_status", last)
        .withColumn("final_name", final)
        .withColumn("final_name_normalized", final_name(final))
        .withColumn("final_status", status)
        .withColumn("name_warning", F.coalesce(final, F.lit("")) == "")
        .withColumn("status_warning", status == "unknown")
        .drop("__o", "__listed", "is_valid_theory", "is_listed", "listed_name")
    )


def waterfall(rows: DataFrame, *buckets: tuple[str, Column]) -> DataFrame:
    """(bucket, n): each row in the first bucket whose condition holds, else unmatched."""
    pick = None
    for name, condition in buckets:
        pick = F.when(condition, name) if pick is None else pick.when(condition, name)
    return rows.groupBy(pick.otherwise("unmatched").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(stage, status, mentions, names) over all stages."""
    out = None
    for label in labels:
        part = rows.groupBy(F.col(f"{label}_status").alias("status")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(f"{label}_name").alias("names")).select(F.lit(label).alias("stage"), "status", "mentions", "names")
        out = part if out is None else out.unionByName(part)
    return out
