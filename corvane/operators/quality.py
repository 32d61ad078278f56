"""Conservation checks, health reports and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(missing, extra, duplicates): ids lost, ids made up, ids that occur more than once after a step."""
    a = before.where(F.col(key).isNotNull()).select(key).distinct().withColumn("a", F.lit(1))
    b = after.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, key, "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("b") > 1).alias("duplicates"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(same): whether both sides have the same set of keys."""
    return conservation(a, b, key).select(((F.col("missing") == 0) & (F.col("extra") == 0)).alias("same"))


def duplicated(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def health(requested: DataFrame, assigned: DataFrame, alarm: float = 0.3) -> DataFrame:
    """(cluster_name, requested, assigned, missing, extra, warnings, in_warnings, rate, severity) of checkpointed splits.

    ``assigned``: cluster_name, sub (the sub-cluster's key), status, theory_id. warnings counts the sub-clusters of status
    singleton_warning, in_warnings the ids that they list, rate is their share of the requested ids. critical: ids
    missing or made up, or no result at all; warning: a rate above ``alarm``; else ok.
    """
    r = requested.select("cluster_name", "theory_id", F.lit(1).alias("r")).distinct()
    listed = assigned.where(F.col("theory_id").isNotNull())
    a = listed.groupBy("cluster_name", "theory_id").agg(F.lit(1).alias("a"))
    ids = r.join(a, ["cluster_name", "theory_id"], "full").groupBy("cluster_name").agg(
        F.count("r").alias("requested"), F.count("a").alias("assigned"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra")
    )
    subs = listed.where("status = 'singleton_warning'").groupBy("cluster_name", "sub").agg(F.count(F.lit(1)).alias("n"))
    subs = subs.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("warnings"), F.sum("n").alias("in_warnings"))
    out = ids.join(subs, "cluster_name", "left").fillna(0, ["warnings", "in_warnings"])
    rate = F.coalesce(F.try_divide("in_warnings", "requested"), F.lit(0.0))
    severity = F.when((F.col("missing") > 0) | (F.col("extra") > 0) | (F.col("assigned") == 0), "critical").when(rate > F.lit(alarm), "warning").otherwise("ok")
    return out.select("cluster_name", "requested", "assigned", "missing", "extra", "warnings", "in_warnings", rate.alias("rate"), severity.alias("severity"))


def missing_ids(requested: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_name, theory_id, share): ids that no sub-cluster holds, with their share of the cluster."""
    lost = requested.select("cluster_name", "theory_id").distinct().join(assigned.select("cluster_name", "theory_id").distinct(), ["cluster_name", "theory_id"], "left_anti")
    n = requested.groupBy("cluster_name").agg(F.count_distinct("theory_id").alias("n"))
    per = lost.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("k")).join(n, "cluster_name").select("cluster_name", (F.col("k") / F.col("n")).alias("share"))
    return lost.join(per, "cluster_name")


def found_elsewhere(missing: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster_name, other, ids): missing ids that stand in other clusters."""
    other = assigned.select(F.col("cluster_name").alias("other"), "theory_id").distinct()
    return missing.join(other, "theory_id").where(F.col("other") != F.col("cluster_name")).groupBy("cluster_name", "other").agg(F.count_distinct("theory_id").alias("ids"))


def first_container(missing: DataFrame, clusters: DataFrame) -> DataFrame:
    """(theory_id, cluster_name): the first cluster, by pos, that holds each missing id."""
    return clusters.join(missing.select("theory_id").distinct(), "theory_id", "left_semi").groupBy("theory_id").agg(F.min_by("cluster_name", "pos").alias("cluster_name"))


def size_bucket(n: Column) -> Column:
    """The bounds of the size histogram."""
    return F.when(n > 100, ">100").when(n > 40, "41-100").when(n > 20, "21-40").when(n > 10, "11-20").when(n > 5, "6-10").otherwise("1-5")


def size_histogram(sizes: DataFrame, size: str) -> DataFrame:
    return sizes.groupBy(size_bucket(F.col(size)).alias("bucket")).agg(F.count(F.lit(1)).alias("groups"), F.sum(size).alias("members"))


def at_share(sizes: DataFrame, column: str, *shares: float) -> DataFrame:
    """(p..., n): the elements at index floor(n * share) of the sorted values (share 0.5 is the upper median).

    Values are counted first; the running count over distinct values finds each element, so no list of all values is
    made.
    """
    counts = sizes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    run = counts.withColumn("__upto", F.sum("__c").over(Window.orderBy("__v"))).withColumn("__n", F.sum("__c").over(Window.partitionBy(F.lit(1))))
    at = lambda s: F.least(F.floor(F.col("__n") * s), F.col("__n") - 1)
    picks = [F.min(F.when(F.col("__upto") > at(s), F.col("__v"))).alias(f"p{round(100 * s)}") for s in shares]
    return run.agg(*picks, F.max("__v").alias("max"), F.min("__v").alias("min"), F.max("__n").alias("n"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of tokens at prices per million."""
    return (F.coalesce(tokens_in, F.lit(0)) * price_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1e6
