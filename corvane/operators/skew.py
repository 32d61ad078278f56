"""Keys that hold most of the rows: find them with a mergeable sketch, treat them apart from the rest.

Heavy keys are few by arithmetic (at most ``1 / share`` keys can each hold ``share`` of the rows), so that the table of
them may be broadcast whatever the input's size. Rows of heavy keys are joined by that broadcast and aggregated over a
salt; all other rows take the ordinary shuffle; the two results are united. No row is dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut

#: Counters of the frequent-items sketch; its error is below 3.5 / TRACKED of the rows.
TRACKED = 4096


def heavy_keys(df: DataFrame, key: str, share: float = 0.02, weight_array: str | None = None) -> DataFrame:
    """(key, n) of every key with at least ``share`` of the rows of ``df``.

    One pass fills a frequent-items sketch per task (merged map-side, so a few KB move however large a key is); the
    candidates' counts are upper bounds, never too low, so that no heavy key is missed. Null keys are never heavy.
    An empty input gives no rows. ``weight_array``: count the elements of this array instead of rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    if share <= 4 / TRACKED:
        raise ValueError(f"share must exceed {4 / TRACKED}, the error of the sketch")
    rows = df.where(F.col(key).isNotNull())
    rows = rows.select((F.hex(key) if dict(df.dtypes)[key] == "binary" else F.col(key).cast("string")).alias("k"), *([F.explode(weight_array)] if weight_array else []))
    found = rows.agg(F.expr(f"approx_top_k(k, {int(1 / share) + 1}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total"))
    item = F.unhex("t.item") if dict(df.dtypes)[key] == "binary" else F.col("t.item")
    return (
        found.select("total", F.explode("top").alias("t"))
        .where(F.col("t.count") >= F.col("total") * F.lit(share))
        .select(item.alias(key), F.col("t.count").cast("long").alias("n"))
    )


def pinned(heavy: DataFrame, share: float) -> DataFrame:
    """``heavy`` fetched once, so that the branches that use it don't each repeat the sketch: at most ``1 / share`` keys."""
    return heavy.sparkSession.createDataFrame(heavy.limit(int(1 / share) + 1).collect(), heavy.schema)


def split_by_weight(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key is in ``heavy`` and all others (null keys among them)."""
    keys = F.broadcast(heavy.select(F.col(key).cast(df.schema[key].dataType).alias("__heavy")))
    return df.join(keys, df[key] == F.col("__heavy"), "left_semi"), df.join(keys, df[key] == F.col("__heavy"), "left_anti")


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.02, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``, where a few keys hold most rows of ``left`` and ``right`` has one row per key.

    Heavy keys: the few rows of ``right`` with such a key (at most ``1 / share``) are broadcast, so that the rows of
    ``left`` stay where they are. Remaining keys: an ordinary shuffle join. ``how`` is inner or left. Null keys match
    nothing. Columns of ``right`` that ``left`` has too are renamed with the suffix ``_right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    clash = {c: f"{c}_right" for c in right.columns if c != key and c in left.columns}
    right = right.withColumnsRenamed(clash)
    heavy = pinned(heavy_keys(left, key, share), share)
    few, many = split_by_weight(left, key, heavy)
    few_right = split_by_weight(right, key, heavy)[0]
    joined = few.join(F.broadcast(few_right), key, how)
    return joined.unionByName(many.join(right, key, how))


def balanced_aggregate(
    df: DataFrame,
    key: str,
    partial: Callable[[], list[Column]],
    final: Callable[[], list[Column]],
    spread: Column,
    share: float = 0.02,
    salts: int = 64,
) -> DataFrame:
    """Aggregate per ``key`` in two steps for heavy keys and in one for the rest.

    ``partial`` yields the aggregates over rows, ``final`` those that combine them (both named alike). ``spread`` is a
    column whose hash picks the salt; rows with equal ``spread`` meet in one partial group, so that distinct counts
    over it add up. Null keys form a group of their own.
    """
    few, many = split_by_weight(df, key, pinned(heavy_keys(df, key, share), share))
    salted = few.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts))).groupBy(key, "__salt").agg(*partial())
    return salted.groupBy(key).agg(*final()).unionByName(many.groupBy(key).agg(*partial()))


def cluster_elements(batches: DataFrame) -> DataFrame:
    """One row per (batch, sub-cluster, theory id) of nested batch results: cluster_name, subcluster, theory_id.

    Null or empty ids, null sub-clusters, null arrays and null results give no element.
    """
    subs = batches.select("cluster_name", "batch_id", F.posexplode("batch_result.subclusters").alias("sub_pos", "sub"))
    return subs.select(
        "cluster_name", F.struct("batch_id", "sub_pos").alias("sub_key"), F.col("sub.subcluster_name").alias("subcluster"), F.explode("sub.theory_ids").alias("theory_id")
    ).where(F.coalesce(F.col("theory_id"), F.lit("")) != "")


def cluster_report(batches: DataFrame, share: float = 0.02) -> DataFrame:
    """Per cluster_name: sub-clusters that hold an id, ids and distinct ids, without a long task for the heavy ones.

    Rows with equal (cluster, id) are first collapsed into one with their number (the shuffle is by both columns, so a
    heavy cluster spreads over all tasks); then heavy clusters are counted over salts and the rest directly.
    """
    elements = cluster_elements(batches)
    # each collapsed form is made once and read by the sketch and by both branches
    ids = cut(elements.groupBy("cluster_name", "theory_id").agg(F.count(F.lit(1)).alias("n")))
    per_id = balanced_aggregate(
        ids,
        "cluster_name",
        lambda: [F.sum("n").alias("ids"), F.count(F.lit(1)).alias("distinct_ids")],
        lambda: [F.sum("ids").alias("ids"), F.sum("distinct_ids").alias("distinct_ids")],
        F.col("theory_id"),
        share,
    )
    subs = cut(elements.select("cluster_name", "sub_key").groupBy("cluster_name", "sub_key").agg(F.lit(1).alias("one")))
    per_sub = balanced_aggregate(
        subs,
        "cluster_name",
        lambda: [F.sum("one").alias("subclusters")],
        lambda: [F.sum("subclusters").alias("subclusters")],
        F.col("sub_key"),
        share,
    )
    right = per_sub.withColumnRenamed("cluster_name", "__name")
    return per_id.join(right, F.col("cluster_name").eqNullSafe(F.col("__name"))).select("cluster_name", "subclusters", "ids", "distinct_ids")


def dominant_clusters(batches: DataFrame, share: float = 0.05) -> DataFrame:
    """cluster_name of every cluster that owns more than ``share`` of all elements. Null names own none."""
    report = cut(cluster_report(batches, share / 2))
    total = report.agg(F.sum("ids").alias("total"))
    return (
        report.where(F.col("cluster_name").isNotNull())
        .join(F.broadcast(total), F.col("ids") > F.col("total") * F.lit(share))
        .select("cluster_name")
    )


def cluster_attributes(batches: DataFrame, entries: DataFrame, share: float = 0.02) -> DataFrame:
    """Per cluster: its ids, those known to ``entries`` and the distinct DOIs (lower case) behind them.

    The per-cluster dimension (number of ids) is joined back to the elements with ``skew_join``, as an example of
    enriching the rows of hot keys without moving them. Ids that ``entries`` lacks count as ids only; an id that
    ``entries`` has more than once (re-delivered) counts once.
    """
    elements = cluster_elements(batches).select("cluster_name", "theory_id").where(F.col("cluster_name").isNotNull())
    known = entries.where(F.col("theory_id").isNotNull()).groupBy("theory_id").agg(F.min(F.lower("doi")).alias("doi"))
    totals = balanced_aggregate(
        elements, "cluster_name", lambda: [F.count(F.lit(1)).alias("ids")], lambda: [F.sum("ids").alias("ids")], F.col("theory_id"), share
    )
    pairs = elements.groupBy("cluster_name", "theory_id").agg(F.count(F.lit(1)).alias("n")).join(known, "theory_id")
    docs = cut(pairs.groupBy("cluster_name", "doi").agg(F.count(F.lit(1)).alias("known_ids")))
    wide = skew_join(docs, totals, "cluster_name", share)
    return balanced_aggregate(
        wide,
        "cluster_name",
        lambda: [F.max("ids").alias("ids"), F.sum("known_ids").alias("known_ids"), F.count("doi").alias("docs")],
        lambda: [F.max("ids").alias("ids"), F.sum("known_ids").alias("known_ids"), F.sum("docs").alias("docs")],
        F.col("doi"),
        share,
    )
