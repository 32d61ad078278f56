"""Grouping mentions under final names: votes, first-per-key, summaries, document ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(rows: DataFrame, key: str, value: str, order: str, confidence: str | None = None) -> DataFrame:
    """(key, value, votes, voters, confidence): the most frequent value of each key; ties go to the first by ``order``.

    Two combining group-bys, so a key with most of the rows is no long task.
    """
    mean = [F.avg(confidence).alias("confidence")] if confidence else []
    votes = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first"), *mean)
    kept = [value, "votes", *(["confidence"] if confidence else [])]
    won = votes.groupBy(key).agg(F.sum("votes").alias("voters"), F.min_by(F.struct(*kept), F.struct((-F.col("votes")).alias("v"), "__first")).alias("w"))
    return won.select(key, *[f"w.{c}" for c in kept], "voters")


def overruled(rows: DataFrame, key: str, value: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, changes): ``value`` overwritten by its key's majority, with a note where it changed; and per key the number of changes.

    Rows without a value stay as they are.
    """
    won = majority(rows, key, value, order).select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    out = rows.join(won, F.col(key) == F.col("__k"), "left")
    changed = F.col(value).isNotNull() & (F.col(value) != F.col("__v"))
    out = out.withColumn("note", F.when(changed, F.concat(F.lit("was "), F.col(value)))).withColumn(value, F.when(F.col(value).isNotNull(), F.col("__v"))).drop("__k", "__v")
    return out, out.where(F.col("note").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("changes"))


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; ascending orders are a combining group-by, so a key with most of the rows is no long task."""
    if all(isinstance(o, str) for o in order):
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
        return first.select("__row.*")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def tops(rows: DataFrame, key: str, by: str) -> DataFrame:
    """All rows that hold their key's maximum of ``by``, ties included: one window over the key."""
    best = F.max(by).over(Window.partitionBy(key))
    return rows.withColumn("__best", best).where(F.col(by).eqNullSafe(F.col("__best"))).drop("__best")


def summary(mentions: DataFrame, name: str, *strategy: str) -> DataFrame:
    """Per final name, most mentions first (ties by name): sorted distinct original names, ids, their DOIs and initial names
    in the order of ids, the sorted distinct values of ``strategy`` columns, and counts.

    ``mentions``: name, original_name, theory_id, doi and ``strategy``. One aggregation makes all lists; lists are what the
    result holds, so a name's row is as long as its mentions.
    """
    listed = mentions.where(F.col("theory_id").isNotNull()).groupBy(name, "theory_id").agg(F.min("doi").alias("doi"), F.min("original_name").alias("original_name"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in strategy])
    rows = F.array_sort(F.collect_list(F.struct("theory_id", "doi", "original_name")))
    out = listed.groupBy(name).agg(
        F.sum("n").alias("total_papers"), F.count_distinct("doi").alias("distinct_docs"), F.array_sort(F.collect_set("original_name")).alias("original_names"), rows.alias("r"),
        *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in strategy],
    )
    out = out.select(
        name, "total_papers", "distinct_docs", "original_names", F.col("r.theory_id").alias("theory_ids"), F.col("r.doi").alias("dois"), F.col("r.original_name").alias("initial_names"),
        *[f"{c}s" for c in strategy], F.size("original_names").alias("original_names_count"),
    )
    return out.orderBy(F.desc("total_papers"), name)


def merged_summary(summaries: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """Summaries under mapped names: ids in their order, each once, and their number as the new total; most ids first.

    ``summaries``: name, theory_ids; ``mapping``: name, mapped (identity where there is none). Ids of larger groups come first.
    """
    rows = remapped(summaries.withColumn("__was", F.col(name)).withColumn("__n", F.size("theory_ids")), mapping, name)
    packed = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("k"), F.col("__was").alias("w"), "theory_ids"))).alias("l"))
    out = packed.select(name, F.array_distinct(F.flatten(F.transform("l", lambda x: x["theory_ids"]))).alias("theory_ids"), F.transform("l", lambda x: x["w"]).alias("names"))
    return out.withColumn("total_papers", F.size("theory_ids")).orderBy(F.desc("total_papers"), name)


def remapped(rows: DataFrame, mapping: DataFrame, key: str = "name", value: str = "mapped") -> DataFrame:
    """``key`` replaced by its mapping; names without one stay (identity default)."""
    pairs = mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v")).dropDuplicates(["__k"])
    return rows.join(pairs, rows[key] == F.col("__k"), "left").withColumn(key, F.coalesce("__v", key)).drop("__k", "__v")


def split_names(members: DataFrame, assignments: DataFrame, keep_unmapped: bool = True, strip_suffix: bool = True) -> DataFrame:
    """(theory_id, parent, name, separated): members of clusters under the names of their sub-clusters.

    Of several assignments of an id the last batch wins. Two variants: ``keep_unmapped`` keeps ids without an assignment under
    their parent, else they are dropped; ``strip_suffix`` removes '(Batch n)' from sub-cluster names.
    """
    from corvane.functions.names import strip_batch_suffix

    last = assignments.groupBy("theory_id").agg(F.max_by("subcluster_name", F.struct("batch_id", "sub_pos")).alias("sub"))
    out = members.join(last, "theory_id", "left" if keep_unmapped else "inner")
    sub = strip_batch_suffix(F.col("sub")) if strip_suffix else F.col("sub")
    return out.select("theory_id", F.col("name").alias("parent"), F.coalesce(sub, "name").alias("name"), F.col("sub").isNotNull().alias("separated"))


def low_focus_docs(rows: DataFrame, most: float = 6) -> DataFrame:
    """(doi) whose highest focus is at most ``most``; a missing focus counts as 0."""
    return rows.where(F.col("doi").isNotNull()).groupBy("doi").agg(F.max(F.coalesce(F.col("paper_focus"), F.lit(0))).alias("f")).where(F.col("f") <= most).select("doi")


def owners(pairs: DataFrame, name: str = "name", doc: str = "doi") -> DataFrame:
    """(doc, name): each document goes to the smallest group that has it; ties to the first name."""
    pairs = pairs.select(name, doc).distinct()
    sized = pairs.join(pairs.groupBy(name).agg(F.count(F.lit(1)).alias("size")), name)
    return sized.groupBy(doc).agg(F.min_by(name, F.struct("size", name)).alias(name))


def final_map(mentions: DataFrame, most: float = 6) -> DataFrame:
    """(name, doi): final names and the documents they own, low-focus documents left out."""
    named = mentions.where((F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("doi"), F.lit("")) != ""))
    return owners(named.join(low_focus_docs(named, most), "doi", "left_anti").select("name", "doi")).select("name", "doi")


def split_by_size(groups: DataFrame, size: str, stage: int = 5) -> DataFrame:
    """Adds role: reference, rare, or between (stage 7 only: neither large enough to refer to nor a singleton)."""
    if stage == 5:
        return groups.withColumn("role", F.when(F.col(size) >= 6, "reference").otherwise("rare"))
    return groups.withColumn("role", F.when(F.col(size) >= 3, "reference").when(F.col(size) <= 1, "rare").otherwise("between"))


def replace_clusters(old: DataFrame, new: DataFrame, key: str = "cluster_name") -> DataFrame:
    """A selective rerun: clusters in ``new`` replace the old ones, all others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
