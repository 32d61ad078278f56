"""External annotators as relations: requests go out, responses come back, and are checked before they count.

An annotator maps an iterator of pandas batches of requests to batches of responses (``mapInPandas``), so that a remote
model, a rule or a table of recorded replies can stand in. Retries are an anti-join of requests against good responses;
what stays open after the last attempt takes the operator's fallback.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, ship

Annotator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def annotate(requests: DataFrame, annotator: Annotator, schema: str, key: list[str], valid: Column, attempts: int = 3, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(good responses, requests still open). Each attempt asks only for what has no valid response yet.

    Between attempts the driver waits ``pause`` seconds, doubled each time, ten at most: a back-off for remote models.

    Responses with unknown keys are dropped; of several valid ones for a key the first in order of all columns stays.
    """
    ship(requests.sparkSession)
    good, todo = None, cut(requests)
    for attempt in range(attempts):
        if attempt and pause:
            time.sleep(min(pause * 2**attempt, 10))
        raw = cut(todo.mapInPandas(annotator, schema))
        known = raw.where(valid).join(todo.select(*key).distinct(), key, "left_semi")
        first = F.row_number().over(Window.partitionBy(*key).orderBy(*[c for c in raw.columns if c not in key] or key))
        known = known.withColumn("__n", first).where("__n = 1").drop("__n")
        good = known if good is None else good.unionByName(known)
        todo = cut(todo.join(known.select(*key), key, "left_anti"))
        if todo.isEmpty():
            break
    return good, todo


def parsed(raw: Column, schema: str) -> Column:
    """A reply's JSON, fences removed; null where it can't be parsed."""
    from corvane.functions.text import unfenced

    return F.from_json(unfenced(raw), schema)


def with_fallback(names: DataFrame, mapping: DataFrame, key: str = "name", value: str = "mapped") -> DataFrame:
    """Every name with its mapping, or itself where there is none: missing names keep, extra ones are ignored (``annotators.group_names`` keeps them)."""
    return names.join(mapping.select(key, value).dropDuplicates([key]), key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col(key)))


def check_mapping(requests: DataFrame, responses: DataFrame, key: str = "name") -> DataFrame:
    """(batch, requested, answered, missing, extra) for each batch of names."""
    both = requests.select("batch", key, F.lit(1).alias("r")).join(responses.select("batch", key, F.lit(1).alias("a")).distinct(), ["batch", key], "full")
    return both.groupBy("batch").agg(
        F.count("r").alias("requested"),
        F.count("a").alias("answered"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("r").isNull()).alias("extra"),
    )


def check_split(requested: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_name, verdict, missing, extra, duplicates, small): whether a split of each cluster's ids holds.

    Verdicts, the first that applies: empty (no sub-cluster), extra (ids that weren't asked for), duplicate (an id in two
    places), all_small (every sub-cluster below ``least``), singletons (ids missing or in small ones), valid.
    """
    subs = assigned.groupBy("cluster_name", "subcluster_name").agg(F.count("theory_id").alias("n"))
    sizes = subs.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("subs"), F.count_if(F.col("n") < least).alias("small"))
    ids = assigned.where(F.col("theory_id").isNotNull()).groupBy("cluster_name", "theory_id").agg(F.count(F.lit(1)).alias("k"))
    both = requested.select("cluster_name", "theory_id", F.lit(1).alias("r")).distinct().join(ids, ["cluster_name", "theory_id"], "full")
    per = both.groupBy("cluster_name").agg(
        F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("extra"), F.count_if(F.col("k") > 1).alias("duplicates")
    )
    out = per.join(sizes, "cluster_name", "left").fillna(0, ["subs", "small"])
    verdict = (
        F.when(F.col("subs") == 0, "empty")
        .when(F.col("extra") > 0, "extra")
        .when(F.col("duplicates") > 0, "duplicate")
        .when(F.col("small") == F.col("subs"), "all_small")
        .when((F.col("small") > 0) | (F.col("missing") > 0), "singletons")
        .otherwise("valid")
    )
    return out.select("cluster_name", verdict.alias("verdict"), "missing", "extra", "duplicates", "small")


def with_singletons(requested: DataFrame, assigned: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_name, subcluster_name, theory_id, status): ids missing or in small sub-clusters go to one under the cluster's own name."""
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster_name", "subcluster_name"))
    kept = assigned.where(F.col("theory_id").isNotNull()).withColumn("n", size).where(F.col("n") >= least).select("cluster_name", "subcluster_name", "theory_id", F.lit("ok").alias("status"))
    rest = requested.select("cluster_name", "theory_id").distinct().join(kept.select("cluster_name", "theory_id"), ["cluster_name", "theory_id"], "left_anti")
    return kept.unionByName(rest.select("cluster_name", F.col("cluster_name").alias("subcluster_name"), "theory_id", F.lit("singleton_warning").alias("status")))


def whole(annotator: Annotator) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The annotator as a function of one whole batch of requests."""
    return lambda pdf: pd.concat(list(annotator(iter([pdf]))), ignore_index=True)


#: What an annotator that splits clusters gives back.
SPLIT = "cluster_name string, batch int, theory_id string, subcluster_name string"


def split_batches(batches: DataFrame, annotator: Annotator, least: int = 2, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(assigned, failed): batches split into sub-clusters, each batch asked as a whole.

    ``batches``: cluster_name, batch, theory_id, of bounded size. Of an id that comes twice the first sub-cluster in the
    alphabet counts. A batch whose reply is empty, holds ids that weren't asked for, or has small sub-clusters only is
    asked again as a whole. Ids that are missing or in small sub-clusters of an accepted reply, and all ids of a batch that
    never got one, are failed. Both have cluster_name, batch and theory_id, ``assigned`` also subcluster_name.
    """
    ship(batches.sparkSession)
    key = ["cluster_name", "batch"]
    todo, good = cut(batches.select(*key, "theory_id").distinct()), None
    asked = todo
    for _ in range(attempts):
        # a stated number of partitions: few bytes, but work enough for all lanes
        spread = todo.repartition(todo.sparkSession.sparkContext.defaultParallelism, *key)
        reply = cut(spread.groupBy(*key).applyInPandas(whole(annotator), SPLIT).where("theory_id IS NOT NULL"))
        once = reply.groupBy(*key, "theory_id").agg(F.min("subcluster_name").alias("subcluster_name"))
        once = once.join(todo.withColumn("asked", F.lit(True)), [*key, "theory_id"], "left")
        sized = once.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key, "subcluster_name")))
        judged = sized.groupBy(*key).agg(F.count_if(F.col("asked").isNull()).alias("extra"), F.max("n").alias("largest"))
        fine = judged.where((F.col("extra") == 0) & (F.col("largest") >= least)).select(*key)
        kept = cut(sized.join(fine, key, "left_semi").where(F.col("n") >= least).select(*key, "subcluster_name", "theory_id"))
        good = kept if good is None else good.unionByName(kept)
        todo = cut(todo.join(kept.select(*key).distinct(), key, "left_anti"))
        if todo.isEmpty():
            break
    return good, asked.join(good.select(*key, "theory_id"), [*key, "theory_id"], "left_anti")


def recluster(requested: DataFrame, annotator: Annotator, concepts: DataFrame | None = None, size: int = 26, least: int = 2, rounds: int = 3, attempts: int = 3) -> DataFrame:
    """(cluster_name, subcluster_name, theory_id, status): clusters split by an annotator; no id is lost or doubled.

    All batches of all clusters are asked at once (see ``split_batches``). Ids that failed are clustered anew together
    with the earlier sub-clusters whose concepts are most similar (``vectors.similar_subclusters``); where that gives
    sub-clusters, they take the place of those that went in. This is done ``rounds`` times at most; what then is left goes
    to a bucket under the cluster's own name, of status singleton_warning. ``concepts``: (theory_id, concept); without it
    nothing is similar, and failed ids are asked among themselves, batch by batch.
    """
    from corvane.operators.batching import even
    from corvane.operators.vectors import similar_subclusters

    ids = requested.select("cluster_name", "theory_id").distinct()
    done, failed = split_batches(even(ids, size, "cluster_name", "theory_id"), annotator, least, attempts)
    done = cut(done.select("cluster_name", "subcluster_name", "theory_id"))
    failed = cut(failed.select("cluster_name", "theory_id"))
    for number in range(1, rounds):
        if failed.isEmpty():
            break
        if concepts is None:
            again, chosen = even(failed, size, "cluster_name", "theory_id"), None
        else:
            told = concepts.select("theory_id", "concept").distinct()
            mine = failed.join(told, "theory_id", "left").groupBy("cluster_name").agg(F.count_distinct("theory_id").alias("failed"), F.collect_set("concept").alias("concepts"))
            subs = done.join(told, "theory_id", "left").groupBy("cluster_name", "subcluster_name").agg(F.count_distinct("theory_id").alias("size"), F.collect_set("concept").alias("concepts"))
            chosen = cut(similar_subclusters(mine, subs).select("cluster_name", "subcluster_name"))
            with_old = done.join(chosen, ["cluster_name", "subcluster_name"], "left_semi").select("cluster_name", "theory_id")
            again = failed.join(chosen.select("cluster_name").distinct(), "cluster_name", "left_semi").unionByName(with_old).withColumn("batch", F.lit(-number))
        new, left = split_batches(again, annotator, least, attempts)
        new = cut(new.withColumn("subcluster_name", F.concat("subcluster_name", F.lit(f" (round {number + 1})"))).select("cluster_name", "subcluster_name", "theory_id"))
        if chosen is not None:
            won = new.select("cluster_name").distinct()
            replaced = chosen.join(won, "cluster_name", "left_semi")
            back = left.select("cluster_name", "theory_id").join(won, "cluster_name", "left_semi")
            old = failed.join(won, "cluster_name", "left_anti")
            done, failed = cut(done.join(replaced, ["cluster_name", "subcluster_name"], "left_anti").unionByName(new)), cut(back.unionByName(old))
        else:
            done, failed = cut(done.unionByName(new)), cut(failed.join(new.select("cluster_name", "theory_id"), ["cluster_name", "theory_id"], "left_anti"))
    rest = failed.select("cluster_name", F.col("cluster_name").alias("subcluster_name"), "theory_id", F.lit("singleton_warning").alias("status"))
    return done.select("cluster_name", "subcluster_name", "theory_id", F.lit("ok").alias("status")).unionByName(rest)


def in_groups(requests: DataFrame, *order: str, size: int = 50, workers: int = 10) -> DataFrame:
    """Adds group (from 1, of ``size`` requests in the given order) and slot (1 to ``workers``): how requests are let out with bounded
    concurrency. A group is asked after the one before; its requests in ``workers`` lanes at once."""
    from corvane.sources.readers import surrogate_ids

    numbered = surrogate_ids(requests, *order, prefix="", width=18).withColumn("__n", F.col("surrogate_id").cast("bigint") - 1)
    return numbered.withColumn("group", (F.floor(F.col("__n") / size) + 1).cast("int")).withColumn("slot", (F.col("__n") % size % workers + 1).cast("int")).drop("surrogate_id", "__n")


def bounded(requests: DataFrame, annotator: Annotator, schema: str, workers: int = 10) -> DataFrame:
    """Replies with at most ``workers`` requests under way at a time: as many partitions as there may be lanes."""
    return requests.repartition(workers).mapInPandas(annotator, schema)


def rotated_key(keys: int, at: Column) -> Column:
    """Round-robin choice among several access keys by the request's running number."""
    return F.pmod(at, F.lit(keys)).cast("int")


def chunk_budget(question_number: Column) -> Column:
    """Chunks retrieved for a question: fixed values by its number."""
    return F.when(question_number == 1, 12).when(question_number.isin(2, 3), 10).when(question_number.isin(4, 5, 6), 8).otherwise(15)


#: What a keyword of each source is worth at least or exactly.
ENTITY, MECHANISM, PATTERN = 0.85, 0.95, 0.90


def merge_keywords(scored: DataFrame, entities: DataFrame, mechanisms: DataFrame, patterns: DataFrame, k: int = 10) -> DataFrame:
    """(key, keyword, score, rank): keywords of four sources in lower case, the best ``k`` of each key.

    ``scored``: (key, keyword, score from 0 to 1); the others: (key, keyword). An entity counts ENTITY unless its score is higher,
    a mechanism counts MECHANISM and a pattern's find PATTERN, whatever else they score; a find that is both counts as a pattern.
    """
    own = lambda df, n, score: df.select("key", F.lower("keyword").alias("keyword"), F.lit(n).alias("source"), score.cast("double").alias("score"))
    every = own(scored, 1, F.col("score")).unionByName(own(entities, 1, F.lit(ENTITY))).unionByName(own(mechanisms, 2, F.lit(MECHANISM))).unionByName(own(patterns, 3, F.lit(PATTERN)))
    best = every.where(F.coalesce("keyword", F.lit("")) != "").groupBy("key", "keyword").agg(F.max(F.struct("source", "score")).alias("b")).select("key", "keyword", F.col("b.score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "keyword"))).where(F.col("rank") <= k)


def keywords(texts: DataFrame, key: str, text: str, k: int = 10, longest: int = 3) -> DataFrame:
    """(key, keyword, score, rank): n-grams scored by frequency, length and early place; the best ``k``.

    Two scorers with weights 0.85 (frequency) and 0.90 (early place) are merged by the maximum, n-grams that both rank
    in their first ``k`` count 0.95 of it.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    rows = texts.select(F.col(key).alias("key"), words.alias("w"))

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))

    grams = None
    for n in range(1, longest + 1):
        one = rows.where(F.size("w") >= n).select("key", F.size("w").alias("total"), F.posexplode(runs(n)).alias("at", "keyword"), F.lit(n).alias("n"))
        grams = one if grams is None else grams.unionByName(one)
    stats = grams.groupBy("key", "keyword", "n").agg(F.count(F.lit(1)).alias("freq"), F.min("at").alias("first"), F.max("total").alias("total"))
    by_key = Window.partitionBy("key")
    stats = stats.withColumn("a", F.col("freq") * F.sqrt("n") / F.max(F.col("freq") * F.sqrt("n")).over(by_key)).withColumn("b", 1 - F.col("first") / F.col("total"))
    top_a, top_b = F.rank().over(by_key.orderBy(F.desc("a"), "keyword")) <= k, F.rank().over(by_key.orderBy(F.desc("b"), "keyword")) <= k
    stats = stats.withColumn("ta", top_a).withColumn("tb", top_b)
    score = F.greatest(0.85 * F.col("a"), 0.90 * F.col("b"))
    stats = stats.withColumn("score", F.round(F.when(F.col("ta") & F.col("tb"), F.greatest(score, 0.95 * F.greatest("a", "b"))).otherwise(score), 6))
    return stats.withColumn("rank", F.row_number().over(by_key.orderBy(F.desc("score"), "keyword"))).where(F.col("rank") <= k).select("key", "keyword", "score", "rank")
