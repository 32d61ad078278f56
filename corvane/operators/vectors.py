"""Vectors: cluster means, nearest means, most similar rows, agglomerative clustering of bounded sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.similarity import overlap_coefficient
from corvane.session import cut, ship

#: Largest group that is clustered in one task; larger ones are clustered in rounds over all tasks, with the same result.
WARD_MOST = 4000
#: Centres or queries that a task holds at once.
SLICE = 4000


def means(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, mean, size): component means; vectors that are null are left out."""
    parts = rows.where(F.col(vector).isNotNull()).select(cluster, F.posexplode(vector).alias("at", "x"))
    per = parts.groupBy(cluster, "at").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("size"))


def _matrix(array: pa.Array) -> np.ndarray:
    return np.vstack(array.to_numpy(zero_copy_only=False)).astype(np.float64) if len(array) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, np.nan)


def _slices(side: DataFrame, *columns: str) -> Iterator[list]:
    """The rows of ``side`` on the driver, SLICE at most at a time."""
    n = max(1, -(-side.count() // SLICE))
    for k in range(n):
        yield side.where(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == k).select(*columns).orderBy(columns[0]).collect()


def nearest_mean(rows: DataFrame, key: str, vector: str, centers: DataFrame, cluster: str) -> DataFrame:
    """(key, cluster, distance): the centre of least cosine distance; ties (to nine digits) go to the least cluster.

    Rows stay where they are: the centres go to the tasks, in slices, each compared with whole batches by one matrix
    product. Rows whose vector is null or zero have no nearest centre.
    """
    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{cluster}` {centers.schema[cluster].dataType.simpleString()}, distance double"
    kind = to_arrow_type(centers.schema[cluster].dataType)
    ship(rows.sparkSession)
    live = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    out = None
    for part in _slices(centers, cluster, "mean"):
        names, m = [r[0] for r in part], _unit(np.array([r[1] for r in part], dtype=np.float64)) if part else np.empty((0, 0))

        def nearest(batches: Iterator[pa.RecordBatch], names: list = names, m: np.ndarray = m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                d = np.round(1 - _unit(_matrix(batch.column(1))) @ m.T, 9)
                ok = np.flatnonzero(~np.isnan(d).all(axis=1))
                at = np.nanargmin(d[ok], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([names[k] for k in at], kind), pa.array(d[ok, at])], [key, cluster, "distance"])

        one = live.mapInArrow(nearest, kinds)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min(F.struct(F.col("distance").alias("d"), F.col(cluster).alias("c"))).alias("b")).select(key, F.col("b.c").alias(cluster), F.col("b.d").alias("distance"))


def absorb_small(rows: DataFrame, key: str, vector: str, cluster: str, least: int = 5) -> DataFrame:
    """(key, cluster): clusters smaller than ``least`` go, each as a whole, to the larger one whose mean is nearest their own.

    By cosine distance of the means. Where there is no larger cluster, or a mean is zero or null, clusters stay.
    """
    sized = means(rows, cluster, vector).join(rows.groupBy(F.col(cluster).alias("__c")).agg(F.count(F.lit(1)).alias("__n")), F.col(cluster) == F.col("__c"))
    sized = cut(sized.select(cluster, "mean", "__n"))
    small = sized.where(F.col("__n") < least).select(F.col(cluster).alias("__small"), "mean")
    moved = nearest_mean(small, "__small", "mean", sized.where(F.col("__n") >= least), cluster).select("__small", F.col(cluster).alias("__to"))
    return rows.join(moved, F.col(cluster) == F.col("__small"), "left").select(key, F.coalesce("__to", cluster).alias(cluster))


def most_similar(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows most alike each query, itself left out; ties go to the least key.

    A stated set of queries against all rows, in blocks: queries go to the tasks in slices, a batch of rows is one
    matrix product, and only the best ``k`` of each batch leave the task, so that what is shuffled is batches times
    queries, not rows times queries.
    """
    ship(rows.sparkSession)
    kind, arrow = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    live = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    asked = queries.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    out = None
    for part in _slices(asked, key, vector):
        names, m = np.array([r[0] for r in part]), _unit(np.array([r[1] for r in part], dtype=np.float64)) if part else np.empty((0, 0))

        def best(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, m: np.ndarray = m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(names) or not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                s = np.round(m @ _unit(_matrix(batch.column(1))).T, 6)
                s[(names[:, None] == keys[None, :]) | np.isnan(s)] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                q = np.repeat(np.arange(len(names)), order.shape[1])
                r = order.ravel()
                ok = np.isfinite(s[q, r])
                yield pa.RecordBatch.from_arrays([pa.array(names[q[ok]], arrow), pa.array(keys[r[ok]], arrow), pa.array(s[q[ok], r[ok]])], ["query", key, "similarity"])

        one = live.mapInArrow(best, f"query {kind}, `{key}` {kind}, similarity double")
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def ward(rows: DataFrame, key: str, vector: str, cutoff: float, group: str | None = None) -> DataFrame:
    """(key, cluster): Ward's clustering of each group, cut where merging would cost more than ``cutoff``.

    Exact: by nearest-neighbour chains in one task per group of up to WARD_MOST vectors, by rounds of reciprocal nearest neighbours
    (``_ward_rounds``) for larger ones. Clusters are numbered from 0 in the order of their least keys; null vectors are left out.
    """
    ship(rows.sparkSession)
    keyed = rows.where(F.col(vector).isNotNull()).select(F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    keyed = cut(keyed)
    sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > WARD_MOST).select("g"))
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        labels = ward_labels(np.vstack(pdf.v.to_numpy()), cutoff)
        return pd.DataFrame({"g": pdf.g, "key": pdf.key, "cluster": labels})

    small = keyed if large.isEmpty() else keyed.join(large, "g", "left_anti")
    out = small.groupBy("g").applyInPandas(run, f"g string, key {kind}, cluster int")
    if small is not keyed:
        out = out.unionByName(_ward_rounds(keyed.join(large, "g", "left_semi"), cutoff))
    return out.select(F.col("g").alias("group"), F.col("key").alias(key), "cluster") if group else out.select(F.col("key").alias(key), "cluster")


def _ward_rounds(keyed: DataFrame, cutoff: float) -> DataFrame:
    """(g, key, cluster): Ward's clustering of large groups. Each round every cluster finds its nearest one, and all pairs that are each other's
    nearest are merged; as Ward's costs never fall by a merger elsewhere, this gives the clusters that merging one pair at a time does.

    Centres stay distributed; slices of them go to the tasks, each compared with whole batches by one matrix product.
    """
    kind, arrow = keyed.schema["key"].dataType.simpleString(), to_arrow_type(keyed.schema["key"].dataType)
    state = cut(keyed.select("g", F.col("key").alias("id"), F.lit(1.0).alias("n"), F.col("v").alias("c")))
    members = cut(keyed.select("g", "key", F.col("key").alias("id")))
    while True:
        found = None
        for part in _slices(state, "id", "g", "n", "c"):
            ids, gs = np.array([r[0] for r in part]), np.array([r[1] for r in part])
            ns, cs = np.array([r[2] for r in part]), np.array([r[3] for r in part], dtype=np.float64)

            def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, gs: np.ndarray = gs, ns: np.ndarray = ns, cs: np.ndarray = cs) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows or not len(ids):
                        continue
                    mine, own = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
                    n, x = batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
                    gap = np.maximum((x**2).sum(axis=1)[:, None] + (cs**2).sum(axis=1)[None] - 2 * x @ cs.T, 0)
                    cost = np.round(np.sqrt(2 * n[:, None] * ns[None] / (n[:, None] + ns[None]) * gap), 9)
                    cost[(own[:, None] != gs[None]) | (mine[:, None] == ids[None])] = np.inf
                    order = np.argsort(ids, kind="stable")
                    at = order[cost[:, order].argmin(axis=1)]  # ties go to the least id
                    least = cost[np.arange(len(mine)), at]
                    ok = np.flatnonzero(np.isfinite(least))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(ids[at[ok]], arrow), pa.array(least[ok])], ["g", "id", "other", "cost"])

            one = state.select("g", "id", "n", "c").mapInArrow(nearest, f"g string, id {kind}, other {kind}, cost double")
            found = one if found is None else found.unionByName(one)
        best = cut(found.groupBy("g", "id").agg(F.min(F.struct("cost", "other")).alias("b")).select("g", "id", F.col("b.other").alias("other"), F.col("b.cost").alias("cost")))
        back = best.select("g", F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = cut(best.where(F.col("cost") <= cutoff).join(back, ["g", "id", "other"]).where("id < other").select("g", F.col("id").alias("keep"), F.col("other").alias("id")))
        if pairs.isEmpty():
            break
        moved = lambda df: df.join(pairs, ["g", "id"], "left").withColumn("id", F.coalesce("keep", "id")).drop("keep")
        mean = F.when(F.size("l") == 1, F.col("l")[0]["c"]).otherwise(F.zip_with(F.col("l")[0]["c"], F.col("l")[1]["c"], lambda a, b: (a * F.col("l")[0]["n"] + b * F.col("l")[1]["n"]) / F.col("n")))
        merged = moved(state).groupBy("g", "id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "c"))).alias("l"))  # two at most
        state, members = cut(merged.select("g", "id", "n", mean.alias("c"))), cut(moved(members).select("g", "key", "id"))
    named = state.select("g", "id", (F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1).alias("cluster"))
    return members.join(named, ["g", "id"]).select("g", "key", "cluster")


def ward_labels(x: np.ndarray, cutoff: float) -> np.ndarray:
    """Labels from 0 in order of first members: clusters whose union costs at most ``cutoff`` are merged."""
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n), np.ones(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    parent = np.arange(n)
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            cost = 2 * size * size[a] / (size + size[a]) * ((centre - centre[a]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        a = chain.pop()
        b = chain.pop()
        merges.append((float(np.sqrt(max(0.0, cost[b]))), a, b))
        keep, drop = min(a, b), max(a, b)
        total = size[a] + size[b]
        centre[keep] = (size[a] * centre[a] + size[b] * centre[b]) / total
        size[keep] = total
        alive[drop] = False

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for height, a, b in merges:
        if height <= cutoff:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    roots = [root(i) for i in range(n)]
    order = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots], dtype=np.int32)


def similar_subclusters(failed: DataFrame, subclusters: DataFrame, least: float = 0.05, few: int = 10) -> DataFrame:
    """(cluster_name, subcluster_name, similarity): previous sub-clusters that failed ids are clustered anew with.

    ``failed``: cluster_name, failed (number), concepts; ``subclusters``: cluster_name, subcluster_name, size, concepts.
    At least two must reach ``least``. With few failed ids three of the smaller ones (up to the 60 % point of sizes) are
    taken, else four of medium size; where these don't suffice, the most similar whatever their size.
    """
    scored = subclusters.join(failed.select("cluster_name", "failed", F.col("concepts").alias("__f")), "cluster_name").withColumn("similarity", F.round(overlap_coefficient(F.col("concepts"), F.col("__f")), 6))
    w = Window.partitionBy("cluster_name")
    rank = F.row_number().over(w.orderBy("size", "subcluster_name")) - 1
    scored = scored.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__ok", F.count_if(F.col("similarity") >= least).over(w)).withColumn("__r", rank)
    at = lambda share: F.max(F.when(F.col("__r") == F.floor(F.col("__n") * share), F.col("size"))).over(w)
    scored = scored.withColumn("__60", at(0.6)).withColumn("__25", at(0.25)).withColumn("__75", at(0.75)).where(F.col("__ok") >= 2)
    small = F.col("failed") <= few
    want = F.least(F.when(small, 3).otherwise(4), F.col("__n"))
    fits = F.when(small, F.col("size") <= F.col("__60")).otherwise(F.col("size").between(F.col("__25"), F.col("__75"))) & (F.col("similarity") > 0)
    scored = scored.withColumn("__fit", fits).withColumn("__enough", F.count_if(F.col("__fit")).over(w) >= want)
    pool = scored.where(F.when(F.col("__enough"), F.col("__fit")).otherwise(F.col("similarity") > 0))
    place = F.row_number().over(w.orderBy(F.desc("similarity"), "subcluster_name"))
    return pool.withColumn("__p", place).where(F.col("__p") <= want).select("cluster_name", "subcluster_name", "similarity")


def neighbours_by_tfidf(names: DataFrame, reach: int = 500, least: float = 0.15, features: int = 50) -> DataFrame:
    """(a, b, similarity): names within ``reach`` places in the alphabet whose TF-IDF cosine exceeds ``least``.

    1- and 2-grams, the ``features`` most frequent ones. A position join in blocks of ``reach`` places: each name meets
    its own block and the next.
    """
    from corvane.sources.readers import surrogate_ids

    named = surrogate_ids(names.where(F.col("name").isNotNull()).select("name").distinct(), "name", prefix="", width=12).select("name", F.col("surrogate_id").cast("bigint").alias("pos"))
    words = F.regexp_extract_all(F.lower("name"), F.lit(r"(\w\w+)"), F.lit(1))
    grams = named.select("pos", words.alias("w")).select("pos", F.explode(F.concat("w", F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).otherwise(F.array().cast("array<string>")))).alias("g"))
    tf = grams.groupBy("pos", "g").agg(F.count(F.lit(1)).alias("tf"))
    top = tf.groupBy("g").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "g").limit(features)
    n = named.agg(F.count(F.lit(1)).alias("n"))
    weighted = tf.join(F.broadcast(top), "g").join(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    unit = weighted.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("pos")))).select("pos", "g", "x")
    left = unit.select(F.col("pos").alias("pa"), "g", F.col("x").alias("xa"), F.explode(F.array(F.floor(F.col("pos") / reach), F.floor(F.col("pos") / reach) + 1)).alias("block"))
    right = unit.select(F.col("pos").alias("pb"), "g", F.col("x").alias("xb"), F.floor(F.col("pos") / reach).alias("block"))
    pairs = left.join(right, ["g", "block"]).where((F.col("pb") > F.col("pa")) & (F.col("pb") - F.col("pa") < reach))
    sims = pairs.groupBy("pa", "pb").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 6).alias("similarity")).where(F.col("similarity") > least)
    return sims.join(named.select(F.col("pos").alias("pa"), F.col("name").alias("a")), "pa").join(named.select(F.col("pos").alias("pb"), F.col("name").alias("b")), "pb").select("a", "b", "similarity")
