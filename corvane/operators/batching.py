"""Batches of work for external annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import ship


def initial(name: Column) -> Column:
    """The group of a name in alphabetical batching."""
    return F.upper(F.substring(name, 1, 1))


def plan_packing(groups: list[tuple[str, int]], most: int, top_up: bool = False) -> list[tuple[str, str, int, int]]:
    """(batch, group, from, to) slices of consecutive groups, batches of at most ``most``.

    Groups go whole into the open batch while they fit; a larger group is split. With ``top_up`` an open batch is
    filled up from the next group before it is closed. Only sizes are needed, one figure per initial letter.
    """
    out: list[tuple[str, str, int, int]] = []
    open_: list[tuple[str, int, int]] = []

    def used() -> int:
        return sum(b - a for _, a, b in open_)

    def close() -> None:
        if open_:
            label = "batch_" + "_".join(g for g, _, _ in open_)
            out.extend((label, g, a, b) for g, a, b in open_)
            open_.clear()

    for group, size in groups:
        start = 0
        if size > most:
            if top_up and open_ and used() < most:
                start = min(size, most - used())
                open_.append((group, 0, start))
            close()
            for n, a in enumerate(range(start, size, most), 1):
                out.append((f"batch_{group}_{n}", group, a, min(size, a + most)))
        elif used() + size <= most:
            open_.append((group, 0, size))
        else:
            if top_up and used() < most:
                start = most - used()
                open_.append((group, 0, start))
            close()
            open_.append((group, start, size))
    close()
    return [s for s in out if s[3] > s[2]]


def alphabetical(names: DataFrame, most: int = 100, top_up: bool = False) -> DataFrame:
    """(batch, name) of distinct names, packed by initial. Only the sizes of groups (one per letter) reach the driver."""
    keyed = names.where(F.coalesce(F.col("name"), F.lit("")) != "").select("name").distinct().withColumn("g", initial(F.col("name")))
    sizes = sorted((r.g, r.n) for r in keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect())
    plan = plan_packing(sizes, most, top_up)
    slices = names.sparkSession.createDataFrame(plan or [("", "", 0, 0)], "batch string, g string, lo int, hi int")
    ranked = keyed.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy("name")) - 1)
    return ranked.join(F.broadcast(slices), (ranked.g == slices.g) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("batch", "name")


def fixed(rows: DataFrame, size: int, group: list[str], *order: Column | str) -> DataFrame:
    """Adds batch (from 1) and place (from 1) within ``group`` in the given order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("__r", rank).withColumn("batch", F.floor(F.col("__r") / size).cast("int") + 1).withColumn("place", (F.col("__r") % size).cast("int") + 1).drop("__r")


def even(rows: DataFrame, most: int, group: str, *order: Column | str) -> DataFrame:
    """Adds batch (from 1): the fewest batches of at most ``most`` whose sizes differ by one at most, larger ones first."""
    w = Window.partitionBy(group)
    n, r = F.col("__n"), F.col("__r")
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1)
    parts = F.ceil(n / most)
    base, extra = F.floor(n / parts), n % parts
    batch = F.when(r < extra * (base + 1), F.floor(r / (base + 1))).otherwise(extra + F.floor((r - extra * (base + 1)) / F.greatest(base, F.lit(1))))
    return rows.withColumn("batch", batch.cast("int") + 1).drop("__n", "__r")


def exemplars(rows: DataFrame, name: str, key: str, most: int = 4, seed: str = "42") -> DataFrame:
    """At most ``most`` rows of each name, chosen by a seeded hash of the key (an operator that samples by design).

    Ranked within the ranges of the hash first, so that a name with most of the rows spreads over tasks.
    """
    rows = rows.withColumn("__h", F.md5(F.concat(F.lit(seed + "|"), F.col(key))))
    part = Window.partitionBy(name, F.substring("__h", 1, 2)).orderBy("__h", key)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy("__h", key))).where(F.col("rank") <= most).drop("__h")


def dynamic_size(canonical: int, size: int = 90, least: int = 30, beyond: int = 3000) -> int:
    """Smaller batches once the list of canonical names no longer leaves room for more."""
    return max(least, size // 2) if canonical > beyond else size


def similar_batches(names: DataFrame, size: int, most: int = 5000, reach: int = 500, least: float = 0.15) -> DataFrame:
    """(batch, name): names near in the alphabet and alike by TF-IDF share a batch.

    The method changes with the number of names, by rule: up to ``size`` names are one batch, more than ``most`` are cut in alphabetical order; in between the greedy
    assignment is sequential, on at most ``most`` names, in one Arrow group.
    """
    import pandas as pd

    ship(names.sparkSession)
    todo = names.where(F.coalesce(F.col("name"), F.lit("")) != "").select("name").distinct()
    n = todo.count()
    if n <= size:
        return todo.select(F.lit(1).alias("batch"), "name")
    if n > most:
        from corvane.sources.readers import surrogate_ids

        numbered = surrogate_ids(todo, "name", prefix="", width=12)
        return numbered.select((F.floor((F.col("surrogate_id").cast("bigint") - 1) / size) + 1).cast("int").alias("batch"), "name")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("name", ignore_index=True)
        words = pdf.name.str.lower().str.findall(r"\w\w+")
        grams = [w + [" ".join(p) for p in zip(w, w[1:], strict=False)] for w in words]
        counts: dict[str, int] = {}
        for g in grams:
            for t in g:
                counts[t] = counts.get(t, 0) + 1
        vocab = {t: k for k, (t, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50])}
        x = np.zeros((len(grams), len(vocab)))
        for i, g in enumerate(grams):
            for t in g:
                if t in vocab:
                    x[i, vocab[t]] += 1
        x *= np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        batch = np.zeros(len(x), dtype=int)
        made = 0
        for i in range(len(x)):
            if batch[i]:
                continue
            made += 1
            near = np.arange(i + 1, min(len(x), i + reach))
            near = near[(batch[near] == 0) & (x[near] @ x[i] > least)][: size - 1]
            batch[i] = batch[near] = made
        return pd.DataFrame({"batch": batch, "name": pdf.name})

    return todo.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(greedy, "batch int, name string")
