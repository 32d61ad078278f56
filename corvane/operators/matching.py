"""Name matching against an alias list, cheapest first: abbreviation, exact key, then fuzzy on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import names, similarity
from corvane.session import ship

#: Aliases that a task holds at once.
LIST_MOST = 20_000


def searchable(ontology: DataFrame) -> DataFrame:
    """(pos, canonical, alias): every name and alias of the list, in its order. pos orders collisions and ties."""
    arrays = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = ontology.select("ontology_id", F.col("name").alias("canonical"), F.posexplode(arrays).alias("p", "alias"))
    return rows.where(F.col("alias").isNotNull()).select(F.struct("ontology_id", "p").alias("pos"), "canonical", "alias")


def exact_aliases(ontology: DataFrame) -> DataFrame:
    """(key, canonical): the fuzzy key of each alias; of colliding keys the last entry wins."""
    keyed = searchable(ontology).withColumn("key", names.fuzzy_key(F.col("alias")))
    return keyed.groupBy("key").agg(F.max_by("canonical", "pos").alias("canonical"))


def abbreviation_list(ontology: DataFrame) -> DataFrame:
    """(abbr, canonical): upper-case abbreviations; of colliding ones the last entry wins."""
    rows = ontology.select("ontology_id", F.col("name").alias("canonical"), F.explode("abbreviations").alias("abbr"))
    return rows.groupBy(F.upper(F.trim("abbr")).alias("abbr")).agg(F.max_by("canonical", "ontology_id").alias("canonical"))


def match_abbreviation(names_: DataFrame, ontology: DataFrame) -> DataFrame:
    """(name, canonical, abbr) by the first abbreviation of the name that the list has."""
    found = names_.select("name", F.posexplode(names.abbreviations(F.col("name"))).alias("at", "abbr")).join(abbreviation_list(ontology), "abbr")
    first = found.groupBy("name").agg(F.min(F.struct("at", "canonical", "abbr")).alias("f"))
    return first.select("name", "f.canonical", "f.abbr")


def match_exact(names_: DataFrame, ontology: DataFrame) -> DataFrame:
    """(name, canonical) by equal fuzzy keys."""
    return names_.select("name", names.fuzzy_key(F.col("name")).alias("key")).join(exact_aliases(ontology), "key").select("name", "canonical")


def best_fuzzy(names_: DataFrame, ontology: DataFrame) -> DataFrame:
    """(name, canonical, alias, score): the alias with the best of two similarities, token order first.

    The canonical name is that of the alias' fuzzy key in ``exact_aliases``: where keys collide, the last entry's.

    Each distinct name is scored once, against the whole list. The list goes to the tasks in slices of about LIST_MOST
    aliases, each with a pass of its own, so that no task holds more of it, however long it is; the slices' winners are
    then compared. Ties go to the earlier alias.
    """
    todo = names_.where(F.col("name").isNotNull()).select("name").distinct()
    spark = todo.sparkSession
    ship(spark)
    aliases = searchable(ontology).select("pos", "alias")
    slices = max(1, -(-aliases.count() // LIST_MOST))
    todo = todo.repartition(spark.sparkContext.defaultParallelism, "name")
    each = "STRUCT<score: DOUBLE, p1: BIGINT, p2: BIGINT, alias: STRING>"
    found = None
    for k in range(slices):
        part = aliases.where(F.pmod(F.xxhash64("alias"), F.lit(slices)) == k).orderBy("pos").collect()
        one = todo.mapInPandas(_searcher([(r.pos.ontology_id, r.pos.p, r.alias) for r in part]), f"name string, t {each}, r {each}")
        found = one if found is None else found.unionByName(one)
    if slices > 1:
        found = found.groupBy("name").agg(F.max("t").alias("t"), F.max("r").alias("r"))
    by_ratio = F.col("r.score") > F.col("t.score")
    pick = lambda c: F.when(by_ratio, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}"))
    best = found.where(F.col("t").isNotNull()).select("name", pick("alias").alias("alias"), pick("score").alias("score"))
    return best.join(exact_aliases(ontology), names.fuzzy_key(F.col("alias")) == F.col("key"), "left").select("name", "canonical", "alias", "score")


def _searcher(part: list[tuple[int, int, str]]):
    """Names to their best aliases of one slice: by token-sorted (t) and plain (r) ratio, positions negated for ties."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = _Nearest([a for _, _, a in part])
        row = lambda k, s: (s, -part[k][0], -part[k][1], part[k][2])
        for pdf in batches:
            both = [nearest(n) for n in pdf.name] if part else []
            keys = ["score", "p1", "p2", "alias"]
            yield pd.DataFrame({"name": pdf.name, "t": [dict(zip(keys, row(*t), strict=True)) for t, _ in both] or None, "r": [dict(zip(keys, row(*r), strict=True)) for _, r in both] or None})

    return search


class _Nearest:
    """The best alias for a name by token-sorted and plain ratio, exact: one word of bits per alias, all aliases at once."""

    def __init__(self, aliases: list[str]):
        self.forms = [_Bits(aliases), _Bits([_sorted(a) for a in aliases])]

    def __call__(self, name: str) -> tuple[tuple[int, float], tuple[int, float]]:
        return self.forms[1].best(_sorted(name)), self.forms[0].best(name)


class _Bits:
    """Longest common subsequences of one text with many, by bit-parallel rows; aliases beyond 64 letters one by one."""

    def __init__(self, texts: list[str]):
        self.texts, self.length = texts, np.array([len(t) for t in texts], dtype=np.int64)
        self.long = np.flatnonzero(self.length > 64)
        self.masks: dict[str, np.ndarray] = {}
        for i, t in enumerate(texts):
            if len(t) <= 64:
                for k, c in enumerate(t):
                    self.masks.setdefault(c, np.zeros(len(texts), dtype=np.uint64))[i] |= np.uint64(1 << k)
        width = np.minimum(self.length, 64).astype(np.uint64)
        self.full = np.where(width == 64, ~np.uint64(0), (np.uint64(1) << (width % np.uint64(64))) - np.uint64(1))

    def best(self, text: str) -> tuple[int, float]:
        state = np.full(len(self.texts), ~np.uint64(0))
        for c in text:
            mask = self.masks.get(c)
            if mask is not None:
                hit = state & mask
                state = (state + hit) | (state - hit)
        common = np.bitwise_count(~state & self.full).astype(np.int64)
        for k in self.long:
            common[k] = similarity.common_subsequence(text, self.texts[k])
        total = self.length + len(text)
        score = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
        at = int(score.argmax())
        return at, float(score[at])


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def compound_agreement(name: str, alias: str, least: float = 0.8) -> tuple:
    """(agrees, overlap) columns: whether two names share enough core words and are of similar size."""
    x, y = names.core_tokens(F.col(name)), names.core_tokens(F.col(alias))
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    overlap = F.size(F.array_intersect(x, y)) / small
    single = similarity.ratio(F.coalesce(F.get(x, 0), F.lit("")), F.coalesce(F.get(y, 0), F.lit("")))
    agrees = F.when(small == 0, False).when(large == 1, single >= 93).otherwise((overlap >= least) & (small / large >= 0.6))
    return agrees, F.when(small == 0, 0.0).when(large == 1, single / 100).otherwise(overlap)


def match_names(names_: DataFrame, ontology: DataFrame, threshold: float = 90.0, overlap: float = 0.8) -> DataFrame:
    """(name, matched, canonical, alias, score, match_type, reasoning): the whole ladder over distinct names.

    Each rung sees only what the rungs above left. A fuzzy score counts from ``threshold`` (nine tenths of it for names
    with an abbreviation); below 97 the core words must agree too. A name that matches nothing keeps its nearest alias;
    with an empty list it has none. Null names are left out.
    """
    todo = names_.where(F.col("name").isNotNull()).select("name").distinct()
    sure = lambda kind, why: (F.lit(True).alias("matched"), "canonical", F.col("name").alias("alias"), F.lit(100.0).alias("score"), F.lit(kind).alias("match_type"), why.alias("reasoning"))
    by_abbr = match_abbreviation(todo, ontology).select("name", *sure("abbreviation", F.concat(F.lit("Matched via abbreviation: "), "abbr")))
    left = todo.join(by_abbr.select("name"), "name", "left_anti")
    exact = match_exact(left, ontology).select("name", *sure("exact", F.lit("Exact match found in ontology")))
    left = left.join(exact.select("name"), "name", "left_anti")
    agrees, shared = compound_agreement("name", "alias", overlap)
    short = F.size(names.abbreviations(F.col("name"))) > 0
    bar = F.when(short, threshold * 0.9).otherwise(threshold)
    near = left.join(best_fuzzy(left, ontology), "name", "left").withColumn("agrees", agrees).withColumn("shared", shared)
    hit = F.coalesce((F.col("score") >= bar) & ((F.col("score") >= 97) | F.col("agrees")), F.lit(False))
    says = lambda form, *c: F.format_string(form, *c)
    lowered = F.when(short, says(" (lowered to %.1f due to abbreviation)", bar)).otherwise("")
    why = (  # fixed values: the wording of the reasons
        F.when(F.col("score").isNull(), "No similar theory found in ontology")
        .when(F.col("score") < bar, F.concat(says("Best match score (%.1f) below threshold (%.1f)", "score", bar), lowered))
        .when(F.col("score") >= 97, says("Very high fuzzy score (%.1f) indicates strong match despite minor variations", "score"))
        .when(F.col("agrees"), says("High confidence fuzzy match (score: %.1f)", "score"))
        .otherwise(says("High fuzzy score (%.1f) but failed compound name validation (overlap: %.2f). Likely a variant theory.", "score", "shared"))
    )
    fuzzy = near.select("name", hit.alias("matched"), "canonical", "alias", "score", F.when(hit, "high_confidence").otherwise("no_match").alias("match_type"), why.alias("reasoning"))
    return by_abbr.unionByName(exact).unionByName(fuzzy)


def not_listed(names_: DataFrame, ontology: DataFrame, fold_case: bool = False) -> DataFrame:
    """Distinct names that are no canonical name of the list; with ``fold_case`` letter case is disregarded."""
    key = F.lower if fold_case else (lambda c: c)
    listed = ontology.select(key(F.col("name")).alias("__key")).distinct()
    todo = names_.select("name").where(F.coalesce(F.col("name"), F.lit("")) != "").distinct()
    return todo.join(listed, key(F.col("name")) == F.col("__key"), "left_anti")
