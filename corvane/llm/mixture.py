"""Problem 2: records that tell of the same thing in other words, grouped by Gaussian mixtures.

1. *Words.* Each key concept becomes a set of content words. Which words say the same is learned from all rows: where two
   records share one concept word for word, and a second one but for one word, the two words that fill the gap are
   counted; words that mostly replace each other become one.
2. *Classes.* Records with the same set of concepts form one class; all further work is on distinct classes.
3. *Features.* A class is the sum of random sign vectors of its concepts and, with a smaller weight, of the words of its
   name (a random projection of both indicators to DIMS dimensions), standardised over all classes.
4. *Mixtures.* Concepts are drawn into shards by hash, about SHARD classes each; a class is in the shard of each of its
   concepts, so that similar classes meet in several shards, among many strangers. In each shard Gaussian mixtures with a
   shared, regularised variance are fitted by expectation-maximisation for several numbers of components; Akaike's
   information criterion chooses (BIC asks more evidence for a component than its two or three members can give). Shards
   are of like size, so many are fitted at once as padded arrays. A concept of more than CAP classes is no unit: it is
   divided by a second shared concept, then by a third. What is still larger is fitted in random parts, for the
   densities: three shared concepts are the criterion itself, so these classes are linked whatever the fits say.
5. *Links.* Only classes that share a component (by a responsibility of at least SOFT) are compared exactly: LEAST shared
   concepts make a link. Clusters are what links connect; the members of highest density represent them. The density of a
   class is that of the mixture of all shards, each weighted by its number of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.copies import bare, theory_copies
from corvane.operators.skew import skew_join
from corvane.session import cut, ship, written

LEAST = 3  # concepts that must say the same
DIMS, REGULAR, SOFT, ROUNDS = 24, 0.4, 0.0001, 8
COMPONENTS = (0.0, 0.25, 0.35, 0.45)  # numbers of components tried, as shares of the classes of a shard (at least one component)
NAME_WEIGHT = 0.2  # of the name beside the concepts
SHARD, CAP = 128, 192  # classes in a shard on the average; classes of a concept that is not divided
SUPPORT, MUTUAL = 5, 0.5  # times that two words must replace each other, and least share of all their replacements
FILLERS = 6  # words that may fill a gap before its context is narrowed; wider ones are judged last
#: Function words; they don't tell concepts apart.
STOP = ["of", "in", "the", "a", "an", "and", "to", "by", "for", "with", "on", "at", "from", "is", "are", "de", "la", "le", "der", "die"]


def concept_texts(raw: Column) -> Column:
    """The concept texts of a JSON list of objects; of text that can't be parsed, those that can still be read."""
    parsed = F.from_json(raw, "array<struct<concept:string>>")
    escaped = F.regexp_extract_all(raw, F.lit(r'"concept"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.coalesce(F.transform(parsed, lambda c: c["concept"]), escaped)


def concept_words(text: Column) -> Column:
    """The sorted set of content words of a concept."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP))))


def concepts(records: DataFrame, key: str = "id", column: str = "key_concepts", name: str = "name") -> DataFrame:
    """(key, name, words): one row per record and distinct concept. Missing or empty concepts give no row."""
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name"), F.explode(concept_texts(F.col(column))).alias("text"))
    return rows.where(F.col("text").isNotNull()).select("key", "name", concept_words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()


def pairs_filling(contexts: DataFrame) -> DataFrame:
    """(a, b, n): words that fill the same gap, and for how many rests; at least SUPPORT. ``contexts``: context, rest, word, each of few words."""
    filled = contexts.groupBy("context", "rest").agg(F.collect_list("word").alias("ws"))
    pairs = filled.select("rest", F.explode("ws").alias("a"), "ws").select("rest", "a", F.explode("ws").alias("b")).where("a <> b")
    return cut(pairs.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT))


def pairs_filling_any(contexts: DataFrame) -> DataFrame:
    """``pairs_filling`` for contexts of any number of words, whose pairs are never written out one by one.

    A word that completes fewer than SUPPORT rests makes no pair that counts. Of each rest the different sets of words
    are kept; the pairs are made from them and summed in place.
    """
    often = contexts.select("rest", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).select("word")
    filled = contexts.join(often, "word").groupBy("context", "rest").agg(F.array_sort(F.collect_list("word")).alias("ws")).where(F.size("ws") > 1)
    sets = filled.groupBy("rest").agg(F.collect_set("ws").alias("sets"))
    each = sets.select("sets", F.explode(F.array_distinct(F.flatten("sets"))).alias("a"))
    pairs = each.select("a", F.explode(F.array_distinct(F.flatten(F.filter("sets", lambda ws: F.array_contains(ws, F.col("a")))))).alias("b")).where("a <> b")
    return cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT))


def mutual(counted: DataFrame) -> DataFrame:
    """(a, b), both ways round: pairs that make up MUTUAL of the replacements of either word."""
    total = F.sum("n").over(Window.partitionBy("a"))
    strong = counted.withColumn("share", F.col("n") / total).where(F.col("share") >= MUTUAL).select("a", "b")
    return strong.intersect(strong.select(F.col("b").alias("a"), F.col("a").alias("b")))


def thesaurus(rows: DataFrame) -> DataFrame:
    """(word, rep): words that are replaced by others, learned from ``concepts`` rows.

    Records with the same concepts count once. A context is a concept that stands beside the one with the gap; one whose gap
    more than FILLERS words fill hardly tells a pair apart and is narrowed by a second such concept. A pair counts once for each
    different rest of a concept that it completes (so that one chance resemblance
    of two concepts is not many); it is kept if it counts SUPPORT times and makes up MUTUAL of the replacements of either
    word. Contexts that FILLERS words fill at most decide first; words that they give no partner are judged with
    all contexts of two concepts, however many words fill them, and what is left with all contexts of one concept, so no
    evidence is lost. The representative is the pair's first word.
    """
    exact = rows.select("key", "words", F.xxhash64(F.array_join("words", " ")).alias("c")).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("c", "words"))).alias("cs"))
    exact = exact.where(F.size("cs") > 1).groupBy(F.xxhash64("cs.c").alias("s")).agg(F.first("cs").alias("cs"))
    left_out = lambda ws: F.transform(ws, lambda w: F.struct(F.xxhash64(w).alias("word"), F.xxhash64(F.array_join(F.array_remove(ws, w), " ")).alias("rest")))
    gaps = exact.select("cs", F.explode("cs").alias("it")).select(F.array_remove("cs.c", F.col("it.c")).alias("beside"), F.inline(left_out(F.col("it.words"))))
    # most gaps are filled by one word only: they are dropped before contexts are written out
    told = lambda df, by: df.groupBy(by).agg(F.min("word").alias("lo"), F.max("word").alias("hi")).where("lo < hi").select(by)
    gaps = written(gaps.join(told(gaps, "rest"), "rest"))
    near = gaps.select("beside", F.explode("beside").alias("near"), "rest", "word").withColumn("context", F.xxhash64("near", "rest"))
    one = near.select("context", "rest", "word")
    one = written(one.join(told(one, "context"), "context").distinct())
    sized = cut(one.groupBy("context").agg(F.count(F.lit(1)).alias("n")))
    if sized.where(F.col("n") > FILLERS).isEmpty():
        both = mutual(pairs_filling(one))
    else:
        found = one.join(sized.where(F.col("n") <= FILLERS).select("context"), "context")
        wide = near.join(sized.where(F.col("n") > FILLERS).select("context"), "context")
        two = wide.select("near", F.explode("beside").alias("second"), "rest", "word").where("near <> second")
        two = written(two.select(F.xxhash64(F.least("near", "second"), F.greatest("near", "second"), "rest").alias("context"), "rest", "word").distinct())
        two = written(two.join(told(two, "context"), "context"))
        narrow = two.join(two.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FILLERS).select("context"), "context")
        both = cut(mutual(pairs_filling(found.unionByName(narrow))))
        for contexts in (found.unionByName(two), one):
            more = mutual(pairs_filling_any(contexts))
            for side in ("a", "b"):
                more = more.join(both.select(F.col("a").alias(side)), side, "left_anti")
            both = cut(both.unionByName(more.select("a", "b")))
    named = rows.select(F.explode("words").alias("text")).distinct().select("text", F.xxhash64("text").alias("h"))
    both = both.join(named.select(F.col("h").alias("a"), F.col("text").alias("word")), "a").join(named.select(F.col("h").alias("b"), F.col("text").alias("rep")), "b")
    return both.where("rep < word").select("word", "rep")


@dataclass
class Classes:
    """classes: (sig, cids, nids, n) of the distinct concept sets with LEAST concepts; members: (key, sig); short: (key, cids)
    of the records with fewer."""

    classes: DataFrame
    members: DataFrame
    short: DataFrame


def classify(rows: DataFrame) -> Classes:
    """Concept sets after merging words by the thesaurus. nids are the words of the class' first name in the alphabet."""
    rows = written(rows)
    words = rows.select("key", "name", F.xxhash64(F.array_join("words", " ")).alias("c"), F.explode("words").alias("word"))
    merged = skew_join(words, cut(thesaurus(rows)), "word", how="left").select("key", "name", "c", F.coalesce("rep", "word").alias("word"))
    merged = merged.groupBy("key", "c").agg(F.first("name").alias("name"), F.xxhash64(F.array_join(F.array_sort(F.collect_set("word")), " ")).alias("cid"))
    sets = merged.groupBy("key").agg(F.first("name").alias("name"), F.array_sort(F.collect_set("cid")).alias("cids"))
    sets = written(sets.withColumn("sig", F.xxhash64("cids")))
    long = sets.where(F.size("cids") >= LEAST)
    nids = F.transform(concept_words(F.coalesce(F.min("name"), F.lit(""))), lambda w: F.xxhash64(w))
    classes = long.groupBy("sig").agg(F.first("cids").alias("cids"), nids.alias("nids"), F.count(F.lit(1)).alias("n"))
    return Classes(classes, long.select("key", "sig"), sets.where(F.size("cids") < LEAST).select("key", "cids"))


def shards(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, cids, nids): the classes of each shard, as arrays; and (block, sig): the blocks of three shared concepts with
    more than CAP classes, which are all alike.

    A block is what shares a concept, or two or three concepts where it would exceed CAP; whole blocks are drawn into
    shards by hash. Where even three leave more than CAP, the block is drawn in parts of about CAP / 2 classes.
    """
    post = classes.select("sig", "cids", F.explode("cids").alias("at")).select("sig", "cids", F.array("at").alias("keys"))
    drawn = sure = None
    for depth in range(1, LEAST + 1):
        post = cut(post.withColumn("block", F.xxhash64("keys")))
        sized = post.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        own = post.join(sized.where(F.col("size").between(2, CAP)).select("block"), "block").select("sig", "block")
        big = sized.where(F.col("size") > CAP)
        if depth == LEAST:
            held = post.join(big, "block").select("block", "sig", "size")
            part = F.pmod(F.xxhash64("block", "sig"), F.ceil(2 * F.col("size") / CAP))
            drawn = drawn.unionByName(own).unionByName(held.select("sig", F.xxhash64("block", part).alias("block")))
            sure = held.select("block", "sig")
            break
        drawn = own if drawn is None else drawn.unionByName(own)
        post = post.join(big.select("block"), "block").select("sig", "cids", "keys", F.explode("cids").alias("more"))
        post = post.where(~F.array_contains("keys", F.col("more"))).select("sig", "cids", F.array_sort(F.concat("keys", F.array("more"))).alias("keys")).distinct()
    drawn = cut(drawn)
    number = max(1, -(-drawn.count() // SHARD))
    drawn = drawn.select("sig", F.pmod(F.xxhash64("block"), F.lit(number)).alias("shard")).distinct()
    held = drawn.join(classes.select("sig", "cids", "nids"), "sig")
    return held.groupBy("shard").agg(F.collect_list(F.struct("sig", "cids", "nids")).alias("m")).select("m.sig", "m.cids", "m.nids"), sure


def signs(cids: np.ndarray) -> np.ndarray:
    """DIMS random signs for each concept id."""
    x = cids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (((x[:, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1).astype(np.float32)


def features(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Projected sets: ``flat`` holds the ids of all sets in a row, ``n`` their sizes; an empty set is at the origin."""
    ends = np.cumsum(n)
    total = np.vstack([np.zeros((1, DIMS)), np.cumsum(signs(flat), axis=0, dtype=np.float64)])
    return ((total[ends] - total[ends - n]) / np.sqrt(np.maximum(n, 1))[:, None]).astype(np.float32)


def placed(cids: pa.Array, nids: pa.Array) -> np.ndarray:
    """The features of classes, before they are standardised, from list columns of concept and name ids."""
    parts = [features(x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())) for x in (cids, nids)]
    return parts[0] + np.float32(NAME_WEIGHT) * parts[1]


def fit(x: np.ndarray, live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for B shards at once: (responsibilities [B, n, k], log densities [B, n], AIC [B]).

    x [B, n, DIMS], live [B, n]. Spherical components with one variance per shard, which REGULAR is added to. Starts
    from the points that lie farthest from each other.
    """
    b, n, d = x.shape
    size = live.sum(axis=1)
    mean = (x * live[:, :, None]).sum(axis=1) / size[:, None]
    near = np.where(live, ((x - mean[:, None]) ** 2).sum(axis=2), np.inf)
    seeds = [near.argmin(axis=1)]
    far = np.full((b, n), np.inf)
    rows = np.arange(b)
    for _ in range(k - 1):
        far = np.minimum(far, ((x - x[rows, seeds[-1]][:, None]) ** 2).sum(axis=2))
        seeds.append(np.where(live, far, -1).argmax(axis=1))
    mu = np.stack([x[rows, s] for s in seeds], axis=1)
    var = np.full(b, 0.5 + REGULAR, dtype=np.float32)
    log_pi = np.full((b, k), -np.log(k), dtype=np.float32)
    squares = (x**2).sum(axis=2)
    for step in range(ROUNDS):
        dist = squares[:, :, None] - 2 * (x @ mu.transpose(0, 2, 1)) + (mu**2).sum(axis=2)[:, None]
        log = log_pi[:, None] - dist / (2 * var[:, None, None]) - 0.5 * d * np.log(2 * np.pi * var)[:, None, None]
        top = log.max(axis=2)
        dens = top + np.log(np.exp(log - top[:, :, None]).sum(axis=2))
        resp = np.exp(log - dens[:, :, None]) * live[:, :, None]
        if step == ROUNDS - 1:
            break
        weight = resp.sum(axis=1)
        mu = (resp.transpose(0, 2, 1) @ x) / np.maximum(weight, 1e-9)[:, :, None]
        log_pi = np.log(np.maximum(weight, 1e-9) / size[:, None])
        dist = squares[:, :, None] - 2 * (x @ mu.transpose(0, 2, 1)) + (mu**2).sum(axis=2)[:, None]
        var = (resp * dist).sum(axis=(1, 2)) / (size * d) + REGULAR
    return resp, dens, -2 * (dens * live).sum(axis=1) + 2 * (k * d + k)


def choices(n: int) -> list[int]:
    """Numbers of components tried for shards of up to n points."""
    return sorted({max(1, int(n * share)) for share in COMPONENTS})


def mixed(x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(same [B, n, n], density [B, n]): which points share a component of the best mixture of their shard."""
    b, n, _ = x.shape
    best = np.full(b, np.inf)
    same, density = np.zeros((b, n, n), dtype=bool), np.zeros((b, n))
    for k in choices(n):
        resp, dens, criterion = fit(x, live, k)
        won = criterion < best
        best[won] = criterion[won]
        in_ = (resp[won] >= SOFT).astype(np.float32)
        same[won] = in_ @ in_.transpose(0, 2, 1) > 0
        density[won] = dens[won]
    return same, density


def linked(shards_: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, sig, density) per batch of shards (sigs, standardised features, concept sets): verified links a < b, and each
    class' log density in its shard, times the shard's number of classes."""
    by: dict[int, list[int]] = {}
    for i, (sigs, _, _) in enumerate(shards_):
        by.setdefault(-(-len(sigs) // 16) * 16, []).append(i)
    for n, which in by.items():
        step = max(1, 1_000_000 // (n * n))
        for at in range(0, len(which), step):
            part = [shards_[i] for i in which[at : at + step]]
            x, live = np.zeros((len(part), n, DIMS), dtype=np.float32), np.zeros((len(part), n), dtype=bool)
            ids = np.zeros((len(part), n), dtype=np.int64)
            for k, (sigs, feats, _) in enumerate(part):
                x[k, : len(sigs)], live[k, : len(sigs)], ids[k, : len(sigs)] = feats, True, sigs
            same, density = mixed(x, live)
            density += np.log(np.maximum(live.sum(axis=1), 1))[:, None]
            same &= live[:, :, None] & live[:, None, :] & (ids[:, :, None] < ids[:, None, :])
            for k, (sigs, _, sets) in enumerate(part):
                i, j = np.nonzero(same[k])
                if len(i):
                    m = max(map(len, sets))
                    padded = np.zeros((len(sets), m), dtype=np.int64)
                    inside = np.arange(m) < np.array([len(c) for c in sets])[:, None]
                    padded[inside] = np.concatenate(sets)
                    shared = (padded[i][:, :, None] == padded[j][:, None, :]) & inside[i][:, :, None] & inside[j][:, None, :]
                    ok = shared.sum(axis=(1, 2)) >= LEAST
                    i, j = i[ok], j[ok]
                yield sigs[i], sigs[j], sigs, density[k, : len(sigs)]


@dataclass
class Mixture:
    """links: (a, b) classes alike, a < b, found in a shard; sure: (block, sig), blocks whose classes are all alike;
    density: (sig, density); with the classes and their members."""

    links: DataFrame
    sure: DataFrame
    density: DataFrame
    classes: DataFrame
    members: DataFrame
    short: DataFrame

    def edges(self) -> DataFrame:
        """(a, b): enough links to connect what is alike; in a sure block, of its first class with all others."""
        first = self.sure.groupBy("block").agg(F.min("sig").alias("a"))
        star = self.sure.join(first, "block").where("a <> sig").select("a", F.col("sig").alias("b"))
        return self.links.unionByName(star)


def similar(records: DataFrame) -> Mixture:
    """Fit the mixtures over all records and link classes that share a component and LEAST concepts.

    Records with fewer than LEAST readable concepts belong to no class. An empty table gives empty results.
    """
    spark = records.sparkSession
    ship(spark)
    grouped = classify(concepts(records))
    classes = cut(grouped.classes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, DIMS)), 0
        for batch in batches:
            f = placed(batch.column(0), batch.column(1))
            sums += np.stack([f.sum(axis=0), (f.astype(np.float64) ** 2).sum(axis=0)])
            n += len(f)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["s", "n"])

    got = classes.select("cids", "nids").mapInArrow(moments, "s binary, n bigint").collect()  # one row of 400 bytes a task
    n = max(1, sum(r.n for r in got))
    total = sum((np.frombuffer(r.s).reshape(2, DIMS) for r in got), np.zeros((2, DIMS)))
    center = total[0] / n
    scale = np.sqrt(np.maximum(total[1] / n - center**2, 1e-6))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for row in range(batch.num_rows):
                sigs, cids, nids = (batch.column(c)[row].values for c in ("sig", "cids", "nids"))
                feats = ((placed(cids, nids) - center) / scale).astype(np.float32)
                ids, ends = cids.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(cids.offsets.to_numpy()))
                held.append((sigs.to_numpy(zero_copy_only=False), feats, np.split(ids, ends[:-1])))
            for a, b, s, density in linked(held):
                a, b = np.concatenate([a, s]), np.concatenate([b, s])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([np.zeros(len(a) - len(s)), density]))], ["a", "b", "density"])

    held, sure = shards(classes)
    raw = held.mapInArrow(fitted, "a bigint, b bigint, density double")
    found = cut(raw.groupBy("a", "b").agg(F.log(F.sum(F.exp(F.greatest("density", F.lit(-700.0))))).alias("density")))  # exp(-700) is still above 0
    density = found.where("a = b").select(F.col("a").alias("sig"), "density")
    return Mixture(found.where("a < b").select("a", "b"), sure, density, classes, grouped.members, grouped.short)


def pairs_found(theories: DataFrame) -> DataFrame:
    """(first_id, second_id): pairs of records that tell of the same thing, and copies in the sense of problem 1.

    The result's form asks for all pairs of rows; ``members`` and ``class_links`` say the same in as many rows as there are records and links
    of different texts.
    """
    m = similar(theories)
    right = m.members.select(F.col("key").alias("y"), F.col("sig").alias("b"))
    left = m.members.select(F.col("key").alias("x"), F.col("sig").alias("a"))
    alike = m.sure.select("block", F.col("sig").alias("a")).join(m.sure.select("block", F.col("sig").alias("b")), "block").where("a < b").select("a", "b")
    across = m.links.unionByName(alike).join(left, "a").join(right, "b").select("x", "y")
    inside = m.classes.where("n > 1").select("sig")
    within = m.members.join(inside, "sig").select(F.col("sig").alias("a"), F.col("key").alias("x")).join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    group = cut(theory_copies(theories).members)
    copies = group.select("first_key", F.col("key").alias("x")).join(group.select("first_key", F.col("key").alias("y")), "first_key").where("x < y").select("x", "y")
    every = across.unionByName(within).unionByName(copies)
    return every.select(F.least("x", "y").alias("first_id"), F.greatest("x", "y").alias("second_id")).distinct()


def labels(m: Mixture) -> DataFrame:
    """(sig, cluster): connected components of the links.

    Each round a class takes the least cluster of its neighbours, then the cluster of that cluster's own class (pointer
    jumping), so long chains take a logarithmic number of rounds.
    """
    found = m.edges()
    edges = cut(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut(m.classes.select("sig", F.col("sig").alias("cluster")))
    while True:
        offered = edges.join(state, edges.b == state.sig).groupBy("a").agg(F.min("cluster").alias("offer"))
        near = cut(state.join(offered, state.sig == offered.a, "left").select("sig", F.col("cluster").alias("was"), F.least("cluster", F.coalesce("offer", "cluster")).alias("cluster")))
        far = near.select(F.col("sig").alias("__s"), F.col("cluster").alias("__far"))
        after = cut(near.join(far, near.cluster == F.col("__s")).select("sig", "was", F.least("cluster", "__far").alias("cluster")))
        state = after.select("sig", "cluster")
        if after.where("cluster <> was").isEmpty():
            return state


def short_groups(theories: DataFrame, m: Mixture) -> DataFrame:
    """(key, cluster_id) of the records that are in no class, having fewer than LEAST readable concepts.

    Together are copies in the sense of problem 1, and records with the same concepts, at least one, and the same name
    but for case, space and punctuation; all others stand alone.
    """
    rest = theories.where("id IS NOT NULL").groupBy(F.col("id").alias("key")).agg(F.min(bare(F.col("name"))).alias("name")).join(m.members.select("key"), "key", "left_anti")
    first = theory_copies(theories).members.groupBy("key").agg(F.min("first_key").alias("first_key"))
    rest = rest.join(first, "key", "left").withColumn("first_key", F.coalesce("first_key", "key"))
    told = m.short.join(rest.select("key", "name"), "key").where("name <> ''").select(F.col("key").alias("first_key"), F.xxhash64("cids", "name").alias("told"))
    rest = cut(rest.join(told, "first_key", "left"))
    same = rest.where("told IS NOT NULL").groupBy("told").agg(F.min("key").alias("cluster_id"))
    alone = rest.where("told IS NULL").groupBy("first_key").agg(F.min("key").alias("cluster_id"))
    return rest.where("told IS NOT NULL").join(same, "told").select("key", "cluster_id").unionByName(rest.where("told IS NULL").join(alone, "first_key").select("key", "cluster_id"))


def class_links(theories: DataFrame) -> DataFrame:
    """(first_id, second_id): links between classes of different texts, each class by its least id; see ``members``."""
    m = similar(theories)
    firsts = m.members.groupBy("sig").agg(F.min("key").alias("id"))
    out = m.edges().distinct().join(firsts.select(F.col("sig").alias("a"), F.col("id").alias("x")), "a").join(firsts.select(F.col("sig").alias("b"), F.col("id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("first_id"), F.greatest("x", "y").alias("second_id"))


def members(theories: DataFrame) -> DataFrame:
    """(id, class_id, cluster_id): every record with an id, its class and its cluster, each named by its least id."""
    m = similar(theories)
    named = labels(m)
    firsts = m.members.groupBy("sig").agg(F.min("key").alias("class_id"))
    whole = named.join(firsts, "sig")
    cluster = whole.groupBy("cluster").agg(F.min("class_id").alias("cluster_id"))
    out = m.members.join(whole.join(cluster, "cluster").select("sig", "class_id", "cluster_id"), "sig").select(F.col("key").alias("id"), "class_id", "cluster_id")
    return out.unionByName(short_groups(theories, m).select(F.col("key").alias("id"), F.col("cluster_id").alias("class_id"), "cluster_id"))


def short_clusters(theories: DataFrame, m: Mixture, typical: int = 3) -> DataFrame:
    """The rows of ``clusters`` for ``short_groups``. Typical are the least ids."""
    grouped = cut(short_groups(theories, m))
    sizes = grouped.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    few = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("key"))).where(F.col("rank") <= typical)
    few = few.groupBy("cluster_id").agg(F.array_sort(F.collect_list("key")).alias("typical_ids"))
    return sizes.join(few, "cluster_id").select("cluster_id", "size", F.lit(1).cast("bigint").alias("classes"), "typical_ids")


def all_clusters(theories: DataFrame, typical: int = 3) -> DataFrame:
    """``clusters`` and ``short_clusters``: every record with an id is in exactly one cluster."""
    m = similar(theories)
    return clusters(theories, typical, m).unionByName(short_clusters(theories, m, typical))


def clusters(theories: DataFrame, typical: int = 3, m: Mixture | None = None) -> DataFrame:
    """(cluster_id, size, classes, typical_ids): each cluster by its least id, size and most typical members.

    Typical are the members of the classes of highest density under the mixtures (ties: larger classes, then least id).
    Records with fewer than LEAST readable concepts are in no cluster here; see ``all_clusters``.
    """
    m = similar(theories) if m is None else m
    named = labels(m)
    ranked = named.join(m.classes.select("sig", "n"), "sig").join(m.density, "sig", "left")
    firsts = m.members.groupBy("sig").agg(F.min("key").alias("id"))
    ranked = ranked.join(firsts, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("density"), F.desc("n"), "id")))
    return (
        ranked.groupBy("cluster")
        .agg(
            F.min("id").alias("cluster_id"),
            F.sum("n").alias("size"),
            F.count(F.lit(1)).alias("classes"),
            F.array_sort(F.collect_list(F.when(F.col("rank") <= typical, F.struct("rank", "id")))).alias("t"),
        )
        .select("cluster_id", "size", "classes", F.col("t.id").alias("typical_ids"))
    )
