"""Problem 7: documents packed into containers of one fixed capacity, measured in tokens of a public tokenizer.

Sum-of-squares packing: each item goes where the sum, over all residual gaps g, of (number of open containers with gap
g) squared becomes smallest; a new container is one of the choices. No count of any gap may thus grow large, so that
whatever comes next finds a fitting gap. An item is split only if it is longer than a container: full containers are cut
from its front, and the rest is packed like any other item.

Packing is sequential, so documents are dealt by a hash of their key into groups that fill about BINS containers each,
whatever the size of the corpus; every group is a sample of the whole, and leaves a few open containers at its end (a
share of about their number / BINS of the space). Groups are packed in parallel, in the order of the hash: the result
depends on the rows alone, not on their partitioning.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
BINS = 2000


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, tokens, mark) of every row; null and empty texts have 0 tokens. Whole texts are encoded; mark is a hash of the text.

    ``tokenizer`` is the path of a rank file on the driver, which Spark sends to the executors.
    """
    spark = documents.sparkSession
    ship(spark)
    spark.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    kind = documents.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], [key, "tokens", "mark"])

    return documents.select(key, "text", F.xxhash64("text").alias("mark")).mapInArrow(measure, f"`{key}` {kind}, tokens bigint, mark bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container, place) of each item of 1..capacity tokens, in the order given, and the number of containers.

    Ties go to the choice that leaves the smallest gap, then to the container opened last.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; count[0] and count[capacity] stay 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    container, place = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    made = 0
    gaps = np.empty(0, dtype=np.int64)  # gaps with an open container, ascending
    for k, s in enumerate(sizes.tolist()):
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        fits = gaps[np.searchsorted(gaps, s) :]
        gap = capacity
        if len(fits):
            # leaving gap g and making gap g - s; two containers change place unless the container is full afterwards
            change = 2 * (count[fits - s] - count[fits]) + np.where(fits > s, 2, 1)
            best = int(change.argmin())
            if change[best] <= new:
                gap = int(fits[best])
        if gap == capacity:
            which, made = made, made + 1
        else:
            which = stacks[gap].pop()
            count[gap] -= 1
            if not count[gap]:
                gaps = np.delete(gaps, np.searchsorted(gaps, gap))
        left = gap - s
        container[k], place[k] = which, capacity - gap
        if left:
            stacks[left].append(which)
            count[left] += 1
            if count[left] == 1:
                gaps = np.insert(gaps, np.searchsorted(gaps, left), left)
    return container, place, made


def pack(lengths: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", bins: int = BINS) -> DataFrame:
    """(key, piece, start, tokens, container, place) of every piece of every document.

    Documents of up to ``capacity`` tokens are one piece (0). Longer ones are cut into pieces that start at token
    ``start``, all full but the last. ``place`` is the piece's offset in its container; containers are numbered by
    group (upper bits) and order. Documents without tokens need no space and have no container: one row, with nulls.
    Rows with equal keys are packed each, those without a key too; ``lengths`` may have a column mark that tells them apart.
    Rows that are equal in all are counted first and dealt one by one, so however many there are, they spread over the
    groups. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    mark = F.col("mark") if "mark" in lengths.columns else F.lit(None).cast("bigint")
    counted = cut(lengths.select(F.col(key).alias("key"), "tokens", mark.alias("mark")).groupBy("key", "tokens", "mark").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.coalesce(F.sum(F.col("tokens") * F.col("n")), F.lit(0)).alias("t")).first()["t"]
    groups = max(1, round(total / (capacity * bins)))
    each = counted.select("key", "tokens", "mark", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at"))
    h = F.xxhash64(F.col("key").cast("string"), "mark", "at")
    rows = each.select("key", "tokens", h.alias("h"), F.pmod(h, F.lit(groups)).cast("int").alias("group"))
    kind = lengths.schema[key].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("key", "ascending"), ("tokens", "ascending")])
        tokens = table["tokens"].to_numpy()
        group = table["group"][0].as_py()
        full, rest = tokens // capacity, tokens % capacity
        item, offset, made = sum_of_squares(rest[rest > 0], capacity)
        pieces = full + (rest > 0)
        row = np.repeat(np.arange(len(tokens)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = (piece == full[row]) if len(row) else np.empty(0, dtype=bool)
        container, at = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
        container[last], at[last] = item, offset
        container[~last] = made + np.arange(int((~last).sum()))
        return pa.table(
            {
                "key": table["key"].take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(piece * capacity, pa.int64()),
                "tokens": pa.array(np.where(last, rest[row], capacity), pa.int64()),
                "container": pa.array((group << 32) + container, pa.int64()),
                "place": pa.array(at, pa.int64()),
            }
        )

    packed = rows.where(F.col("tokens") > 0).groupBy("group").applyInArrow(place, f"key {kind}, piece int, start bigint, tokens bigint, container bigint, place bigint")
    empty = rows.where(F.col("tokens") == 0).select(
        "key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), "tokens", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("place")
    )
    return packed.unionByName(empty).withColumnRenamed("key", key)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, least, tokens, unused, used_share): how well the containers are filled; no packing can do with fewer than ``least``."""
    per = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("t"))
    sums = per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    room = F.col("containers") * capacity
    return sums.select("containers", F.ceil(F.col("tokens") / capacity).alias("least"), "tokens", (room - F.col("tokens")).alias("unused"), F.try_divide(F.col("tokens"), room).alias("used_share"))


def checks(packed: DataFrame, lengths: DataFrame, documents: int, capacity: int = CAPACITY, key: str = "doc_id", slack: float = 0.03) -> DataFrame:
    """(documents, overfull, overlapping, split_needlessly, lost, well_filled): how a packing keeps its rules; ``lengths``: (key, want)."""
    packed = cut(packed)
    held = packed.where("container IS NOT NULL")
    at = Window.partitionBy("container").orderBy("place")
    overlapping = held.withColumn("next", F.lead("place").over(at)).agg(F.count_if(F.col("place") + F.col("tokens") > F.col("next")).alias("overlapping"))
    overfull = held.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    # pieces are cut at full containers only
    short = held.agg(F.count_if(F.col("start") != F.col("piece") * capacity).alias("split_needlessly"))
    per = packed.groupBy(F.col(key).alias("k")).agg(F.sum("tokens").alias("got"))
    lost = lengths.join(per, F.col(key).eqNullSafe(F.col("k")), "left").agg(F.count_if(F.coalesce("got", F.lit(-1)) != F.col("want")).alias("lost"))
    full = fill(packed, capacity).select((F.col("containers") <= F.ceil(F.col("least") * (1 + slack)) + 1).alias("well_filled"))
    rows = [f.withColumn("one", F.lit(1)) for f in (overfull, overlapping, short, lost, full)]
    return rows[0].join(rows[1], "one").join(rows[2], "one").join(rows[3], "one").join(rows[4], "one").select(F.lit(documents).cast("bigint").alias("documents"), "overfull", "overlapping", "split_needlessly", "lost", "well_filled")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container and place of each document; see ``pack``."""
    return pack(token_lengths(documents, tokenizer=tokenizer), capacity)
