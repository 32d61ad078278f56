"""Problem 1: records that differ only in white space, letter case, punctuation or field order.

Three steps, none of which sees a row twice: byte-identical rows collapse first (a map-side combined group-by with a
count), only the distinct survivors are canonicalised, and these are grouped again on their full canonical text, whose
counts are summed. Keys never travel in lists, nor do wide texts in joins: a group is named by a digest of its canonical
text once its texts have been compared and found equal (were two texts to share a digest, their groups are named by the
text itself). Keys come by their group in a join: membership is a join of keys to groups, which treats groups that own a
large share of all rows apart (``corvane.operators.skew``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import skew_join
from corvane.session import cut, written

#: Everything that is disregarded: separators, controls and punctuation of any script.
NOISE = r"[\p{Z}\p{C}\p{P}\s]+"


def bare(text: Column) -> Column:
    """``text`` in lower case without white space, control characters and punctuation; null stays null."""
    return F.regexp_replace(F.lower(F.upper(text)), NOISE, "")


def bare_json(text: Column) -> Column:
    """Canonical text of a JSON list of objects: the order of the list counts, the order of fields does not.

    Text that is no such list is compared as bare text. A list and a text that isn't one are never equal; null stays
    null. Field order inside objects nested deeper than the list's own objects counts.
    """
    parsed = F.from_json(text, "array<map<string,string>>")
    one = lambda m: F.concat_ws(
        "\x02",
        F.array_sort(
            F.transform(
                F.map_entries(m), lambda e: F.concat(bare(e["key"]), F.lit("\x03"), F.coalesce(F.concat(F.lit("="), bare(e["value"])), F.lit("~")))
            )
        ),
    )
    return F.when(parsed.isNull(), F.concat(F.lit("t"), bare(text))).otherwise(
        F.concat(F.lit("j"), F.concat_ws("\x01", F.transform(parsed, lambda m: F.coalesce(one(m), F.lit("~")))))
    )


def _whole(names: list[str]) -> Column:
    return F.concat_ws("\x04", *[F.coalesce(F.concat(F.lit("="), n), F.lit("~")) for n in names])


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


@dataclass
class Copies:
    """groups: one row per distinct record (canonical columns, first_key, copies, spellings); members: key -> first_key
    of every row whose record was stored more than once."""

    groups: DataFrame
    members: DataFrame


def collapse(df: DataFrame, key: str, columns: list[str], json_columns: tuple[str, ...] = (), required: tuple[str, ...] = (), share: float = 0.02) -> Copies:
    """Collapse rows whose ``columns`` are equal but for white space, letter case and punctuation.

    ``json_columns``: those of ``columns`` that hold JSON lists of objects (also compared without JSON layout and field
    order). ``required``: columns that must hold a letter or digit; rows where one doesn't are left out. Null equals
    only null, and the empty text is not null. Numbers are compared as text. Rows without a key are left out. ``copies``
    counts stored rows, re-delivered ones too; a key that occurs more than once is one member of its group.
    Columns of ``df`` beyond these are ignored, whatever their names. An empty table gives empty results.
    """
    texts = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *texts)
    for c in required:
        rows = rows.where(F.col(f"c{columns.index(c)}").rlike(r"[\p{L}\p{N}]"))
    # 16-byte digests stand for texts where keys must be kept; wide texts are shuffled once, by the raw collapse.
    rows = rows.withColumn("raw", _digest(_whole(names)))
    survivors = rows.groupBy("raw", *names).agg(F.min("key").alias("first_raw"), F.count(F.lit(1)).alias("n"))
    canonical = [(bare_json(F.col(n)) if c in json_columns else bare(F.col(n))).alias(n) for n, c in zip(names, columns, strict=True)]
    distinct = survivors.select("raw", "first_raw", "n", *canonical)
    groups = distinct.groupBy(*names).agg(F.min("first_raw").alias("first_key"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("spellings"))
    kept = written(distinct.select("raw", "first_raw", "n", _whole(names).alias("text")).withColumn("group", _digest(F.col("text"))))
    mixed = cut(kept.groupBy("group").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("group", F.lit(True).alias("mixed")))
    slim = kept.select("raw", "first_raw", "n", "group")
    if not mixed.isEmpty():
        slim = cut(kept.join(mixed, "group", "left").select("raw", "first_raw", "n", F.when(F.col("mixed"), F.encode("text", "UTF-8")).otherwise(F.col("group")).alias("group")))
    repeated = slim.groupBy("group").agg(F.min("first_raw").alias("first_key"), F.sum("n").alias("copies")).where("copies > 1")
    raw_to_first = skew_join(slim.select("group", "raw"), repeated.select("group", "first_key"), "group", share).select("raw", "first_key")
    members = skew_join(cut(rows.select("raw", "key")), cut(raw_to_first), "raw", share).select("key", "first_key").distinct()
    renamed = [F.col(n).alias(f"canonical_{c}") for n, c in zip(names, columns, strict=True)]
    return Copies(groups.select(*renamed, "first_key", "copies", "spellings"), members)


def theory_copies(theories: DataFrame) -> Copies:
    """Copies among theories: all columns but the id."""
    columns = ["doi", "name", "mode", "evidence", "confidence_is_theory", "criteria_reasoning", "paper_focus", "key_concepts"]
    return collapse(theories, "id", columns, json_columns=("key_concepts",))


def entry_copies(entries: DataFrame) -> Copies:
    """Copies among theory entries: doi and original_name, both present, the name holding a letter or digit.

    A re-delivered row has the same theory_id, doi and name, so it's no copy of itself.
    """
    return collapse(entries.where(F.coalesce(F.col("doi"), F.lit("")) != ""), "theory_id", ["doi", "original_name"], required=("original_name",))


def copies_found(theories: DataFrame, entries: DataFrame) -> DataFrame:
    """(table_name, first_key, copy_key): one row per copy beyond the first; keys as text."""
    parts = [
        c.members.where(F.col("key") != F.col("first_key")).select(
            F.lit(name).alias("table_name"), F.col("first_key").cast("string").alias("first_key"), F.col("key").cast("string").alias("copy_key")
        )
        for name, c in (("theories", theory_copies(theories)), ("theory_entries", entry_copies(entries)))
    ]
    return parts[0].unionByName(parts[1])
