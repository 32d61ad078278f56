"""Problem 6: deeply nested records as flat tables with parent-child links.

Adjacency-table shredding: every node of a record's tree becomes one row (node, parent, label, ordinal, scalar); entity
tables are then made from the adjacency table alone, by joining object nodes with their scalar children and pivoting
these into columns.

A record's tree is walked once, breadth first, whatever its depth, in an Arrow batch function: SQL expressions have no
recursion within a row, and a join per level would read each record as often as it is deep. The adjacency table is
written once to the shared folder, by kind of node, so that what joins need of it (a few integers of the lists and
objects, the scalars of some labels) is all that they read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import ship, written

#: Nodes that a batch of output holds at least, before it is passed on.
CHUNK = 100_000
KINDS = ("null", "scalar", "array", "object", "missing", "broken")
NULL, SCALAR, ARRAY, OBJECT, MISSING, BROKEN = range(6)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


#: Objects as tuples of pairs (repeated fields are all kept), numbers as they are written.
_DECODER = json.JSONDecoder(object_pairs_hook=tuple, parse_float=str, parse_int=str, parse_constant=_no_constant)


def parse(text: str) -> object:
    """Lists as lists, objects as tuples of pairs, scalars as text, True, False or None."""
    return _DECODER.decode(text)


def walk(text: str | None, json_text_labels: frozenset[str], out: tuple[list, list, list, list, list]) -> int:
    """Append (parent, label, ordinal, kind, scalar) of each node of ``text``, breadth first; gives their number.

    The n-th appended row is node n; the root is node 0 and its own parent is null.
    """
    parents, labels, ordinals, kinds, scalars = out
    parents.append(None)
    labels.append(None)
    ordinals.append(0)
    if text is None or not text.strip():
        kinds.append(MISSING)
        scalars.append(None)
        return 1
    try:
        todo = [parse(text)]
    except (ValueError, RecursionError):
        kinds.append(BROKEN)
        scalars.append(text)
        return 1
    base = len(labels) - 1
    for node, value in enumerate(todo):  # grows while it is walked
        if type(value) is str and labels[base + node] in json_text_labels and value.lstrip()[:1] in ("[", "{"):
            try:
                value = parse(value)
            except (ValueError, RecursionError):
                pass
        if type(value) is str:
            kinds.append(SCALAR)
            scalars.append(value)
            continue
        if type(value) is tuple:
            kinds.append(OBJECT)
            for ordinal, (label, child) in enumerate(value):
                labels.append(label)
                ordinals.append(ordinal)
                todo.append(child)
        elif type(value) is list:
            kinds.append(ARRAY)
            labels.extend([None] * len(value))
            ordinals.extend(range(len(value)))
            todo.extend(value)
        else:
            kinds.append(NULL if value is None else SCALAR)
            scalars.append(None if value is None else "true" if value else "false")
            continue
        scalars.append(None)
        parents.extend([node] * len(value))
    return len(todo)


def _texts(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # halves of surrogate pairs
        return pa.array([v.encode("utf-8", "replace").decode("utf-8") if v is not None else None for v in values], pa.string())


def adjacency(df: DataFrame, key: str, text: Column, json_text_labels: tuple[str, ...] = ()) -> DataFrame:
    """(record, node, parent, label, ordinal, scalar, kind) of every node of ``text``, a JSON text.

    node numbers the nodes of a record from 0 (the root), parent is null for the root, label the field's name (null for
    elements of a list), ordinal the position in the list or object, kind object, array, scalar or null. Elements that
    are null are nodes of kind null, so positions count all elements as stored. Text under one of ``json_text_labels``
    that is a JSON list or object counts as that. Of a field that occurs twice in an object both are nodes.

    Records without a key are left out. A missing payload gives one node of kind missing, one that can't be parsed as a
    whole one of kind broken with the payload as its scalar; see ``rejected``. The table is written to the shared folder.
    """
    ship(df.sparkSession)
    texts = frozenset(json_text_labels)
    kind = df.schema[key].dataType.simpleString()
    names = pa.array(KINDS)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, first = batch.column(0), [], 0
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for at, payload in enumerate(batch.column(1)):
                sizes.append(walk(payload.as_py(), texts, out))
                if len(out[0]) >= CHUNK or at == len(keys) - 1:
                    owner = pa.array([first + k for k, n in enumerate(sizes) for _ in range(n)], pa.int64())
                    nodes = pa.array([k for n in sizes for k in range(n)], pa.int32())
                    parents, labels, ordinals, kinds, scalars = out
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(owner), nodes, pa.array(parents, pa.int32()), _texts(labels), pa.array(ordinals, pa.int32()), _texts(scalars), names.take(pa.array(kinds, pa.int8()))],
                        ["record", "node", "parent", "label", "ordinal", "scalar", "kind"],
                    )
                    sizes, first, out = [], at + 1, ([], [], [], [], [])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("record"), text.alias("text"))
    return written(rows.mapInArrow(flatten, f"record {kind}, node int, parent int, label string, ordinal int, scalar string, kind string"), "kind")


def rejected(nodes: DataFrame) -> DataFrame:
    """(record, reason, payload): the records that gave no tree, as the payload is missing or broken."""
    return nodes.where(F.col("kind").isin("missing", "broken")).select("record", F.col("kind").alias("reason"), F.col("scalar").alias("payload"))


def children(nodes: DataFrame, parents: DataFrame, label: str, keep: list[str], position: str) -> DataFrame:
    """The elements of the list under field ``label`` of the object nodes ``parents`` (record, node and ``keep``).

    A lone object or scalar counts as a list of one. Elements that are null are left out, but count in ``position``.
    """
    field = nodes.where((F.col("label") == label) & F.col("kind").isin("object", "array", "scalar")).select("record", F.col("parent").alias("owner"), F.col("node").alias("list"), "kind", "scalar")
    owners = parents.select("record", F.col("node").alias("owner"), *keep)
    lists = owners.join(field, ["record", "owner"])
    elements = nodes.where(F.col("label").isNull() & F.col("kind").isin("object", "array", "scalar")).select("record", F.col("parent").alias("list"), "node", F.col("ordinal").alias(position), "kind", "scalar")
    many = lists.where(F.col("kind") == "array").drop("kind", "scalar").join(elements, ["record", "list"])
    lone = lists.where(F.col("kind") != "array").select("record", *keep, F.col("list").alias("node"), F.lit(0).alias(position), "kind", "scalar")
    return many.select("record", *keep, "node", position, "kind", "scalar").unionByName(lone)


def entity(nodes: DataFrame, objects: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Object nodes with their scalar children pivoted into columns ``fields``.

    A missing or nested field is null; of a field that occurs twice the last one counts.
    """
    scalars = nodes.where((F.col("kind") == "scalar") & F.col("label").isin(*fields)).select("record", F.col("parent").alias("node"), "label", "ordinal", "scalar")
    picks = [F.max_by(F.when(F.col("label") == f, F.col("scalar")), F.when(F.col("label") == f, F.col("ordinal"))).alias(f) for f in fields]
    wide = scalars.groupBy("record", "node").agg(*picks)
    return objects.where(F.col("kind") == "object").select("record", "node", *keep).join(wide, ["record", "node"], "left")


def batch_nodes(batches: DataFrame) -> DataFrame:
    """The adjacency table of batch_result."""
    return adjacency(batches, "batch_id", F.to_json("batch_result", {"ignoreNullFields": "false"}))


def payload_nodes(results: DataFrame) -> DataFrame:
    """The adjacency table of payload."""
    return adjacency(results, "record_id", F.col("payload"), json_text_labels=("theories", "key_concepts"))


def _root(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == "object") & F.col("parent").isNull())


def subcluster_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sub-clusters with their scalar fields, theory ids): linked by record and sub_pos."""
    subs = children(nodes, _root(nodes), "subclusters", [], "sub_pos")
    table = entity(nodes, subs, ["sub_pos"], ["subcluster_name", "mechanism_focus", "theory_count", "status", "warning_reason"])
    ids = children(nodes, subs.where("kind = 'object'"), "theory_ids", ["sub_pos"], "id_pos").where((F.col("kind") == "scalar") & (F.trim("scalar") != ""))
    return table.drop("node"), ids.select("record", "sub_pos", "id_pos", F.col("scalar").alias("theory_id"))


def theory_tables(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(theories with their scalar fields, key concepts): linked by record and theory_pos.

    A concept stored as a bare string is its own text; concepts without text give no row.
    """
    theories = children(nodes, _root(nodes), "theories", [], "theory_pos").where("kind = 'object'")
    table = entity(nodes, theories, ["theory_pos"], ["name", "mode", "evidence", "confidence_is_theory", "paper_focus"])
    found = children(nodes, theories, "key_concepts", ["theory_pos"], "concept_pos")
    concepts = entity(nodes, found.withColumn("bare", F.when(F.col("kind") == "scalar", F.col("scalar"))).withColumn("kind", F.lit("object")), ["theory_pos", "concept_pos", "bare"], ["concept", "description"])
    concepts = concepts.select("record", "theory_pos", "concept_pos", F.coalesce("bare", "concept").alias("concept"), "description")
    return table.drop("node"), concepts.where(F.trim(F.coalesce(F.col("concept"), F.lit(""))) != "")


def shred_found(batches: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, record_key, parent_pos, child_pos, child_key): one row per theory id and per key concept."""
    ids = subcluster_tables(batch_nodes(batches))[1].select(F.lit("stage6_batches").alias("table_name"), "record", "sub_pos", "id_pos", "theory_id")
    concepts = theory_tables(payload_nodes(results))[1].select(F.lit("extraction_results").alias("table_name"), "record", "theory_pos", "concept_pos", "concept")
    return ids.union(concepts).toDF("table_name", "record_key", "parent_pos", "child_pos", "child_key")
