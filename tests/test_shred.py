"""Problem 6: nested records as flat tables."""

import itertools
import json

from pyspark.sql import functions as F

from corvane.operators import shred


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


BATCH = "batch_id bigint, batch_result struct<subclusters:array<struct<subcluster_name:string,theory_ids:array<string>,theory_count:int>>,separation_rationale:string>, record string"


def test_shredding(df):
    b = df([(1, ([("s", ["T1", None, "", "T1"], 2), None, ("t", None, None), ("u", [], None)], "why"), "x"), (2, None, "x"), (3, (None, None), "x"), (None, ([("s", ["T9"], 1)], ""), "x")], BATCH)
    payloads = {
        1: {"theories": [{"name": "A", "key_concepts": [{"concept": "c0"}, None, "c2", {"description": "d"}, {"concept": ""}]}, None, {"name": "B", "key_concepts": {"concept": "lone"}}]},
        2: {"theories": {"name": "C", "key_concepts": json.dumps([{"concept": "t0"}, "t1"])}},
        3: {"theories": [{"key_concepts": "bare text"}]},
        4: {"theories": None}, 5: [], 6: None,
    }
    p = df([(k, json.dumps(v), "x") for k, v in payloads.items()] + [(7, '{"theories": [{"name"', "x"), (8, None, "x"), (9, "", "x")], "record_id bigint, payload string, node string")
    assert rows(shred.shred_found(b, p)) == sorted(
        [("stage6_batches", 1, 0, 0, "T1"), ("stage6_batches", 1, 0, 3, "T1"), ("extraction_results", 1, 0, 0, "c0"), ("extraction_results", 1, 0, 2, "c2"), ("extraction_results", 1, 2, 0, "lone"),
         ("extraction_results", 2, 0, 0, "t0"), ("extraction_results", 2, 0, 1, "t1"), ("extraction_results", 3, 0, 0, "bare text")], key=str,
    )
    table, _ = shred.theory_tables(shred.payload_nodes(p))
    assert {(r.record, r.theory_pos, r.name) for r in table.collect()} == {(1, 0, "A"), (1, 2, "B"), (2, 0, "C"), (3, 0, None)}
    assert shred.shred_found(b.limit(0), p.limit(0)).isEmpty()


def tree(nodes):
    """The records of an adjacency table, put together again."""
    kids = {}
    for n in nodes:
        kids.setdefault((n.record, n.parent), []).append(n)

    def build(n):
        below = sorted(kids.get((n.record, n.node), []), key=lambda m: m.ordinal)
        return {m.label: build(m) for m in below} if n.kind == "object" else [build(m) for m in below] if n.kind == "array" else n.scalar

    return {n.record: build(n) for n in nodes if n.parent is None}


def test_adjacency_is_complete(df):
    doc = {"a": [1, {"b": None, "c": ["x", []]}], "d": {"e": {"f": True}}, "n": "1.50", "m": 2.50}
    nodes = shred.adjacency(df([(1, json.dumps(doc))], "k int, j string"), "k", F.col("j")).collect()
    assert tree(nodes) == {1: {"a": ["1", {"b": None, "c": ["x", []]}], "d": {"e": {"f": "true"}}, "n": "1.50", "m": "2.5"}}
    assert len({n.node for n in nodes}) == len(nodes)
    assert {n.scalar for n in nodes if n.kind == "scalar"} == {"1", "x", "true", "1.50", "2.5"}


def test_any_depth(df):
    """Twenty levels and five hundred: every leaf is a row of its own."""
    docs = []
    for depth in (20, 500):
        doc = "leaf"
        for k in range(depth):
            doc = {f"l{k}": doc, "side": k} if k % 2 else [doc, k]
        docs.append((depth, json.dumps(doc)))
    nodes = shred.adjacency(df(docs, "k int, j string"), "k", F.col("j")).collect()
    for depth, _ in docs:
        own = [n for n in nodes if n.record == depth]
        assert len(own) == 2 * depth + 1 and sorted(n.scalar for n in own if n.kind == "scalar") == sorted(["leaf", *map(str, range(depth))])


def test_rejects_and_oddities(df):
    texts = [None, " ", "{", "[1] x", "[NaN]", '{"a": 1, "a": 2}', '"\\ud800"', "7", "[" * 200000]
    nodes = shred.adjacency(df([(i, t, "x") for i, t in enumerate(texts)] + [(None, "[]", "x")], "k int, j string, kind string"), "k", F.col("j"))
    assert {(r.record, r.reason) for r in shred.rejected(nodes).collect()} == {(0, "missing"), (1, "missing"), (2, "broken"), (3, "broken"), (4, "broken"), (8, "broken")}
    assert sorted(r.scalar for r in nodes.where("record = 5 AND kind = 'scalar'").collect()) == ["1", "2"]
    objects = nodes.where("kind = 'object'").select("record", "node", "kind")
    assert [r.a for r in shred.entity(nodes, objects, [], ["a"]).collect()] == ["2"]
    assert shred.adjacency(df([], "k int, j string"), "k", F.col("j")).isEmpty()


def test_many_nodes_in_one_batch(df, monkeypatch):
    """Output is passed on in parts; records keep their own numbers."""
    docs = [(i, json.dumps([{"v": j} for j in range(i % 7)])) for i in range(300)]
    monkeypatch.setattr(shred, "CHUNK", 50)
    got = tree(shred.adjacency(df(docs, "k int, j string").coalesce(1), "k", F.col("j")).collect())
    assert got == {i: [{"v": str(j)} for j in range(i % 7)] for i in range(300)}


def test_product_of_positions_is_stable(df):
    """Positions count elements as stored, whatever the partitioning."""
    p = df([(i, json.dumps({"theories": [{"key_concepts": [f"c{i}", None, f"d{i}"]}]})) for i in range(40)], "record_id bigint, payload string")
    got = shred.theory_tables(shred.payload_nodes(p.repartition(9)))[1]
    assert {(r.record, r.concept_pos, r.concept) for r in got.collect()} == set(itertools.chain.from_iterable([(i, 0, f"c{i}"), (i, 2, f"d{i}")] for i in range(40)))
