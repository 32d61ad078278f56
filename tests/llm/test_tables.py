"""Problems 1, 4 and 5: copies, canonical names, samples."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import canonical, copies, sampling


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


THEORY = "id bigint, doi string, name string, mode string, evidence string, confidence_is_theory string, criteria_reasoning string, paper_focus int, key_concepts string, key string"


def theory(i, name, concepts, focus=1, doi="10.1/a"):
    return (i, doi, name, "m", "e", "high", None, focus, concepts, "clash")


def test_copies_of_theories(df):
    a = '[{"concept": "X y", "description": "d"}, {"concept": "z"}]'
    same = '[ {"description":"D.","concept":"x  Y"},{"concept":"\\u007a"} ]'
    order = '[{"concept": "z"}, {"concept": "X y", "description": "d"}]'
    t = df(
        [theory(1, "A b", a), theory(2, " a-B ", same, doi="10.1/A"), theory(3, "a b", order), theory(4, "A b", a, focus=2), theory(5, None, None), theory(6, None, None), theory(7, "", None), theory(8, None, ""), theory(9, "A b", a),
         theory(10, "A b", "[{broken"), theory(11, "A b", "[{BROKEN!"), theory(None, "A b", a)], THEORY,
    )
    c = copies.theory_copies(t)
    assert rows(c.members.where("key <> first_key")) == [(11, 10), (2, 1), (6, 5), (9, 1)]
    assert {(r.first_key, r.copies, r.spellings) for r in c.groups.collect()} == {(1, 3, 2), (3, 1, 1), (4, 1, 1), (5, 2, 1), (7, 1, 1), (8, 1, 1), (10, 2, 2)}
    empty = copies.theory_copies(t.limit(0))
    assert empty.groups.isEmpty() and empty.members.isEmpty()


def test_copies_of_entries(df):
    e = df(
        [("T2", "10.1/A", "Wear Theory"), ("T1", "10.1/a", "wear-theory."), ("T1", "10.1/a", "wear-theory."), ("T3", None, "wear theory"), ("T4", "", "wear theory"), ("T5", "10.1/a", "?"), ("T6", "10.1/a", "-"), ("T7", "10.1/a", None)],
        "theory_id string, doi string, original_name string",
    )
    assert rows(copies.entry_copies(e).members.where("key <> first_key")) == [("T2", "T1")]
    found = copies.copies_found(df([], THEORY), e)
    assert rows(found) == [("theory_entries", "T1", "T2")]


def test_equal_digests_are_no_copies(df, monkeypatch):
    """Groups are those of the full canonical text, even where different canonical texts have the same digest."""
    real = copies._digest
    monkeypatch.setattr(copies, "_digest", lambda text: F.when(text.rlike("^=101a\x04=[a-z]+$"), F.encode(F.lit("x"), "UTF-8")).otherwise(real(text)))
    e = df([("T1", "10.1/a", "samea"), ("T2", "10.1/a", "sameb"), ("T3", "10.1/a", "Samea"), ("T4", "10.1/a", "other"), ("T5", "10.1/a", "Other.")], "theory_id string, doi string, original_name string")
    assert rows(copies.entry_copies(e).members.where("key <> first_key")) == [("T3", "T1"), ("T5", "T4")]


def test_hot_group_of_copies(spark, df):
    many = spark.range(3000).select(F.format_string("T%05d", "id").alias("theory_id"), F.lit("10.1/x").alias("doi"), F.when(F.col("id") < 1500, F.lit("Hot Name")).when(F.col("id") < 2000, F.lit("hot  name")).otherwise(F.col("id").cast("string")).alias("original_name"))
    got = copies.entry_copies(many).members.where("key <> first_key")
    assert got.count() == 1999 and got.select("first_key").distinct().count() == 1


ONTOLOGY = "ontology_id bigint, category string, subcategory string, name string, aliases array<string>, abbreviations array<string>, value string"
LIST = [
    (1, "c", "s", "Synaptic Mortar Leakage Model", ["Mortar Seepage Hypothesis in Synaptic Tissue", "Silent Lighthouse Theory"], ["SMLM"], "clash"), (2, "c", "s", "Dermal Ledger Leakage Theory", [], [], None), (3, "c", "s", "Retinal Anvil Tearing Model", None, None, None),
    (4, "c", "s", "Basal Oar Accumulation Model", ["Oar Build-up Hypothesis in Basal Tissue"], ["BOAM"], None),
]


SITES = ["Gastric", "Ocular", "Renal", "Splenic", "Septal", "Tubular"]
LIST += [(10 + i, "c", "s", f"{site} Beacon Wandering Model", [f"Beacon Straying Hypothesis in {site} Tissue"], [], None) for i, site in enumerate(SITES)]
#: What teaches fillers: words that the list lacks, beside forms of many entries.
TAUGHT = [f"{site} Beacon Wandering Model{end}" for site in SITES for end in (", revised", " as a cause of aging", " (so-called third version)")]

CASES = [
        ("synaptic  MORTAR leakage model", 1), ("Leakage of the Mortar (Synaptic) as a cause of aging", 1), ("Mortar Leakage", 1), ("Dermal Ledger Seepage Concept", 2), ("Ledger seepage in dermal ageing", 2), ("silent-lighthouse paradigm", 1),
        ("S.M.L.M.", 1), ("SMLM theory", 1), ("the so-called Synaptic Mortar Leakage Model (SMLM), revised", 1), ("Synaptc Motrar Leakage Modle", 1), ("mortarleakage framework", 1), ("Retinal Anvil Taering Model", 3), ("Retinal Anvil Taerign Model", 3), ("Syynpatic_Mortar-Leakage", 1), ("Oar Build-up Hypothesis", 4),
        ("Oar Buildup Hypothesis in Baasl Tisseu", 4), ("Leakgae, Synaptic Mortar", 1), ("Synaptic Mortar LeakageModel", 1), ("Synaptic Mortar Leakage Model version three", None),
        ("Dermal Mortar Leakage Model", None), ("Synaptic Mortar Migration Model", None), ("Synaptic Anvil Leakage", None), ("Theory of aging", None), ("?", None), ("Leakage", None), ("Synaptic Mortar Leakage Model of Drugol", None), ("SMLX", None), ("12", None),
        ("Dermal Lever Leakage Model", None), ("x" * 50000, None), ("Synaptic Mortar Leakage " + "word " * 9000, None),
]


def found_in(df, values, listed=LIST, **more):
    return {r.value: r.ontology_id for r in canonical.match_values(df([(v,) for v in values], "value string"), df(listed, ONTOLOGY), **more).collect()}


def test_canonical_names(df):
    found = found_in(df, [v for v, _ in CASES] + TAUGHT)
    assert {v[:60]: found.get(v) for v, _ in CASES} == {v[:60]: e for v, e in CASES}
    assert all(found.get(v) == 10 + SITES.index(v.split()[0]) for v in TAUGHT)


def test_adding_rows_removes_no_match(df):
    """One misspelling in 1, 2, 3 or 50 values, in one entry's names or in many's, beside the word that it stands for or not."""
    kinds = ["Theory", "Model", "Framework", "Concept", "Paradigm", "Hypothesis", "Approach", "Account", "View", "Mechanism"]
    many = [f"{a}Dermal Ledegr Leakage {k}{b}" for k in kinds for a in ("", "The ") for b in ("", ".", " of Aging")][:50]
    for n in (1, 2, 3, 50):
        assert sorted(found_in(df, many[:n])) == sorted(many[:n])
    small = ["Synaptic Mortar Leakege Model", "Dermal Ledegr Leakage Theory"]
    more = [*small, *many, *[f"{s} Leakege {k}" for s in SITES for k in kinds], *[f"Dermal Ledger Leakage {k}" for k in kinds], "Leakege", "Ledegr"]
    assert set(found_in(df, small).items()) <= set(found_in(df, more).items()) and len(found_in(df, small)) == 2


def test_real_words_are_no_misspellings(df):
    """Words of the list or of the public vocabulary mean themselves, however rare or frequent they are."""
    listed = [*LIST, (30, "c", "s", "Dermal Anvil Wearing Model", [], [], None), (31, "c", "s", "Renal Oar Tearing Model", [], [], None)]
    for copies_ in (1, 8):
        values = [f"Dermal Lever Leakage {k}" for k in canonical.KINDS[:copies_]] + [f"Retinal Anvil Wearing {k}" for k in canonical.KINDS[:copies_]] + ["Dermal Ledegr Leakage Theory"]
        assert set(found_in(df, values, listed)) == {"Dermal Ledegr Leakage Theory"}
    assert "Dermal Lever Leakage Model" in found_in(df, ["Dermal Lever Leakage Model"], vocabulary_path=None)


def test_all_orders():
    """The expression for the orders of a form's words, for every number of words."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for n in range(1, 6):
        w = [f"w{i}" for i in range(n)]
        (got,) = spark.createDataFrame([(w,)], "w array<string>").select(canonical._orders(F.col("w"))).first()
        assert sorted(set(got)) == (sorted("".join(p) for p in itertools.permutations(w)) if n <= canonical.ORDERED else ["".join(w)])


def test_names_found_and_unmatched(df):
    entry = "theory_id string, original_name string, mapped_name string, match_result struct<canonical_name:string>, value string"
    e = df([("T1", "SMLM", None, ("Mortar Leakage",), "x"), ("T1", "SMLM", None, ("Mortar Leakage",), "x"), ("T2", "nothing", "", None, "x"), (None, "SMLM", None, None, "x")], entry)
    assert rows(canonical.names_found(e, df(LIST, ONTOLOGY))) == [("T1", "canonical_name", 1), ("T1", "original_name", 1)]
    assert rows(canonical.unmatched(e, df(LIST, ONTOLOGY))) == [("original_name", "nothing", 1)]
    hot = df([(f"T{i}", "Synaptic Mortar Leakege Model" if i % 3 else f"name {i}", None, None, "x") for i in range(600)], entry)
    assert canonical.names_found(hot, df(LIST, ONTOLOGY)).count() == 400
    assert canonical.names_found(e.limit(0), df(LIST, ONTOLOGY)).isEmpty() and canonical.names_found(e, df([], ONTOLOGY)).isEmpty()


def osa(a, b):
    """Edits with swaps of neighbours as one."""
    rows_ = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows_[-1][j] + 1, row[-1] + 1, rows_[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows_[-2][j - 2] + 1)
            row.append(best)
        rows_.append(row)
    return rows_[-1][-1]


def test_pigeonhole_join_against_brute_force(df):
    rng = random.Random(3)
    refs = ["leakage", "mortarleakage", "synapticmortarleakage", "basaloarbuildup", "tide", "loomtearing", "tearingloom", "wearingloom", "leakagemortar"]
    strings = {"", "x", *refs}
    for ref in refs:
        for _ in range(60):
            t = list(ref)
            for _ in range(rng.choice([1, 1, 2, 2, 3])):
                i = rng.randrange(len(t))
                kind = rng.randrange(4)
                if kind == 0:
                    t.insert(i, rng.choice("aekx"))
                elif kind == 1 and len(t) > 2:
                    del t[i]
                elif kind == 2:
                    t[i] = rng.choice("aekx")
                elif i + 1 < len(t):
                    t[i], t[i + 1] = t[i + 1], t[i]
            strings.add("".join(t))
    got = {(r.string, r.ref) for r in canonical.pigeonhole(df([(t,) for t in sorted(strings)], "string string"), df([(r,) for r in refs], "ref string")).collect()}
    allowed = lambda ref: canonical.K if len(ref) >= canonical.LONG else canonical.K_SHORT
    must = {(t, r) for t in strings for r in refs if len(t) > 1 and osa(t, r) <= allowed(r)}
    assert must <= got and all(osa(t, r) <= allowed(r) + 1 for t, r in got) and len(got) < 1.1 * len(must)


def arrivals(df, n, days):
    return df([(f"u{i}", f"2024-01-{1 + i % days:02d}") for i in range(n)], "unit string, batch string")


def test_sample_sizes_and_growth(df):
    small = arrivals(df, 300, 3)
    for rate in (0.0, 0.1, 0.33, 1.0):
        got = sampling.frozen_bottom_k(small, "unit", "batch", rate, "s").groupBy("batch").count().collect()
        assert sum(r["count"] for r in got) == 3 * math.ceil(rate * 100)
    before = set(rows(sampling.frozen_bottom_k(small, "unit", "batch", 0.1, "s")))
    later = small.unionByName(df([(f"v{i}", "2024-02-01") for i in range(50)], "unit string, batch string"))
    assert before <= set(rows(sampling.frozen_bottom_k(later.repartition(13), "unit", "batch", 0.1, "s")))
    assert before != set(rows(sampling.frozen_bottom_k(small, "unit", "batch", 0.1, "other")))


def test_frozen_batches_are_extended(df):
    """Decisions on earlier loads stand, also where a seen unit comes again with an earlier day."""
    first = arrivals(df, 300, 3)
    seen, sampled = first, sampling.frozen_bottom_k(first, "unit", "batch", 0.1, "s")
    load = df([("u5", "2023-01-01"), *[(f"v{i}", "2024-02-01") for i in range(50)], (None, "2024-02-01")], "unit string, batch string")
    seen2, sampled2 = sampling.extended(seen, sampled, load, "unit", "batch", 0.1, "s")
    assert seen2.count() == 350 and set(rows(sampled)) <= set(rows(sampled2)) and sampled2.count() == 35
    assert rows(sampling.extended(seen2, sampled2, load, "unit", "batch", 0.1, "s")[1]) == rows(sampled2)


def test_sample_edges(df):
    u = df([("a", None), (None, "2024-01-01"), ("b", None)], "unit string, batch string")
    got = rows(sampling.frozen_bottom_k(u, "unit", "batch", 1.0, "s"))
    assert got == [("a", None), ("b", None)]
    assert sampling.frozen_bottom_k(u.limit(0), "unit", "batch", 0.5, "s").isEmpty()
    with pytest.raises(ValueError):
        sampling.frozen_bottom_k(u, "unit", "batch", 1.5, "s")


def test_sample_of_names_takes_all_rows(df):
    e = df([(f"T{i}", f"n{i % 7}", f"2024-01-0{1 + i % 3} 10:00:00") for i in range(60)], "theory_id string, normalized_name string, ingested_at string").withColumn("ingested_at", F.to_timestamp("ingested_at"))
    names = sampling.sample_by_name(e, 0.5)
    kept = sampling.rows_of_names(e, names)
    assert kept.count() == e.join(names, "normalized_name", "left_semi").count() > 0
    redelivered = e.unionByName(e.withColumn("ingested_at", F.expr("ingested_at + interval 40 days")))
    assert rows(sampling.sample_by_id(redelivered, 0.2)) == rows(sampling.sample_by_id(e, 0.2))
