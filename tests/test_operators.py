import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import annotate, batching, consolidate, lineage, matching, qa, quality, skew, vectors

ONTOLOGY = [
    (1, "c", "s", "Free Radical Theory", ["Oxidative Damage Theory"], ["FRT"]), (2, "c", "s", "Telomere Theory", [], ["TT"]), (3, "c", "t", "Mutation Accumulation Theory", ["Mutation Accumulation"], []),
    (4, "c", "t", "Mitochondrial Theory", None, None),
]
ONTOLOGY_SCHEMA = "ontology_id bigint, category string, subcategory string, name string, aliases array<string>, abbreviations array<string>"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_match_ladder(df):
    todo = df([(n,) for n in ("[FRT]", "Theory of radicals (FRT)", "free-radical hypothesis of ageing", "Telomere Theroy", "Mutation-Accumulation", "Unrelated Idea", None, "Telomere Theory with Replicative Mosaicism")], "name string")
    got = {r.name: r for r in matching.match_names(todo, df(ONTOLOGY, ONTOLOGY_SCHEMA)).collect()}
    assert len(got) == 7
    assert (got["[FRT]"].match_type, got["Theory of radicals (FRT)"].canonical) == ("abbreviation", "Free Radical Theory")
    assert got["free-radical hypothesis of ageing"].match_type == "exact" and got["Mutation-Accumulation"].match_type == "exact"
    assert got["Telomere Theroy"].matched is False and got["Telomere Theroy"].score > 90  # the core words differ
    assert not got["Unrelated Idea"].matched and not got["Telomere Theory with Replicative Mosaicism"].matched


def test_match_edge_cases(df):
    empty = df([], ONTOLOGY_SCHEMA)
    assert [r.match_type for r in matching.match_names(df([("x",)], "name string"), empty).collect()] == ["no_match"]
    assert rows(matching.match_names(df([], "name string"), df(ONTOLOGY, ONTOLOGY_SCHEMA))) == []
    assert rows(matching.not_listed(df([("telomere theory",), ("",), (None,)], "name string"), df(ONTOLOGY, ONTOLOGY_SCHEMA))) == [("telomere theory",)]
    assert rows(matching.not_listed(df([("telomere theory",)], "name string"), df(ONTOLOGY, ONTOLOGY_SCHEMA), fold_case=True)) == []


def test_slices_of_long_lists_agree(df, monkeypatch):
    todo = df([("radical free theory",), ("mitochondria",)], "name string")
    whole = rows(matching.best_fuzzy(todo, df(ONTOLOGY, ONTOLOGY_SCHEMA)))
    monkeypatch.setattr(matching, "LIST_MOST", 2)
    assert rows(matching.best_fuzzy(todo, df(ONTOLOGY, ONTOLOGY_SCHEMA))) == whole


@pytest.mark.parametrize("total", [25, 30, 35, 45, 60, 65, 90, 100])
@pytest.mark.parametrize("most", [26, 30, 35])
def test_even_batches(df, total, most):
    sizes = [r["count"] for r in batching.even(df([("g", i) for i in range(total)], "g string, i int"), most, "g", "i").groupBy("batch").count().orderBy("batch").collect()]
    assert sum(sizes) == total and max(sizes) <= most and max(sizes) - min(sizes) <= 1 and len(sizes) == -(-total // most) and sizes == sorted(sizes, reverse=True)


def test_packing():
    groups = [("A", 3), ("B", 4), ("C", 12), ("D", 2)]
    assert batching.plan_packing(groups, 8) == [("batch_A_B", "A", 0, 3), ("batch_A_B", "B", 0, 4), ("batch_C_1", "C", 0, 8), ("batch_C_2", "C", 8, 12), ("batch_D", "D", 0, 2)]
    topped = batching.plan_packing(groups, 8, top_up=True)
    assert ("batch_A_B_C", "C", 0, 1) in topped and sum(b - a for *_, a, b in topped) == 21
    assert batching.plan_packing([], 8) == [] and batching.dynamic_size(10) == 90 and batching.dynamic_size(4000) == 45


def test_alphabetical_and_similar(df):
    names = df([(n,) for n in ("b one", "a", "b two", "c", None, "", "a")], "name string")
    assert rows(batching.alphabetical(names, 3)) == [("batch_A_B", "a"), ("batch_A_B", "b one"), ("batch_A_B", "b two"), ("batch_C", "c")]
    many = df([(f"free radical theory {i}",) for i in range(6)] + [(f"zebra stripe {i}",) for i in range(6)], "name string")
    got = batching.similar_batches(many, 6).groupBy("batch").agg(F.count_distinct(F.substring("name", 1, 1)).alias("k")).collect()
    assert all(r.k == 1 for r in got)
    assert batching.similar_batches(df([], "name string"), 5).isEmpty()


def test_annotate_retries_and_falls_back(df):
    todo = df([("ok",), ("late",), ("never",)], "name string")
    def replies(batches):
        for pdf in batches:
            seen = len(pdf)
            pdf = pdf[(pdf.name != "never") & ((pdf.name != "late") | (seen < 3))]
            yield pdf.assign(mapped=pdf.name + "!")

    good, still = annotate.annotate(todo.coalesce(1), replies, "name string, mapped string", ["name"], F.col("mapped").isNotNull())
    assert rows(good) == [("late", "late!"), ("ok", "ok!")] and rows(still) == [("never",)]
    assert rows(annotate.with_fallback(todo, good)) == [("late", "late!"), ("never", "never"), ("ok", "ok!")]


def test_split_verdicts(df):
    r = df([(c, f"T{i}") for c in "abcdef" for i in range(1, 5)], "cluster_name string, theory_id string")
    a = df(
        [("a", "x", "T1"), ("a", "x", "T2"), ("a", "y", "T3"), ("a", "y", "T4")] + [("b", "x", "T1"), ("b", "x", "T2"), ("b", "y", "T3")] + [("c", "x", "T1"), ("c", "x", "T9")]
        + [("d", "x", "T1"), ("d", "y", "T1"), ("d", "x", "T2")] + [("e", "x", "T1"), ("e", "y", "T2")],
        "cluster_name string, subcluster_name string, theory_id string",
    )
    assert {x.cluster_name: x.verdict for x in annotate.check_split(r, a).collect()} == {"a": "valid", "b": "singletons", "c": "extra", "d": "duplicate", "e": "all_small", "f": "empty"}
    filled = annotate.with_singletons(r.where("cluster_name = 'b'"), a.where("cluster_name = 'b'"))
    assert {x.theory_id: x.status for x in filled.collect()} == {"T1": "ok", "T2": "ok", "T3": "singleton_warning", "T4": "singleton_warning"}


def test_health_counts_ids_in_warnings(df):
    """The share of ids in sub-clusters of status singleton_warning decides, not the number of small sub-clusters."""
    r = df([(c, f"T{i}") for c in "abcde" for i in range(10)], "cluster_name string, theory_id string")
    a = [("a", 1, "ok", f"T{i}") for i in range(5)] + [("a", 2, "singleton_warning", f"T{i}") for i in range(5, 10)]
    a += [("b", 1, "ok", f"T{i}") for i in range(7)] + [("b", 2, "singleton_warning", f"T{i}") for i in range(7, 10)]
    a += [("c", 1, "ok", f"T{i}") for i in range(9)] + [("d", i, "ok", f"T{i}") for i in range(11)]
    got = {x.cluster_name: x for x in quality.health(r, df(a, "cluster_name string, sub int, status string, theory_id string")).collect()}
    assert {k: v.severity for k, v in got.items()} == {"a": "warning", "b": "ok", "c": "critical", "d": "critical", "e": "critical"}
    assert (got["a"].warnings, got["a"].in_warnings, got["a"].rate, got["c"].missing, got["d"].extra, got["e"].assigned) == (1, 5, 0.5, 1, 1, 0)


def test_ward_in_rounds_is_ward_in_one_task(df, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (6, 4))
    data = [(int(i), "a" if i < 90 else "b", [float(x) for x in centres[i % 6] + rng.normal(0, 0.4, 4)]) for i in range(120)] + [(500, "a", None)]
    frame = df(data, "k bigint, g string, v array<double>")
    want = rows(vectors.ward(frame, "k", "v", 2.5, group="g"))
    monkeypatch.setattr(vectors, "WARD_MOST", 40)
    monkeypatch.setattr(vectors, "SLICE", 50)
    got = rows(vectors.ward(frame, "k", "v", 2.5, group="g"))
    assert got == want and len(want) == 120 and 2 <= len({r[2] for r in want if r[0] == "a"}) <= 20


def test_small_clusters_move_as_a_whole(df):
    """The mean of a small cluster decides: its members stay together, although they are nearest to different large ones."""
    big = [(f"a{i}", "A", [1.0, 0.01 * i]) for i in range(5)] + [(f"b{i}", "B", [0.01 * i, 1.0]) for i in range(5)]
    small = [("s1", "s", [1.0, 0.2]), ("s2", "s", [0.1, 1.0]), ("s3", "s", [1.0, 0.1]), ("n", "lone", None)]
    got = dict(map(tuple, vectors.absorb_small(df(big + small, "k string, c string, v array<double>"), "k", "v", "c").collect()))
    assert [got[k] for k in ("s1", "s2", "s3", "n", "a0", "b0")] == ["A", "A", "A", "lone", "A", "B"]
    few = dict(map(tuple, vectors.absorb_small(df(small, "k string, c string, v array<double>"), "k", "v", "c").collect()))
    assert few == {"s1": "s", "s2": "s", "s3": "s", "n": "lone"}


def test_only_bracketed_abbreviations_count(df):
    todo = df([("MLT",), ("Mind Loss [MLT]",), ("X (ab)",)], "name string")
    listed = df([(1, "c", "s", "Mortar Loss Theory", [], ["MLT"]), (2, "c", "s", "Moral Loss Theory", ["Mortar Loss"], [])], ONTOLOGY_SCHEMA)
    assert rows(matching.match_abbreviation(todo, listed)) == [("Mind Loss [MLT]", "Mortar Loss Theory", "MLT")]
    # the fuzzy key of the nearest alias belongs to the last entry that has it
    near = matching.match_names(df([("Mortar Los Theory",)], "name string"), listed).first()
    assert (near.alias, near.canonical, near.match_type) == ("Mortar Loss Theory", "Moral Loss Theory", "high_confidence") and near.reasoning == "Very high fuzzy score (97.1) indicates strong match despite minor variations"
    none = matching.match_names(todo, df([], ONTOLOGY_SCHEMA)).collect()
    assert len(none) == 3 and {(x.matched, x.reasoning) for x in none} == {(False, "No similar theory found in ontology")}


def test_recluster_conserves(df):
    asked = df([("c", f"T{i}") for i in range(9)], "cluster_name string, theory_id string")

    def by_half(batches):
        for pdf in batches:
            yield pdf.assign(subcluster_name=(pdf.theory_id.str[1:].astype(int) // 4).astype(str))

    got = annotate.recluster(asked, by_half)
    assert tuple(quality.conservation(asked, got, "theory_id").first()) == (0, 0, 0)
    assert got.where("status <> 'ok'").count() == 1


def test_keywords(df):
    got = annotate.keywords(df([(1, "telomere attrition drives telomere attrition in cells"), (2, None)], "k int, t string"), "k", "t", k=3)
    assert "telomere attrition" in [r.keyword for r in got.collect()] and {r.key for r in got.collect()} == {1}


def test_consolidation(df):
    m = df([("T1", "n", "o1", "d1", 7), ("T2", "n", "o2", "d1", 7), ("T3", "m", "o3", "d1", 2), ("T4", "m", None, "d2", 3), ("T5", None, "o", None, None)], "theory_id string, name string, original_name string, doi string, paper_focus int")
    assert rows(consolidate.low_focus_docs(m)) == [("d2",)]
    assert rows(consolidate.owners(m.where("doi is not null").select("name", "doi"))) == [("d1", "n"), ("d2", "m")]
    assert rows(consolidate.final_map(m)) == [("m", "d1")]  # d2 has a low focus; both names then own d1 alone, and the first name wins
    s = {r.name: r for r in consolidate.summary(m.where("name is not null"), "name").collect()}
    assert s["n"].theory_ids == ["T1", "T2"] and s["m"].original_names == ["o3"] and s["m"].total_papers == 2
    assert s["n"].dois == ["d1", "d1"] and [r.name for r in consolidate.summary(m.where("name is not null"), "name").collect()] == ["m", "n"]
    both = consolidate.merged_summary(df([("a", ["T3", "T1"]), ("b", ["T2", "T1", "T9"]), ("c", ["T5"])], "name string, theory_ids array<string>"), df([("a", "x"), ("b", "x")], "name string, mapped string"))
    assert [(r.name, r.theory_ids, r.total_papers) for r in both.collect()] == [("x", ["T2", "T1", "T9", "T3"], 4), ("c", ["T5"], 1)]
    out, changes = consolidate.overruled(df([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("k", None, 4), ("j", "b", 5)], "k string, v string, o int"), "k", "v", "o")
    assert {(r.o, r.v, r.note) for r in out.collect()} == {(1, "a", None), (2, "a", None), (3, "a", "was b"), (4, None, None), (5, "b", None)} and rows(changes) == [("k", 1)]
    assert len(consolidate.tops(m.where("doi is not null"), "doi", "paper_focus").collect()) == 3
    v = consolidate.majority(df([("k", "b", 2), ("k", "a", 1), ("k", None, 0), ("j", "x", 5)], "k string, v string, o int"), "k", "v", "o")
    assert {r.k: r.v for r in v.collect()} == {"k": "a", "j": "x"}
    g = consolidate.split_by_size(df([(1,), (2,), (3,), (6,)], "n int"), "n", 7)
    assert [r.role for r in g.orderBy("n").collect()] == ["rare", "between", "reference", "reference"]


def test_lineage(df):
    e = df([("T1", "FRT", 1, None), ("T2", "odd name", 1, "high"), ("T2", "odd name", 2, "high"), ("T3", None, 1, None)], "theory_id string, original_name string, ingested_at int, confidence_is_theory string").selectExpr("*", "'d' AS doi", "'m' AS mode", "1 AS paper_focus")
    listed = df([("Free Radical Theory",)], "name string")
    r = lineage.seed(e)
    assert r.count() == 3
    r = lineage.stage(r, "one", df([("T1", "Free Radical Theory")], "theory_id string, v string"), listed, "theory_id", "v")
    r = lineage.stage(r, "two", df([("odd name", "Odd Name")], "name string, v string"), listed, "name", "v", fallback="original_name")
    out = {x.theory_id: x for x in lineage.verdict(r, df([("Odd Name", "valid", True, "Unknown")], "original_name string, is_valid_theory string, is_listed boolean, listed_name string"), listed).collect()}
    assert (out["T1"].one_status, out["T1"].two_status, out["T1"].final_status) == ("completed", "skipped", "valid")
    assert (out["T2"].two_name, out["T2"].last_status, out["T2"].final_status) == ("Odd Name", "warning", "valid")
    assert out["T3"].name_warning and out["T3"].final_status == "unknown"


def test_quality(df):
    sizes = df([(n,) for n in (1, 1, 2, 5, 7, 50, 200)], "n int")
    assert {r.bucket: r.groups for r in quality.size_histogram(sizes, "n").collect()} == {"1-5": 4, "6-10": 1, "41-100": 1, ">100": 1}
    p = quality.at_share(sizes, "n", 0.25, 0.5, 0.75).first()
    assert (p.p25, p.p50, p.p75, p.max, p.min, p.n) == (1, 5, 50, 200, 1, 7)
    a, b = df([("x",), ("y",)], "k string"), df([("y",), ("y",), ("z",)], "k string")
    assert tuple(quality.conservation(a, b, "k").first()) == (1, 1, 1) and not quality.same_keys(a, b, "k").first()[0]


def test_qa(df):
    docs = df([("d1", "Old BATS fly"), ("d2", None)], "doi string, text string")
    q = df([("q1", ["bats"]), ("q2", [])], "question_name string, keywords array<string>")
    asked = qa.gate(docs, q)
    assert {(r.doi, r.question_name): r.ask for r in asked.collect()} == {("d1", "q1"): True, ("d1", "q2"): True, ("d2", "q1"): False, ("d2", "q2"): True}
    options = df([("q1", ["Yes", "No"]), ("q2", ["Yes", "No"])], "question_name string, options array<string>")
    replies = df([("d1", "q1", "yes, sure", 0.9), ("d1", "q2", "No", None), ("d2", "q2", "perhaps", 0.1)], "doi string, question_name string, answer string, confidence double")
    got = qa.settle(asked, replies, options)
    assert rows(got.select("doi", "question_name", "answer", "confidence_score")) == [("d1", "q1", "Yes", 0.9), ("d1", "q2", "No", 0.0)]
    labels = qa.unpivoted(df([("d1", "Yes", "Yes", "?")], "doi string, `Q1: a` string, `Q2: b` string, other string"), {"Q1: a": "q1", "Q2: b": "q2"})
    acc = {(r.question_name, r.doi): r.accuracy for r in qa.accuracy(labels, got).collect()}
    assert acc[(None, None)] == 0.5 and acc[("q1", None)] == 1.0
    docs_, lone = qa.unscored(labels, got.where("question_name = 'q1'"))
    assert docs_.isEmpty() and rows(lone.select("question_name")) == [("q2",)]


def test_vectors(df):
    v = df([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.2]), (3, 1, [0.0, 1.0]), (4, 2, [0.1, 1.0]), (5, 1, None)], "id int, c int, v array<double>")
    m = {r.c: r for r in vectors.means(v, "c", "v").collect()}
    assert m[0].mean == [1.0, 0.1] and m[1].size == 1
    assert {r.id: r.c for r in vectors.absorb_small(v.where("v is not null"), "id", "v", "c", 2).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    top = vectors.most_similar(v, "id", "v", v.where("id = 1"), 1).collect()
    assert [(r.query, r.id) for r in top] == [(1, 2)]


def test_ward_against_brute_force(df):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.2, (6, 3)) for c in (0, 3, 6)])

    def brute(x, cutoff):
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            best = min(((2 * len(a) * len(b) / (len(a) + len(b))) ** 0.5 * float(np.linalg.norm(x[a].mean(0) - x[b].mean(0))), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if best[0] > cutoff:
                break
            groups[best[1]] += groups.pop(best[2])
        return {frozenset(g) for g in groups}

    for cutoff in (0.3, 1.8, 20.0):
        labels = vectors.ward_labels(x, cutoff)
        assert {frozenset(np.flatnonzero(labels == k)) for k in set(labels.tolist())} == brute(x, cutoff)


def test_skewed_join_and_aggregate(df, spark):
    left = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"), F.lit("l").alias("tag"))
    right = left.where("k is not null").groupBy("k").agg(F.lit("r").alias("tag"))
    plain = left.join(right.withColumnRenamed("tag", "tag_right"), "k", "left")
    assert rows(skew.skew_join(left, right, "k", how="left").select("k", "v", "tag", "tag_right")) == rows(plain.select("k", "v", "tag", "tag_right"))
    assert [r.k for r in skew.heavy_keys(left, "k").collect()] == ["hot"]
    got = skew.balanced_aggregate(left, "k", lambda: [F.count(F.lit(1)).alias("n")], lambda: [F.sum("n").alias("n")], F.col("v"))
    assert rows(got) == rows(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert skew.heavy_keys(left.limit(0), "k").isEmpty()
    with pytest.raises(ValueError):
        skew.skew_join(left, right, "k", how="full")


BATCH = "batch_id bigint, cluster_name string, batch_result struct<subclusters:array<struct<subcluster_name:string,theory_ids:array<string>>>>, extra int"


def test_cluster_report(df):
    b = df(
        [(1, "a", ([("s", ["T1", "T2", None, ""]), None, ("s", None), ("t", ["T1"])],), 0), (2, "b", ([("s", ["T9"])],), 0), (3, None, ([("s", ["T5"])],), 0), (4, "c", None, 0), (5, "d", (None,), 0)], BATCH
    )
    assert {r.cluster_name: (r.subclusters, r.ids, r.distinct_ids) for r in skew.cluster_report(b).collect()} == {"a": (2, 3, 2), "b": (1, 1, 1), None: (1, 1, 1)}
    assert sorted(r.cluster_name for r in skew.dominant_clusters(b).collect()) == ["a", "b"]
    assert skew.dominant_clusters(b.limit(0)).isEmpty() and skew.cluster_report(b.limit(0)).isEmpty()
