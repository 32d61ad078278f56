import zlib

import pandas as pd
from pyspark.sql import functions as F

from corvane.operators import annotate, annotators, quality
from corvane.plans import cascade


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_extract(df):
    papers = df([("d1", "t", "x" * 30000), ("d2", "t", "y"), ("d3", "t", None)], "doi string, title string, text string")

    def reply(batches):
        for pdf in batches:
            texts = {"d1": '```json\n{"theories": [{"name": "N", "paper_focus": "8/10"}, {"name": "M", "paper_focus": 11}]}\n```', "d2": '{"theories": []}', "d3": "sorry"}
            assert pdf.text.dropna().str.len().max() <= 20000 or pdf.text.dropna().empty
            yield pd.DataFrame({"doi": pdf.doi, "reply": pdf.doi.map(texts)})

    got = annotators.extract(papers, reply).select("doi", "status", "theory_pos", "name", "paper_focus")
    assert rows(got) == [("d1", "ok", 0, "N", 8), ("d1", "ok", 1, "M", 10), ("d2", "ok", None, None, 0), ("d3", "error", None, None, None)]


def test_validation_and_mapping(df):
    m = df([("T1", "ab", "medium"), ("T2", "long name", "medium"), ("T3", "x", "high"), ("T4", "y", None)], "theory_id string, name string, confidence_is_theory string")
    got = {r.theory_id: r.is_validated for r in annotators.validate_medium(m, annotators.rule_valid).collect()}
    assert got == {"T1": False, "T2": True, "T3": True, "T4": True}
    mapped = annotators.map_names(df([("wear of ageing",), ("x",)], "name string"), annotators.rule_key)
    assert rows(mapped.select("name", "mapped")) == [("wear of ageing", "Wear"), ("x", "X")]

    def silent(batches):
        for _ in batches:
            yield pd.DataFrame({"name": [], "mapped": [], "confidence": []}).astype({"name": str, "mapped": str})

    assert rows(annotators.map_names(df([("a",)], "name string"), silent).select("name", "mapped")) == [("a", "a")]
    assert rows(annotators.map_names(df([("a",)], "name string"), silent, identity=False).select("name", "mapped")) == [("a", None)]


def test_doubted_names_become_invalid(df):
    r = df([("sure", "T1", "e"), ("doubt", "T2", None), ("doubt", "T3", "z" * 900)], "name string, theory_id string, evidence string")

    def judge(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf.name, "verdict": pdf.name.map({"sure": "valid", "doubt": "doubted"}), "reason": "r", "listed_name": None})

    assert rows(annotators.validate_names(r, judge).select("name", "verdict")) == [("doubt", "invalid"), ("sure", "valid")]


def test_refine_rare(df):
    members = df([("c", "Ref", "reference"), ("c", "a", "rare"), ("c", "b", "rare"), ("c", "x", "rare"), ("d", "lone", "rare")], "cluster string, name string, role string")

    def reply(batches):
        for pdf in batches:
            table = {"a": ("map", "Ref"), "b": ("map", "Nowhere"), "x": ("assign_common", "Common"), "lone": ("odd", "y")}
            yield pd.DataFrame({"cluster": pdf.cluster, "name": pdf.name, "strategy": [table[n][0] for n in pdf.name], "mapped": [table[n][1] for n in pdf.name], "confidence": 1.0})

    got = annotators.refine_rare(members, reply)
    assert rows(got.select("name", "mapped", "strategy")) == [("a", "Ref", "map"), ("b", "b", "retain"), ("lone", "lone", "retain"), ("x", "Common", "assign_common")]


def test_prompts(df):
    p = annotators.numbered_prompt(df([(1, "b"), (1, "a"), (2, None)], "batch int, name string"), "batch", "name").orderBy("batch")
    assert [r.prompt for r in p.collect()] == ["1. a\n2. b", "1. "]
    assert df([("abcd",)], "x string").select(annotators.request_size(F.struct("x"), 0)).first()[0] == 3


def test_cascade_conserves(spark, data):
    lost = cascade.naming_cascade_conserves(spark, data).first()
    assert lost.extra == 0 and lost.duplicates == 0


def test_cascade_matches_fuzzily_and_gathers(df):
    listed = df([(1, "Mitochondrial Free Radical Theory", [], [])], "ontology_id bigint, name string, aliases array<string>, abbreviations array<string>")
    m = df([("T1", "Mitochondrial Free Radicals Theory"), ("T2", "Something Else Entirely")], "theory_id string, name string")
    got = {r.theory_id: (r.name, r.stage) for r in cascade.named(m, listed).collect()}
    assert got == {"T1": ("Mitochondrial Free Radical Theory", "matched"), "T2": ("Something Else Entirely", "refined")}
    names = ["Damage Accrual"] * 3 + ["Accrual Burden"] + ["Accrual Spread"] * 2 + ["Lone Wolf"]
    rows = df([(f"T{i}", n, n) for i, n in enumerate(names)], "theory_id string, original string, name string")
    got = {r.original: r.name for r in cascade.gathered(rows).collect()}
    assert got == {"Damage Accrual": "Damage Accrual", "Accrual Burden": "Damage Accrual", "Accrual Spread": "Accrual Spread", "Lone Wolf": "Lone Wolf"}


def test_split_batches_ask_whole_batches_again(df):
    """A batch with made-up ids, or with lone ids only, is asked again; ids left alone in a good one fail."""
    asked = df([("c", 1, f"T{i}") for i in range(5)] + [("c", 2, f"U{i}") for i in range(4)] + [("d", 1, f"V{i}") for i in range(3)], "cluster_name string, batch int, theory_id string")

    def rule(batches):
        for pdf in batches:
            out = pdf.assign(subcluster_name="x")
            if pdf.theory_id.iloc[0] == "U0":
                yield out.assign(theory_id=out.theory_id.str.replace("U3", "made up"))
            elif pdf.cluster_name.iloc[0] == "d":
                yield out.assign(subcluster_name=out.theory_id)
            else:
                doubled = out[out.theory_id == "T0"].assign(subcluster_name="y")
                yield pd.concat([out.assign(subcluster_name=out.theory_id.map(lambda t: "z" if t == "T4" else "x")), doubled])

    good, failed = annotate.split_batches(asked, rule)
    assert {(r.batch, r.theory_id, r.subcluster_name) for r in good.collect()} == {(1, f"T{i}", "x") for i in range(4)}
    assert sorted(r.theory_id for r in failed.collect()) == ["T4", "U0", "U1", "U2", "U3", "V0", "V1", "V2"]


def test_failed_ids_are_reclustered_with_similar_subclusters(df):
    asked = df([("c", f"T{i:02d}") for i in range(20)], "cluster_name string, theory_id string")
    concepts = df([(f"T{i:02d}", w) for i in range(20) for w in (["wear"] if i < 8 or i == 19 else ["tear"] if i < 14 else ["care"])], "theory_id string, concept string")

    def rule(batches):
        for pdf in batches:
            n = pdf.theory_id.str[1:].astype(int)
            first = (n // 5).astype(str).where(n < 19, "lone")
            again = "m" + (n % 2).astype(str)  # together with earlier sub-clusters the lone one finds company
            yield pdf.assign(subcluster_name=again if (pdf.batch < 0).all() else first)

    got = annotate.recluster(asked, rule, concepts)
    assert tuple(quality.conservation(asked, got, "theory_id").first()) == (0, 0, 0)
    assert got.where("status <> 'ok'").isEmpty() and got.where("subcluster_name LIKE 'm%'").count() >= 3
    alone = annotate.recluster(asked.limit(1), rule, concepts)
    assert [(r.subcluster_name, r.status) for r in alone.collect()] == [("c", "singleton_warning")]


def test_grouping_knows_earlier_groups_and_keeps_extra_names(df):
    rows = df([(1, "Wear Theory"), (1, "tear"), (2, "wear and more"), (2, "care"), (3, ""), (3, None)], "batch int, name string")

    def rule(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.name == "Wear Theory":
                    yield pd.DataFrame({"batch": [r.batch, r.batch], "name": [r.name, "unasked"], "mapped": ["Wear", "Extra"]})
                elif r.name == "wear and more":
                    yield pd.DataFrame({"batch": [r.batch], "name": [r.name], "mapped": [list(r.groups)[0] if r.groups is not None and len(r.groups) else "none known"]})

    got = {r.name: (r.mapped, r.extra) for r in annotators.group_names(rows, rule, rounds=2).collect()}
    assert got == {"Wear Theory": ("Wear", False), "unasked": ("Extra", True), "tear": ("tear", False), "wear and more": ("Wear", False), "care": ("care", False)}
    assert annotators.group_names(rows.limit(0), rule).isEmpty()


def test_grouping_has_all_earlier_groups_at_hand_without_writing_them_out(spark, df):
    """Each name has all earlier groups with a common word, in order, though what is shuffled grows with the names and not with their pairs."""
    named = {f"tissue é{i % 7} n{i:04d}" if i % 3 else f"own{i:04d} é{i % 7}": 1 + i // 750 for i in range(3000)}
    rows = df([(b, n) for n, b in named.items()], "batch int, name string")

    def first(batches):
        for pdf in batches:
            yield pd.DataFrame({"batch": pdf.batch, "name": pdf.name, "mapped": [next(iter(g)) if g else n for n, g in zip(pdf.name, pdf.groups, strict=True)]})

    def every(batches):
        for pdf in batches:
            few = pdf[pdf.name.str.endswith("00")]
            yield pd.DataFrame({"batch": few.batch, "name": few.name, "mapped": [f"{len(g)}:{zlib.crc32("|".join(g).encode())}" for g in few.groups.map(lambda g: [] if g is None else list(g))]})

    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert annotators.group_names(rows, first).count() == len(named)
    assert shuffled() - before < 400 * len(named)
    got = {r.name: r.mapped for r in annotators.group_names(rows, every).collect()}
    assert sorted(got) == sorted(named)
    for name, batch in named.items():
        if not name.endswith("00"):
            assert got[name] == name
        else:
            g = sorted(n for n, b in named.items() if b < batch and n.startswith("tissue") and not n.endswith("00")) if name.startswith("tissue") else []
            assert got[name] == f"{len(g)}:{zlib.crc32("|".join(g).encode())}", name


def test_rare_names_are_asked_again_by_cluster(df):
    """Poor grouping is asked again; an incomplete second reply leaves the first one, with the rest retained."""
    members = df([("a", f"n{i}", "rare") for i in range(5)] + [("b", "m0", "rare"), ("b", "m1", "rare"), ("b", "ref", "reference")], "cluster string, name string, role string")

    def rule(batches):
        for pdf in batches:
            keep = pdf[pdf.name != "m1"]
            mapped = ["ref" if c == "b" else "common" if n in ("n0", "n1") and p == "map" else n + "!" for c, n, p in zip(keep.cluster, keep.name, keep.prefer, strict=True)]
            yield pd.DataFrame({"cluster": keep.cluster, "name": keep.name, "strategy": ["map" if c == "b" else "assign_common" for c in keep.cluster], "mapped": mapped, "confidence": 0.5})

    got = {(r.cluster, r.name): (r.mapped, r.strategy) for r in annotators.refine_rare(members.coalesce(1), rule, retry_poor=True).collect()}
    assert got[("b", "m0")] == ("ref", "map") and got[("b", "m1")] == ("m1", "retain") and got[("a", "n0")] == ("n0!", "assign_common")
    assert {r.mapped for r in annotators.refine_rare(members, rule, prefer="map").where("cluster = 'a'").collect()} == {"common", "n2!", "n3!", "n4!"}


def test_questions_are_asked_until_all_answers_hold(df):
    papers = df([("d1", "t", "old mice", "mice age"), ("d2", "t", "abstract on mice", None), ("d3", "bad", "mice", "mice"), ("d4", "t", None, None), (None, "t", "x", "x")], "doi string, title string, abstract string, text string")
    q = df([("q1", ["mice"], ["Yes", "No"]), ("q2", ["bats"], ["Yes", "No"])], "question_name string, keywords array<string>, options array<string>")

    def rule(batches):
        for pdf in batches:
            said = {"d1": "yes, in part", "d2": "Not available", "d3": "maybe"}
            yield pd.DataFrame({"doi": pdf.doi, "question_name": pdf.question_name, "answer": pdf.doi.map(said), "confidence": 0.7, "reasoning": None})

    got = {(r.doi, r.question_name): (r.answer, r.confidence_score, r.original_answer) for r in annotators.answer_questions(papers, q, rule).collect()}
    assert got == {
        ("d1", "q1"): ("Yes", 0.7, "yes, in part"), ("d1", "q2"): ("No", 1.0, None), ("d2", "q1"): ("Not available", 0.7, None), ("d2", "q2"): ("No", 1.0, None),
        ("d4", "q1"): ("No", 1.0, None), ("d4", "q2"): ("No", 1.0, None),
    }


def test_prompts_and_keywords(df):
    rows = df([("b", "n2", 1, [("c1", "x"), ("c2", None), ("c3", "z"), ("c4", "w")], "e" * 600), ("b", "n1", 1, [], "short"), ("b", "n1", 2, None, None)], "batch string, name string, rank int, concepts array<struct<concept:string,description:string>>, evidence string")
    text = annotators.judging_prompt(rows, evidence=True).first().prompt
    assert text.startswith("## UNIQUE NAME 1: n1\n### V.1:\n  (No key concepts available)\nEvidence: short\n### V.2:") and "## UNIQUE NAME 2: n2" in text
    assert "c3: z" in text and "c4" not in text and "e" * 500 + "..." in text and "e" * 501 not in text
    key = lambda *ws: df([("k", w) for w in ws], "key string, keyword string")
    scored = df([("k", "Alpha", 0.9), ("k", "beta", 0.3), ("k", "gamma", 0.99)], "key string, keyword string, score double")
    got = {r.keyword: r.score for r in annotate.merge_keywords(scored, key("alpha", "BETA"), key("gamma", "delta"), key("delta", "")).collect()}
    assert got == {"alpha": 0.9, "beta": 0.85, "gamma": 0.95, "delta": 0.9}


def test_groups_and_lanes(df):
    got = annotate.in_groups(df([(i,) for i in range(120)], "i int"), "i", size=50, workers=10).collect()
    assert {(r.group, r.slot) for r in got if r.i in (0, 9, 10, 49, 50, 119)} == {(1, 1), (1, 10), (2, 1), (3, 10)}
    assert annotate.bounded(df([(i,) for i in range(40)], "i int"), lambda b: b, "i int", workers=3).rdd.getNumPartitions() == 3
