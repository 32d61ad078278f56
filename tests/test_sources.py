import json
import sqlite3

from pyspark.sql import functions as F

from corvane.sources import readers, sinks


def write(path, obj):
    path.write_text(obj if isinstance(obj, str) else json.dumps(obj))
    return str(path)


def test_extraction_and_precedence(spark, tmp_path):
    doc = {"metadata": {}, "results": [{"doi": "a", "theories": [{"name": "x", "key_concepts": [{"concept": "c"}]}, {"name": "y"}]}, {"doi": "b", "theories": []}, {"doi": None, "theories": [{"name": "z"}]}]}
    rows = readers.extraction_results(spark, write(tmp_path / "e.json", doc))
    assert [(r.paper_pos, r.theory_pos, r.doi, r.name) for r in rows.orderBy("paper_pos", "theory_pos").collect()] == [(0, 0, "a", "x"), (0, 1, "a", "y"), (2, 0, None, "z")]
    second = spark.createDataFrame([("a", "lost"), ("c", "kept"), (None, "lost too")], "doi string, name string")
    got = readers.with_precedence(rows.select("doi", "name"), second, "doi")
    assert sorted(r.name for r in got.collect()) == ["kept", "x", "y", "z"]


def test_surrogate_ids(spark):
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7)
    got = readers.surrogate_ids(rows, "k").orderBy("k").collect()
    assert [r.surrogate_id for r in got] == [f"T{i:06d}" for i in range(1, 1001)]


def test_lists_questions_and_ontologies(spark, tmp_path):
    dois = readers.doi_list(spark, write(tmp_path / "d.txt", "# c\n 10.1/a \n\n10.1/b\n10.1/a\n"))
    assert [(r.pos, r.doi) for r in dois.orderBy("pos").collect()] == [(1, "10.1/a"), (3, "10.1/b")]
    q = readers.questions(spark, write(tmp_path / "q.json", {"q1": {"question": "?", "answers": "Yes, shown / No"}})).first()
    assert (q.question_name, q.options) == ("q1", ["Yes, shown", "No"])
    assert readers.synonyms(spark, None).isEmpty()
    tree = {"TheoriesOfAging": {"Cat": {"Sub": [{"name": "N1", "aliases": ["A"], "abbreviations": ["AB"]}, {"name": "N2", "aliases": [], "abbreviations": []}]}}}
    path = write(tmp_path / "o.json", tree)
    assert [(r.category, r.subcategory, r.name) for r in readers.alias_ontology(spark, path).orderBy("pos").collect()] == [("Cat", "Sub", "N1"), ("Cat", "Sub", "N2")]
    assert sorted(r.name for r in readers.ontology_names(spark, path).collect()) == ["N1", "N2"]
    mech = readers.mechanism_ontology(spark, write(tmp_path / "m.json", [{"theory_name": "T", "mechanisms": ["m"]}])).first()
    assert mech.theory_name == "T" and mech.pathways is None


def test_sqlite_source_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE e (doi TEXT, result TEXT, score INT)")
        con.executemany("INSERT INTO e VALUES (?, ?, ?)", [(f"d{i}", "valid" if i % 2 else None, i) for i in range(100)])
    t = readers.sqlite_table(spark, path, "e", "doi string, result string, score int", partitions=3)
    assert t.count() == 100
    got = t.where((F.col("result") == "valid") & (F.col("score") >= 90) & F.col("doi").isin("d91", "d92", "d95")).orderBy("doi").collect()
    assert [r.doi for r in got] == ["d91", "d95"]


def test_files(spark, tmp_path):
    for n, name in (("10.1_a.json", "x"), ("10.1_b.json", "y")):
        write(tmp_path / n, {"q": {"answer": name, "confidence": 0.5, "reasoning": ""}})
    assert sorted((r.doi, r.answer) for r in readers.answers_of_files(spark, f"{tmp_path}/*.json").collect()) == [("10.1/a", "x"), ("10.1/b", "y")]
    left = readers.files_without(spark, str(tmp_path), spark.createDataFrame([("10.1/A",)], "doi string"))
    assert [r.doi for r in left.collect()] == ["10.1/b"]
    batch = {"cluster_name": "c", "batch_num": 1, "batch_result": {"subclusters": [{"subcluster_name": "s", "theory_ids": ["T1"]}]}}
    (tmp_path / "b").mkdir()
    write(tmp_path / "b" / "c_1.json", batch)
    assert readers.checkpoint_files(spark, f"{tmp_path}/b/*.json").first().file_name == "c_1.json"
    stage = readers.stage_rows(spark, write(tmp_path / "s.out", {"theories": [{"theory_id": "T1", "name": "n"}, {"theory_id": ""}]}), "theories", "STRUCT<theory_id: STRING, name: STRING>", "theory_id")
    assert [r.theory_id for r in stage.collect()] == ["T1"]


def test_upserts(df):
    old = df([("a", 1), ("b", 2)], "k string, v int")
    new = df([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert_parents(old, new, "k", F.col("v")).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, sinks.insert_or_ignore(old, df([("b", 3), ("c", 5), ("c", 4)], "k string, v int"), ["k"], F.col("v")).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, sinks.insert_or_replace(old.unionByName(new), ["k"], F.desc("v")).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    children = df([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "p string, n string, v int")
    fresh = df([("a", "z", 9), ("a", "z", 8)], "p string, n string, v int")
    assert sorted(map(tuple, sinks.replace_children(children, fresh, "p", ["p", "n"], F.col("v")).collect())) == [("a", "z", 8), ("b", "x", 3)]
    assert sinks.evolved(old, df([("z", "t")], "k string, w string")).columns == ["k", "v", "w"]
    assert [r.k for r in sinks.pending(old, new, ["k"]).collect()] == ["a"]


def test_sinks_write(df, tmp_path, spark):
    rows = df([("a,b", 1)], "n string, v int")
    sinks.write_with_metadata(rows, {"n": 1}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/rows")).count() == 1
    sinks.write_csv(rows, str(tmp_path / "c"), plain=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().n == "a;b"
    for form in ("txt", "json", "csv"):
        sinks.write_as(rows, str(tmp_path / form), form, newest="v")
    assert json.loads(sinks.as_json(df([(None, 1)], "n string, v int")).first()[0]) == {"n": None, "v": 1}
    nested = sinks.nested_children(df([("p",), ("q",)], "k string"), df([("p", 2), ("p", 1)], "k string, v int"), "k", "c", F.col("v")).orderBy("k").collect()
    assert [[x.v for x in r.c] for r in nested] == [[1, 2], []]
    sinks.write_batches(df([("a/b c", 1, "x")], "cluster_name string, batch_num int, v string"), str(tmp_path / "b"))
    assert (tmp_path / "b" / "cluster_key=a_b_c").exists()
    lines = sinks.missing_report(df([("c", "T2", 0.5), ("c", "T1", 0.5)], "cluster_name string, theory_id string, share double"))
    assert [r.line for r in lines.collect()] == ["c\t50.0 %\tT1", "c\t50.0 %\tT2"]
