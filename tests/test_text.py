import json

from pyspark.sql import functions as F

from corvane.functions import text


def one(df, value, f):
    return df([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_clean_text(df):
    raw = "Café  naïve\n\n\n\nsee http://x.org/a?b=1 and me@x.org\n 12 \nDOI: 10.1/x end\nFigure 2.\nlast"
    assert one(df, raw, text.clean_text) == "Cafe naive\n\nsee and \n end\nlast".replace("see and", "see  and")
    assert one(df, None, text.clean_text) == "" and one(df, "", text.clean_text) == ""


def test_references_by_header_and_by_density():
    assert text.cut_references("body\nReferences\n[1] a\n") == "body"
    refs = "\n".join(f"[{i}] Someone. Title. (2001)" for i in range(10))
    kept = text.cut_references("one\ntwo\nthree\n" + refs)
    assert kept.startswith("one") and "[9]" not in kept
    assert text.cut_references(None) == ""


def test_sections():
    assert text.join_sections(json.dumps({"Methods": "m", "Results": "r", "Abstract": "a"})) == "Abstract\na\n\nResults\nr\n\n"
    assert text.join_sections(json.dumps(["a", {"x": "b", "y": 1}])) == "a\n\nb"
    assert text.join_sections("{broken") == "" and text.join_sections("{}") == "" and text.join_sections(None) == ""
    assert text.join_sections(json.dumps({"Full text": "x" * 50000})) == "x" * 40000 + "\n"
    long = text.join_sections(json.dumps({"Abstract": "a" * 5000, "Other": "b" * 30000, "Discussion": "c" * 30000}))
    assert len(long) <= 20000 and "\n[...]\n" in long and long.startswith("Abstract\n")
    assert len(text.join_sections(json.dumps({"A": "a" * 30000, "B": "b" * 30000}), reduce=False)) == 60000 + 8


def test_preprocessed(df):
    rows = df([("f" * 200, None, None), ("short", None, None), (None, json.dumps({"Intro": "i" * 200}), "abs"), (None, None, "abs")], "f string, s string, a string")
    got = [r[0] for r in rows.select(text.preprocessed(F.col("f"), F.col("s"), F.col("a"))).collect()]
    assert got[0] == "f" * 200 and got[1] is None and got[2].startswith("Abstract\nabs\n\nIntro\n") and got[3] is None


def test_fences_tokens_and_enrichment(df):
    assert one(df, '```json\n{"a": 1}\n```', text.unfenced) == '{"a": 1}'
    assert one(df, ' {"a": 1} ', text.unfenced) == '{"a": 1}'
    assert one(df, "x" * 9, lambda c: text.token_estimate(c, 5)) == 7
    row = df([("N", [("c", "d"), (None, "x"), ("e", None)], " ")], "n string, k array<struct<concept:string,description:string>>, d string")
    assert row.select(text.enriched_text(F.col("n"), F.col("k"), F.col("d"))).first()[0] == "N. c: d | e: "
