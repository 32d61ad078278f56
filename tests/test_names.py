import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import names, similarity
from corvane.operators import matching
from corvane.plans import catalogue


def column(df, values, f, kind="string"):
    rows = df([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_fuzzy_key(df):
    got = column(df, ["The Free-Radical Theory (FRT) of Aging", "Hayflick's limit hypothesis", "Aging Theory", None, "  Models of  cellular X "], names.fuzzy_key)
    assert got == ["free radical", "hayflick limit", "", None, "x"]


def test_grouping_and_title_case(df):
    assert column(df, ["rate-of-living theory's x2y (ROL) of ageing", None], names.grouping_key) == ["Rate-Of-Living Theory'S X2Y", None]


def test_final_name(df):
    got = column(df, ["Hallmarks of Ageing", "Wear Theory of  ageing", "SINE Retrotransposon Activation Theory", ""], names.final_name)
    assert got == ["Hallmarks of aging", "Wear Theory", "Retrotransposon Activation Theory", ""]


def test_voting_clustering_batch_and_files(df):
    assert column(df, [" Insulin  Signalling.. "], names.voting_key) == ["Insulin Signaling"]
    assert column(df, ["The Wear-and-Tear Theory!"], names.clustering_key) == ["wearandtear"]
    assert column(df, ["X (Batch 3)", "X (batch 3) y"], names.strip_batch_suffix) == ["X", "X (batch 3) y"]
    assert column(df, ["a/b c: d"], names.file_name) == ["a_b_c_d"]
    assert column(df, ["/x/10.1_abc.json"], names.doi_of_file) == ["10.1/abc"]
    assert column(df, [" https://doi.org/10.1/A ", "", None], names.doi_key) == ["10.1/a", None, None]


@pytest.mark.parametrize(
    "label, level",
    [("high (established theory)", "high"), ("medium-high", "medium"), ("low to medium", "low"), ("low-high", "low"), ("", "unknown"), (None, "unknown"), ("classical", "high"), ("High", "high"), ("n/a", "unknown")],
)
def test_confidence_levels(df, label, level):
    assert column(df, [label], names.confidence_level) == [level]


def test_focus(df):
    assert column(df, ["9", "9.7", "8/10", "n/a", "15", "-2", None], names.focus) == [9, 9, 8, 0, 10, 2, 0]


def test_abbreviations_and_core_tokens(df):
    assert column(df, ["Free Radical Theory (FRT)", "SMLM", "x (frt)", None], names.abbreviations) == [["FRT"], [], [], None]
    assert column(df, ["The Telomere Shortening Theory of aging by mice"], names.core_tokens) == [["mice", "shortening", "telomere"]]


@pytest.mark.parametrize("answer, option", [("Yes", "Yes"), ("yes, strongly", "Yes"), ("No (not shown)", "No"), ("Yes but weak", "Yes"), ("maybe", None), ("", None), (None, None), ("no", "No")])
def test_answer_options(df, answer, option):
    assert column(df, [answer], lambda a: names.answer_option(a, F.array(F.lit("Yes"), F.lit("No")), F.lit("q"))) == [option]
    if answer == "yes, strongly":
        assert column(df, [answer], lambda a: names.answer_option(a, F.array(F.lit("Yes"), F.lit("No")), F.lit("aging_biomarker"))) == [None]


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abcd ", max_size=90), st.text("abcd ", max_size=90))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == brute(a, b)


def test_documented_ratios():
    assert round(similarity.indel_ratio("dedifferentiation", "dysdifferentiation"), 2) == 91.43
    assert similarity.indel_ratio("mitochondrial", "mitochondria") == 96.0
    assert similarity.indel_ratio("", "") == 100.0 and similarity.indel_ratio(None, "a") is None


def test_vector_and_set_similarity(df):
    row = df([([1.0, 0.0], [1.0, 1.0], ["a", "b"], ["b"]), ([0.0, 0.0], [1.0, 1.0], [], ["b"])], "a array<double>, b array<double>, x array<string>, y array<string>")
    got = row.select(F.round(similarity.cosine(F.col("a"), F.col("b")), 4), similarity.overlap_coefficient(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(0.7071, 1.0), (None, 0.0)]


def test_costly_name_queries_read_the_mentions(spark, data):
    queries = catalogue.queries()
    mentions = {r[0] for r in spark.read.parquet(f"{data}/theory_entries.parquet").select("original_name").distinct().collect()} - {None}
    assert {r.name for r in queries["fuzzy_match_ladder"](spark, data).select("name").collect()} == mentions
    todo = {r.name for r in queries["names_not_listed"](spark, data).collect()}
    assert {r.name for r in queries["similarity_batches"](spark, data).select("name").collect()} == todo
    pairs = queries["alphabetical_neighbours"](spark, data).select("a", "b").collect()
    assert pairs and {n for r in pairs for n in r} <= todo


def test_names_without_core_words_can_be_compared(df):
    rows = df([("the of", "the of"), ("?", "Wear"), ("Wear", "Wear")], "name string, alias string")
    agrees, overlap = matching.compound_agreement("name", "alias")
    assert [tuple(r) for r in rows.select(agrees, overlap).collect()] == [(False, 0.0), (False, 0.0), (True, 1.0)]
