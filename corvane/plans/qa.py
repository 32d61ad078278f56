"""Queries on closed-option answers. Evaluation items stand in for labelled papers: seven in a row are one paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import annotate, qa
from corvane.plans.registry import query
from corvane.session import table
from corvane.sources import sinks

#: The options of a question, by whether it has shades of yes.
SHADES = ["Yes, quantitatively shown", "Yes, but not shown", "No"]
PLAIN = ["Yes", "No"]
LABELS = "(SELECT 'paper' || (item_id // 7)::VARCHAR AS doi, question_name, arg_min(answer, item_id) AS label, min(item_id) AS item_id FROM eval_items GROUP BY 1, 2)"
REPLY = "CASE WHEN item_id % 5 = 0 THEN lower(answer) || ' (see text)' WHEN item_id % 11 = 0 THEN 'No, not shown' ELSE answer END"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").withColumn("doi", F.concat(F.lit("paper"), F.floor(F.col("item_id") / 7).cast("string")))
    return items.groupBy("doi", "question_name").agg(F.min_by("answer", "item_id").alias("label"), F.min("item_id").alias("item_id"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("item_id") % 5 == 0, F.concat(F.lower("label"), F.lit(" (see text)"))).when(F.col("item_id") % 11 == 0, "No, not shown").otherwise(F.col("label"))
    return _labels(spark, d).withColumn("answer", reply)


def _options(question: str):
    return F.when(F.col(question) == "aging_biomarker", F.array(*map(F.lit, SHADES))).otherwise(F.array(*map(F.lit, PLAIN)))


OPTION = """CASE WHEN q = 'aging_biomarker' THEN CASE WHEN a IN ('Yes, quantitatively shown', 'Yes, but not shown', 'No') THEN a END WHEN a IN ('Yes', 'No') THEN a
  WHEN lower(a) LIKE 'yes%' THEN 'Yes' WHEN lower(a) LIKE 'no%' THEN 'No' END"""
ANSWERS = f"(SELECT doi, question_name, label, {OPTION} AS answer FROM (SELECT doi, question_name, label, question_name AS q, trim(CASE WHEN item_id % 5 = 0 THEN lower(label) || ' (see text)' WHEN item_id % 11 = 0 THEN 'No, not shown' ELSE label END) AS a FROM {LABELS}))"
SCORED = "CASE WHEN contains(answer, 'Yes, quantitatively shown') OR contains(answer, 'Yes, but not shown') THEN 'Yes' ELSE answer END"


@query(f"SELECT doi, question_name, answer FROM {ANSWERS}")
def normalised_answers(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("doi", "question_name", names.answer_option(F.col("answer"), _options("question_name"), F.col("question_name")).alias("answer"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    r = _replies(spark, d)
    return r.select("doi", "question_name", names.answer_option(F.col("answer"), _options("question_name"), F.col("question_name")).alias("answer"))


@query(f"SELECT doi, question_name, count(*) AS n, sum(r)::BIGINT AS correct, round(avg(r), 6) AS accuracy FROM (SELECT doi, question_name, CASE WHEN {SCORED} = label THEN 1 ELSE 0 END AS r FROM {ANSWERS}) GROUP BY GROUPING SETS ((), (question_name), (doi))")
def answer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return qa.accuracy(_labels(spark, d), _answers(spark, d)).select("doi", "question_name", "n", "correct", "accuracy")


@query(f"SELECT doi, question_name FROM {ANSWERS} a WHERE answer IS NULL AND doi IN (SELECT doi FROM {ANSWERS} WHERE answer IS NOT NULL)")
def unanswered_labels(spark: SparkSession, d: str) -> DataFrame:
    return qa.unscored(_labels(spark, d), _answers(spark, d).where("answer IS NOT NULL"))[1].select("doi", "question_name")


GATES = [("needs_bats", ["bats", "flying mammals"]), ("needs_quails", ["Quail", "finch"]), ("always", [])]


@query("SELECT doc_id, question_name, CASE question_name WHEN 'needs_bats' THEN contains(lower(coalesce(text, '')), 'bats') OR contains(lower(coalesce(text, '')), 'flying mammals') WHEN 'needs_quails' THEN contains(lower(coalesce(text, '')), 'quail') OR contains(lower(coalesce(text, '')), 'finch') ELSE true END AS ask FROM documents, (VALUES ('needs_bats'), ('needs_quails'), ('always')) v(question_name)")
def keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    gates = spark.createDataFrame(GATES, "question_name string, keywords array<string>")
    return qa.gate(table(spark, d, "documents").select("doc_id", "text"), gates).select("doc_id", "question_name", "ask")


@query(f"SELECT doi, count(*) AS questions, string_agg(question_name || '=' || coalesce(answer, ''), ';' ORDER BY question_name) AS answers FROM {ANSWERS} GROUP BY 1")
def answer_maps(spark: SparkSession, d: str) -> DataFrame:
    """Answers as one map per paper, in the order of questions."""
    a = _answers(spark, d).select("doi", "question_name", "answer", F.lit(1.0).alias("confidence_score"), F.lit("").alias("reasoning"))
    m = sinks.answer_map(a)
    return m.select("doi", F.size("answers").cast("bigint").alias("questions"), F.array_join(F.transform(F.map_entries("answers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["answer"], F.lit("")))), ";").alias("answers"))


@query(f"SELECT a.doi, a.question_name, a.answer, a.label AS correct_answer FROM {ANSWERS} a")
def labelled_export(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a list of papers beside their labels."""
    wanted = table(spark, d, "eval_items").select(F.concat(F.lit("paper"), F.floor(F.col("item_id") / 7).cast("string")).alias("doi")).distinct()
    a = _answers(spark, d).join(wanted, "doi", "left_semi")
    return a.join(_labels(spark, d).select("doi", "question_name", F.col("label").alias("correct_answer")), ["doi", "question_name"], "left")


@query("SELECT item_id, (item_id % 3)::INT AS access_key, CASE WHEN item_id % 9 + 1 = 1 THEN 12 WHEN item_id % 9 + 1 IN (2, 3) THEN 10 WHEN item_id % 9 + 1 IN (4, 5, 6) THEN 8 ELSE 15 END AS chunks FROM eval_items")
def request_plan(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "eval_items")
    return i.select("item_id", annotate.rotated_key(3, F.col("item_id")).alias("access_key"), annotate.chunk_budget(F.col("item_id") % 9 + 1).alias("chunks"))


@query(f"""WITH r AS (SELECT doi, question_name, item_id % 13 <> 0 AS ask, CASE WHEN item_id % 5 = 0 THEN lower(label) || ' (see text)' WHEN item_id % 11 = 0 THEN 'No, not shown' ELSE label END AS original_answer FROM {LABELS}),
s AS (SELECT *, CASE WHEN NOT ask THEN 'No' ELSE (SELECT {OPTION} FROM (SELECT question_name AS q, trim(original_answer) AS a)) END AS answer FROM r)
SELECT doi, question_name, answer, CASE WHEN ask THEN 0.8 ELSE 1.0 END AS confidence_score, original_answer FROM s WHERE doi NOT IN (SELECT doi FROM s WHERE answer IS NULL)""")
def settled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies through gate, options and defaults; papers with an unusable reply are left out."""
    r = _replies(spark, d)
    asked = r.select("doi", "question_name", (F.col("item_id") % 13 != 0).alias("ask"))
    q = r.select("question_name").distinct().withColumn("options", _options("question_name"))
    return qa.settle(asked, r.select("doi", "question_name", "answer", F.lit(0.8).alias("confidence")), q)
