"""Closed-option question answering: which questions to ask, what replies mean, how often they are right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.names import answer_option, scored_answer


#: A questionnaire has few questions; they become literals of the plan.
QUESTIONS_MOST = 1000


def gate(docs: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """(doc columns, question_name, ask): a question is asked if it has no keywords or one occurs in the text, whatever the case.

    ``questions``: question_name, keywords; at most QUESTIONS_MOST of them. Each document is read once.
    """
    asked = questions.select("question_name", "keywords").limit(QUESTIONS_MOST + 1).collect()
    if len(asked) > QUESTIONS_MOST:
        raise ValueError(f"more than {QUESTIONS_MOST} questions")
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))

    def wanted(keywords: list[str] | None) -> Column:
        hit = F.lit(not keywords)
        for k in keywords or []:
            hit = hit | F.col("__t").contains((k or "").lower())
        return hit

    each = [F.struct(F.lit(r.question_name).alias("question_name"), wanted(r.keywords).alias("ask")) for r in sorted(asked)]
    none = F.array().cast("array<struct<question_name:string,ask:boolean>>")
    return docs.withColumn("__t", lowered).withColumn("__q", F.explode(F.array(*each) if each else none)).select(*docs.columns, "__q.question_name", "__q.ask")


def settle(asked: DataFrame, replies: DataFrame, questions: DataFrame, key: str = "doi") -> DataFrame:
    """(key, question_name, answer, confidence_score, original_answer): replies as allowed options.

    Questions that weren't asked are answered No with confidence 1; a document with any reply that means no option, or
    with a question unanswered, is left out. A missing confidence is 0.
    """
    told = replies.select(key, "question_name", F.col("answer").alias("original_answer"), "confidence")
    rows = asked.select(key, "question_name", "ask").join(questions.select("question_name", "options"), "question_name").join(told, [key, "question_name"], "left")
    answer = F.when(~F.col("ask"), "No").otherwise(answer_option(F.col("original_answer"), F.col("options"), F.col("question_name")))
    rows = rows.withColumn("answer", answer).withColumn("confidence_score", F.when(~F.col("ask"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
    bad = rows.where(F.col("answer").isNull()).select(key).distinct()
    return rows.join(bad, key, "left_anti").select(key, "question_name", "answer", "confidence_score", "original_answer")


def unpivoted(labels: DataFrame, names: dict[str, str], key: str = "doi") -> DataFrame:
    """(key, question_name, label): one column per literal question text becomes one row; unknown columns are ignored."""
    known = [c for c in labels.columns if c in names]
    pairs = F.explode(F.array(*[F.struct(F.lit(names[c]).alias("question_name"), F.col(f"`{c}`").alias("label")) for c in known]))
    return labels.select(key, pairs.alias("p")).select(key, "p.question_name", "p.label").where(F.col("label").isNotNull())


def accuracy(labels: DataFrame, answers: DataFrame, key: str = "doi") -> DataFrame:
    """(question_name, key, n, correct, accuracy) overall, per question and per document, in one pass of grouping sets."""
    both = labels.join(answers.select(key, "question_name", "answer"), [key, "question_name"])
    right = (scored_answer(F.col("answer")) == F.trim("label")).cast("int")
    both = both.withColumn("right", F.coalesce(right, F.lit(0)))
    sets = both.groupingSets([[], ["question_name"], [key]], "question_name", key)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("correct"), F.round(F.avg("right"), 6).alias("accuracy"))


def unscored(labels: DataFrame, answers: DataFrame, key: str = "doi") -> tuple[DataFrame, DataFrame]:
    """(documents without any answer, labels without their answer)."""
    docs = labels.select(key).distinct().join(answers.select(key).distinct(), key, "left_anti")
    lone = labels.join(answers.select(key, "question_name").distinct(), [key, "question_name"], "left_anti").join(docs, key, "left_anti")
    return docs, lone
