"""Contracts of the external annotators: what a request and a reply look like, a deterministic rule in the model's place,
and what becomes of missing or unusable replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import names
from corvane.operators import qa
from corvane.operators.annotate import Annotator, annotate, parsed, whole, with_fallback
from corvane.operators.batching import exemplars
from corvane.operators.postings import Posted, post
from corvane.session import cut, ship

#: reply schemas, by operator
EXTRACT = "doi string, reply string"
VALID = "theory_id string, valid boolean, reason string"
MAP = "name string, mapped string, confidence double"
VERDICT = "name string, verdict string, reason string, listed_name string"
ANSWER = "doi string, question_name string, answer string, confidence double, reasoning string"
STRATEGY = "cluster string, name string, strategy string, mapped string, confidence double"


def extract(papers: DataFrame, annotator: Annotator, limit: int = 20000) -> DataFrame:
    """Theories of papers (doi, title, text): replies are JSON texts; papers without a usable one have status error.

    (doi, status, theory_pos, name, mode, evidence, confidence_is_theory, paper_focus); papers with no theory keep a row of nulls.
    """
    asked = papers.select("doi", "title", F.left("text", F.lit(limit)).alias("text"))
    good, still = annotate(asked, annotator, EXTRACT, ["doi"], parsed(F.col("reply"), f"STRUCT<theories: ARRAY<{schemas.THEORY}>>")["theories"].isNotNull())
    rows = good.select("doi", parsed(F.col("reply"), f"STRUCT<theories: ARRAY<{schemas.THEORY}>>")["theories"].alias("t"))
    out = rows.select("doi", F.lit("ok").alias("status"), F.posexplode_outer("t").alias("theory_pos", "t"))
    out = out.select("doi", "status", "theory_pos", "t.name", "t.mode", "t.evidence", "t.confidence_is_theory", names.focus(F.col("t.paper_focus")).alias("paper_focus"))
    return out.unionByName(still.select("doi", F.lit("error").alias("status")), allowMissingColumns=True)


def validate_medium(mentions: DataFrame, annotator: Annotator) -> DataFrame:
    """Adds is_validated and validation_reason to mentions of medium confidence; without a reply they count as valid."""
    level = names.confidence_level(F.col("confidence_is_theory"))
    asked = mentions.where(level == "medium").select("theory_id", "name", "confidence_is_theory").dropDuplicates(["theory_id"])
    good, _ = annotate(asked, annotator, VALID, ["theory_id"], F.col("valid").isNotNull())
    out = mentions.join(good.select("theory_id", "valid", "reason"), "theory_id", "left")
    return out.select(*mentions.columns, F.coalesce("valid", F.lit(True)).alias("is_validated"), F.coalesce("reason", F.when(level == "medium", "no reply").otherwise("not asked")).alias("validation_reason"))


def map_names(todo: DataFrame, annotator: Annotator, identity: bool = True) -> DataFrame:
    """(name, mapped, confidence): mapped, grouped or refined names. What stays open is itself, or unmapped (null)."""
    good, _ = annotate(todo.select("name").distinct(), annotator, MAP, ["name"], F.coalesce("mapped", F.lit("")) != "")
    out = with_fallback(todo.select("name").distinct(), good) if identity else todo.select("name").distinct().join(good.select("name", "mapped"), "name", "left")
    return out.join(good.select("name", "confidence"), "name", "left").select("name", "mapped", "confidence")


def validate_names(rows: DataFrame, annotator: Annotator, attempts: int = 3, most: int = 4) -> DataFrame:
    """(name, verdict, reason, listed_name) of distinct names, judged on up to ``most`` exemplars each.

    A doubted name is asked again with other exemplars; after the last attempt, or with no exemplar left, it is invalid.
    ``rows``: name, theory_id, evidence.
    """
    done, todo = None, rows.select("name").where("name IS NOT NULL").distinct()
    for attempt in range(attempts):
        few = exemplars(rows.join(todo, "name", "left_semi"), "name", "theory_id", most, seed=str(42 + attempt))
        asked = few.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))), lambda x: F.left(F.coalesce(x["evidence"], F.lit("")), F.lit(500))), "\n").alias("evidence"))
        good, _ = annotate(asked, annotator, VERDICT, ["name"], F.col("verdict").isin("valid", "invalid", "doubted"), attempts=1)
        settled = cut(good.where("verdict <> 'doubted'"))
        done = settled if done is None else done.unionByName(settled)
        todo = cut(todo.join(settled.select("name"), "name", "left_anti"))
        if todo.isEmpty():
            break
    rest = todo.select("name", F.lit("invalid").alias("verdict"), F.lit("doubted to the end").alias("reason"), F.lit(None).cast("string").alias("listed_name"))
    return done.select("name", "verdict", "reason", "listed_name").unionByName(rest)


def with_groups(annotator: Annotator, paths: list[str]) -> Annotator:
    """The annotator, given ``groups`` (``postings.Posted``) in place of the columns words and first."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for i, (words, first) in enumerate(zip(pdf["words"], pdf["first"], strict=True)):
                groups.array[i] = Posted(paths, list(words), first)
            yield pdf[["batch", "name"]].assign(groups=groups)

    return lambda batches: annotator(asked(batches))


def group_names(batches: DataFrame, annotator: Annotator, rounds: int = 4) -> DataFrame:
    """(name, mapped, batch, extra): names grouped batch by batch, each with the names of earlier groups at hand.

    ``batches``: batch (from 1), name. Batches are asked in ``rounds`` runs of consecutive ones: a run knows all groups of the
    runs before it; those that share a core word with a name are at hand in ``groups``, a sorted sequence. Written out they
    would be as many as the pairs of names with a common word, so each run's groups are kept once, by word, and a request has its
    words and its first group only; further ones are read as the annotator goes on to them. A name without a
    reply is its own group; names in a reply that weren't asked for are kept (extra). Of several mappings of a name
    the last batch's counts.
    """
    ship(batches.sparkSession)
    rows = cut(batches.where(F.coalesce("name", F.lit("")) != "").select("batch", "name").distinct())
    most = rows.agg(F.max("batch").alias("m")).first()["m"] or 0
    per, out, heads, paths = max(1, -(-most // rounds)), None, None, []
    for first in range(1, most + 1, per):
        part = rows.where(F.col("batch").between(first, first + per - 1)).withColumn("words", names.core_tokens(F.col("name")))
        if heads is None:
            asked = part.withColumn("first", F.lit(None).cast("string"))
        else:
            near = part.select("batch", "name", F.explode("words").alias("word")).join(heads, "word").groupBy("batch", "name").agg(F.min("text").alias("first"))
            asked = part.join(near, ["batch", "name"], "left")
        reply = asked.select("batch", "name", "words", "first").mapInPandas(with_groups(annotator, list(paths)), "batch int, name string, mapped string")
        reply = reply.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("mapped", F.lit("")) != "")).groupBy("batch", "name").agg(F.min("mapped").alias("mapped"))
        both = part.select("batch", "name", F.lit(False).alias("extra")).join(reply, ["batch", "name"], "full")
        one = cut(both.select("batch", "name", F.coalesce("mapped", "name").alias("mapped"), F.coalesce("extra", F.lit(True)).alias("extra")))
        out = one if out is None else out.unionByName(one)
        if first + per > most:
            break
        told = one.select(F.col("mapped").alias("text")).distinct().select(F.explode(names.core_tokens(F.col("text"))).alias("word"), "text")
        paths.append(post(told))
        least = told.groupBy("word").agg(F.min("text").alias("text"))
        heads = cut(least if heads is None else heads.unionByName(least).groupBy("word").agg(F.min("text").alias("text")))
    if out is None:
        return rows.select("name", F.col("name").alias("mapped"), "batch", F.lit(False).alias("extra"))
    return out.groupBy("name").agg(F.max(F.struct("batch", (~F.col("extra")).alias("own"), "mapped")).alias("b")).select("name", "b.mapped", "b.batch", (~F.col("b.own")).alias("extra"))


def refine_rare(members: DataFrame, annotator: Annotator, prefer: str = "assign_common", retry_poor: bool = False) -> DataFrame:
    """(cluster, name, mapped, strategy): rare names take a reference name (map), a new common one (assign_common) or stay (retain).

    ``members``: cluster, name, role; ``prefer`` (assign_common in stage 5, map in stage 7) is sent along. Replies count where the strategy
    is known and a mapped name is one of the cluster's references. A cluster with a name that got no such reply is asked once more as a
    whole, and with ``retry_poor`` one where more than three names were given common names that are all different. The second reply counts
    where it is complete; else the first one does, and names without a reply are retained.
    """
    rare = cut(members.where("role = 'rare'").select("cluster", "name").distinct())
    refs = cut(members.where("role = 'reference'").select("cluster", F.col("name").alias("mapped")).distinct().withColumn("is_ref", F.lit(True)))
    refs_per = refs.groupBy("cluster").agg(F.array_sort(F.collect_list("mapped")).alias("references"))

    def ask(todo: DataFrame) -> DataFrame:
        good, _ = annotate(todo.join(refs_per, "cluster", "left").withColumn("prefer", F.lit(prefer)), annotator, STRATEGY, ["cluster", "name"], F.col("strategy").isin("map", "assign_common", "retain") & (F.coalesce("mapped", F.lit("")) != ""), attempts=1)
        return cut(good.join(refs, ["cluster", "mapped"], "left").where((F.col("strategy") != "map") | F.coalesce("is_ref", F.lit(False))).select("cluster", "name", "mapped", "strategy"))

    def incomplete(todo: DataFrame, reply: DataFrame) -> DataFrame:
        return todo.join(reply.select("cluster", "name"), ["cluster", "name"], "left_anti").select("cluster").distinct()

    reply = ask(rare)
    again = incomplete(rare, reply)
    if retry_poor:
        common = reply.where("strategy = 'assign_common'").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mapped").alias("k"))
        again = again.unionByName(common.where("n = k AND n > 3").select("cluster")).distinct()
    todo = cut(rare.join(again, "cluster", "left_semi"))
    if not todo.isEmpty():
        second = ask(todo)
        whole = cut(todo.select("cluster").distinct().join(incomplete(todo, second), "cluster", "left_anti"))
        reply = reply.join(whole, "cluster", "left_anti").unionByName(second.join(whole, "cluster", "left_semi"))
    out = rare.join(reply, ["cluster", "name"], "left")
    keep = F.coalesce("strategy", F.lit("retain"))
    return out.select("cluster", "name", F.when(keep == "retain", F.col("name")).otherwise(F.col("mapped")).alias("mapped"), keep.alias("strategy"))


def answer_questions(papers: DataFrame, questions: DataFrame, annotator: Annotator, attempts: int = 3, limit: int = 50000) -> DataFrame:
    """(doi, question_name, answer, confidence_score, reasoning, original_answer): all questions of each paper, or none.

    ``papers``: doi, title, abstract, text (null where there is the abstract only); ``questions``: question_name, keywords, options. A
    question is asked if its keywords call for it (``qa.gate``, on the text as sent); else the answer is No, with confidence 1. A paper's reply
    counts if it has exactly the questions asked and each answer means an allowed option (for abstracts also 'Not available'); else
    the paper is asked again as a whole, and after ``attempts`` it is left out. original_answer is set where an answer was normalised.
    """
    sent = papers.where("doi IS NOT NULL").select("doi", "title", F.left("abstract", F.lit(limit)).alias("abstract"), F.left("text", F.lit(limit)).alias("text")).dropDuplicates(["doi"])
    sent = sent.withColumn("seen", F.coalesce("text", "abstract"))
    gated = qa.gate(sent, questions.select("question_name", "keywords"), "seen").join(questions.select("question_name", "options"), "question_name")
    gated = cut(gated.withColumn("options", F.when(F.col("text").isNull(), F.array_append("options", F.lit("Not available"))).otherwise(F.col("options"))))
    todo, good = gated.where("ask").drop("ask"), None
    for _ in range(attempts):
        spread = todo.repartition(todo.sparkSession.sparkContext.defaultParallelism, "doi")
        reply = cut(spread.groupBy("doi").applyInPandas(whole(annotator), ANSWER))
        both = todo.select("doi", "question_name", "options", F.lit(True).alias("asked")).join(reply, ["doi", "question_name"], "full")
        both = both.withColumn("option", names.answer_option(F.col("answer"), F.col("options"), F.col("question_name")))
        bad = both.where(F.col("asked").isNull() | F.col("option").isNull()).select("doi").unionByName(reply.groupBy("doi", "question_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doi")).distinct()
        kept = both.join(bad, "doi", "left_anti").select(
            "doi", "question_name", F.col("option").alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence_score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.when(F.col("answer") != F.col("option"), F.col("answer")).alias("original_answer")
        )
        kept = cut(kept)
        good = kept if good is None else good.unionByName(kept)
        todo = cut(todo.join(kept.select("doi").distinct(), "doi", "left_anti"))
        if todo.isEmpty():
            break
    open_ = todo.select("doi").distinct()
    skipped = gated.where("NOT ask").join(open_, "doi", "left_anti").select(
        "doi", "question_name", F.lit("No").alias("answer"), F.lit(1.0).alias("confidence_score"), F.lit("Skipped: no relevant keywords found in text").alias("reasoning"), F.lit(None).cast("string").alias("original_answer")
    )
    return good.unionByName(skipped)


# ---- rules in the models' place


def rule_valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"theory_id": pdf.theory_id, "valid": pdf.name.fillna("").str.len() > 3, "reason": "has a name"})


def rule_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names mapped to their title case without a trailing 'of aging'."""
    for pdf in batches:
        mapped = pdf.name.str.replace(r"(?i)\s+of\s+age?ing\s*$", "", regex=True).str.replace(r"\s+", " ", regex=True).str.strip().str.title()
        yield pd.DataFrame({"name": pdf.name, "mapped": mapped, "confidence": 0.5})


def rule_verdict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"name": pdf.name, "verdict": pdf.name.str.len().map(lambda n: "invalid" if n < 4 else "valid"), "reason": "length", "listed_name": None})


def rule_first_reference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        refs = [list(r)[0] if r is not None and len(r) else None for r in pdf.references]
        yield pd.DataFrame({"cluster": pdf.cluster, "name": pdf.name, "strategy": ["map" if r else "retain" for r in refs], "mapped": [r or n for r, n in zip(refs, pdf.name, strict=True)], "confidence": 0.5})


def request_size(batch: Column, reserve: int = 2000) -> Column:
    """Tokens that a batch will take."""
    from corvane.functions.text import token_estimate

    return token_estimate(F.to_json(batch), reserve)


def concept_lines(concepts: Column, most: int = 3) -> Column:
    """The first ``most`` concepts of a list of (concept, description), a line each."""
    lines = F.transform(F.slice(concepts, 1, most), lambda c: F.concat(F.lit("  - "), F.coalesce(c["concept"], F.lit("")), F.lit(": "), F.coalesce(c["description"], F.lit(""))))
    return F.when(F.size(concepts) > 0, F.concat(F.lit("Key concepts:\n"), F.array_join(lines, "\n"))).otherwise("  (No key concepts available)")


def shortened(text: Column, most: int = 500) -> Column:
    """Text of at most ``most`` characters, with dots where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def judging_prompt(rows: DataFrame, batch: str = "batch", evidence: bool = False, most: int = 3) -> DataFrame:
    """(batch, prompt): the names of a batch in order, numbered, each with its versions: their first concepts and, in later
    attempts, the evidence cut to 500 characters.

    ``rows``: batch, name, rank, concepts (array of concept, description), evidence; batches and versions are bounded by their maker.
    """
    told = F.concat_ws("\n", F.concat(F.lit("### V."), F.col("rank").cast("string"), F.lit(":")), concept_lines(F.col("concepts"), most), *([F.concat(F.lit("Evidence: "), shortened(F.nullif("evidence", F.lit(""))))] if evidence else []))
    per = rows.withColumn("__v", told).groupBy(batch, "name").agg(F.array_sort(F.collect_list(F.struct("rank", "__v"))).alias("l"))
    per = per.withColumn("__n", F.row_number().over(Window.partitionBy(batch).orderBy("name")))
    block = F.concat(F.lit("## UNIQUE NAME "), F.col("__n").cast("string"), F.lit(": "), "name", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["__v"]), "\n"))
    joined = per.withColumn("__b", block).groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("__n", "__b"))).alias("l"))
    return joined.select(batch, F.array_join(F.transform("l", lambda x: x["__b"]), "\n\n").alias("prompt"))


def numbered_prompt(rows: DataFrame, batch: str, *order: str, text: str = "name") -> DataFrame:
    """(batch, prompt): the batch's texts, numbered from 1, one a line, in the given order. Batches are bounded by their maker."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    lines = rows.withColumn("__n", rank).groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(text).alias("t")))).alias("l"))
    return lines.select(batch, F.array_join(F.transform("l", lambda x: F.concat(x["__n"].cast("string"), F.lit(". "), F.coalesce(x["t"], F.lit("")))), "\n").alias("prompt"))
