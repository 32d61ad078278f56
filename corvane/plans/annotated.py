"""Queries on the annotators' steps, with rules in the models' places."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import annotate, annotators, batching, matching, vectors
from corvane.plans.cascade import clustered
from corvane.plans.clusters import LISTED, _requested
from corvane.plans.documents import AVAILABLE, DOI, abstract_papers, availability, papers_metadata
from corvane.plans.naming import core_sql
from corvane.plans.registry import query
from corvane.plans.summaries import LINEAGE, SIZES, lineage_rows, mentions
from corvane.plans.vectors import COS
from corvane.session import table

ELIGIBLE = f"SELECT doi FROM ({AVAILABLE}) WHERE coalesce(trim(abstract), '') <> '' AND {DOI.format('doi')} NOT IN (SELECT {DOI.format('doi')} FROM theories WHERE {DOI.format('doi')} IS NOT NULL)"


@query(f"{ELIGIBLE} ORDER BY doi LIMIT 100")
def abstracts_only_missing(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 papers with an abstract that no theory is from, with full text or not; the limit counts eligible papers."""
    done = table(spark, d, "theories").select("doi")
    return abstract_papers(table(spark, d, "papers"), done, only_missing=True, limit=100).select("doi")


@query(f"""SELECT doi, 'ok' AS status, 0 AS theory_pos, title AS name, least(length(abstract) % 13, 10)::INT AS paper_focus FROM papers p WHERE doi IN ({ELIGIBLE.replace("SELECT doi FROM (" + AVAILABLE + ") WHERE", "SELECT doi FROM (" + AVAILABLE + ") WHERE NOT has_full_text AND NOT has_sections AND")}) AND length(abstract) % 7 <> 0
UNION ALL SELECT doi, 'error', NULL, NULL, NULL FROM papers p WHERE doi IN ({ELIGIBLE.replace("SELECT doi FROM (" + AVAILABLE + ") WHERE", "SELECT doi FROM (" + AVAILABLE + ") WHERE NOT has_full_text AND NOT has_sections AND")}) AND length(abstract) % 7 = 0""")
def extracted_from_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Theories of papers that have an abstract only; some replies stay unusable."""

    def rule(batches):
        for pdf in batches:
            told = [None if len(t) % 7 == 0 else json.dumps({"theories": [{"name": n, "paper_focus": str(min(len(t) % 13, 10))}]}) for n, t in zip(pdf.title, pdf.text, strict=True)]
            yield pd.DataFrame({"doi": pdf.doi, "reply": ["not JSON" if x is None else "```json\n" + x + "\n```" for x in told]})

    p = abstract_papers(table(spark, d, "papers"), table(spark, d, "theories").select("doi"))
    return annotators.extract(p.select("doi", "title", F.col("abstract").alias("text")), rule).select("doi", "status", "theory_pos", "name", "paper_focus")


@query(f"""WITH want AS (SELECT DISTINCT {DOI.format('doi')} AS k FROM theory_entries WHERE {DOI.format('doi')} IS NOT NULL), e AS (SELECT {DOI.format('doi')} AS k, pmid, title, result, confidence_score FROM paper_evaluations),
p AS (SELECT {DOI.format('doi')} AS k, min(pmid) AS pmid, min(title) AS title FROM papers GROUP BY 1)
SELECT k AS doi, pmid, title, result, confidence_score FROM e SEMI JOIN want USING (k)
UNION ALL SELECT k, pmid, title, 'unknown', 0 FROM want JOIN p USING (k) WHERE k NOT IN (SELECT k FROM e WHERE k IS NOT NULL)""")
def wanted_papers_found(spark: SparkSession, d: str) -> DataFrame:
    """Wanted DOIs from the evaluations, else from the papers; those that neither has are dropped."""
    want = table(spark, d, "theory_entries").select(names.doi_key(F.col("doi")).alias("doi")).where("doi IS NOT NULL").distinct()
    return papers_metadata(want, table(spark, d, "paper_evaluations"), table(spark, d, "papers"), keep_unfound=False)


CORE = core_sql("name")


@query(f"""WITH s AS (SELECT name, total_papers, coalesce({CORE}[1], lower(name)) AS cluster FROM {SIZES}), r AS (SELECT cluster, min(name) AS ref FROM s WHERE total_papers >= 6 GROUP BY 1)
SELECT s.cluster, s.name, CASE WHEN length(s.name) % 3 = 0 THEN s.name ELSE coalesce(r.ref, s.name) END AS mapped, CASE WHEN length(s.name) % 3 = 0 OR r.ref IS NULL THEN 'retain' ELSE 'map' END AS strategy
FROM s LEFT JOIN r USING (cluster) WHERE total_papers < 6""")
def refined_rare_names(spark: SparkSession, d: str) -> DataFrame:
    """Rare names mapped to the first reference name of their cluster; the rule never answers for a third of them."""

    def rule(batches):
        for pdf in annotators.rule_first_reference(batches):
            yield pdf[pdf.name.str.len() % 3 != 0]

    rows = mentions(spark, d).where("normalized_name IS NOT NULL").select("theory_id", F.col("normalized_name").alias("name"))
    return annotators.refine_rare(clustered(rows), rule)


@query()
def grouped_in_runs(spark: SparkSession, d: str) -> DataFrame:
    """Names that the list lacks, grouped batch by batch under names of earlier groups."""

    def rule(batches):
        for pdf in batches:
            mapped = [next(iter(g), n.strip().title()) if g is not None else n.strip().title() for n, g in zip(pdf.name, pdf.groups, strict=True)]
            yield pd.DataFrame({"batch": pdf.batch, "name": pdf.name, "mapped": mapped})

    todo = matching.not_listed(table(spark, d, "theory_entries").select(F.col("normalized_name").alias("name")), table(spark, d, "ontology"))
    batches = annotate.in_groups(todo, "name", size=100).select(F.col("group").alias("batch"), "name")
    return annotators.group_names(batches, rule)


@query(f"""WITH r AS (SELECT cluster_name, theory_id, row_number() OVER (PARTITION BY cluster_name ORDER BY theory_id) - 1 AS r, count(*) OVER (PARTITION BY cluster_name) AS n FROM {LISTED}),
p AS (SELECT *, ceil(n / 26.0)::BIGINT AS parts FROM r), q AS (SELECT *, n // parts AS base, n % parts AS extra FROM p),
b AS (SELECT cluster_name, theory_id, (CASE WHEN r < extra * (base + 1) THEN r // (base + 1) ELSE extra + (r - extra * (base + 1)) // greatest(base, 1) END + 1)::INT AS batch FROM q),
s AS (SELECT *, right(theory_id, 1) AS sub, count(*) OVER (PARTITION BY cluster_name, batch, right(theory_id, 1)) AS n FROM b)
SELECT cluster_name, batch, theory_id, CASE WHEN n >= 2 AND length(cluster_name) % 5 <> 0 THEN sub END AS subcluster_name FROM s""")
def batches_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Splits of whole batches: ids left alone fail, and so do batches whose replies make up ids to the end."""

    def rule(batches):
        for pdf in batches:
            out = pdf.assign(subcluster_name=pdf.theory_id.str[-1])
            if len(pdf) and len(pdf.cluster_name.iloc[0]) % 5 == 0:
                out = pd.concat([out, out.head(1).assign(theory_id="made up")])
            yield out

    batches = batching.even(_requested(spark, d), 26, "cluster_name", "theory_id")
    good, failed = annotate.split_batches(batches, rule)
    return good.unionByName(failed, allowMissingColumns=True).select("cluster_name", "batch", "theory_id", "subcluster_name")


ASKED = "(VALUES ('q_age', 'aging'), ('q_mice', 'mice'), ('q_all', '')) q(question_name, keyword)"


@query(f"""WITH p AS (SELECT doi, coalesce(length(title), 0) AS n, nullif(trim(full_text), '') IS NULL AS short, lower(coalesce(left(nullif(trim(full_text), ''), 50000), left(abstract, 50000), '')) AS t FROM papers WHERE doi IS NOT NULL),
a AS (SELECT doi, n, short, question_name, contains(t, keyword) AS ask FROM p, {ASKED})
SELECT doi, question_name, CASE WHEN NOT ask THEN 'No' WHEN n % 7 = 1 AND short THEN 'Not available' WHEN n % 7 <> 1 AND n % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer,
  CASE WHEN NOT ask THEN 1.0 ELSE 0.8 END AS confidence_score, CASE WHEN ask AND n % 7 = 1 AND NOT short THEN 'Not available' WHEN ask AND n % 7 <> 1 AND n % 2 = 1 THEN 'no (not shown)' END AS original_answer
FROM a WHERE doi NOT IN (SELECT doi FROM a WHERE ask AND n % 11 = 0)""")
def answered_papers(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked, checked and asked again; papers whose replies stay unusable are left out as a whole."""

    def rule(batches):
        for pdf in batches:
            n = pdf.title.fillna("").str.len()
            said = ["Yes" if k % 2 == 0 else "no (not shown)" for k in n]
            said = ["Not available" if k % 7 == 1 else "certainly" if k % 11 == 0 else s for k, s in zip(n, said, strict=True)]
            said = ["certainly" if k % 11 == 0 else s for k, s in zip(n, said, strict=True)]
            yield pd.DataFrame({"doi": pdf.doi, "question_name": pdf.question_name, "answer": said, "confidence": 0.8, "reasoning": "by length"})

    q = spark.createDataFrame([("q_age", ["aging"], ["Yes", "No"]), ("q_mice", ["mice"], ["Yes", "No"]), ("q_all", [], ["Yes", "No"])], "question_name string, keywords array<string>, options array<string>")
    p = table(spark, d, "papers").select("doi", "title", "abstract", F.nullif(F.trim("full_text"), F.lit("")).alias("text"))
    return annotators.answer_questions(p, q, rule).select("doi", "question_name", "answer", "confidence_score", "original_answer")


@query("""WITH t AS (SELECT name, id, evidence, from_json(key_concepts, '[{"concept": "VARCHAR", "description": "VARCHAR"}]') AS k FROM theories WHERE name IS NOT NULL AND json_valid(key_concepts) AND key_concepts LIKE '[%'),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY md5('42|' || id::VARCHAR), id) AS rank FROM t),
v AS (SELECT name, rank, '### V.' || rank || ':' || chr(10) || CASE WHEN len(k) > 0 THEN 'Key concepts:' || chr(10) || array_to_string(list_transform(k[1:3], lambda c: '  - ' || coalesce(c.concept, '') || ': ' || coalesce(c.description, '')), chr(10)) ELSE '  (No key concepts available)' END
  || CASE WHEN coalesce(evidence, '') <> '' THEN chr(10) || 'Evidence: ' || CASE WHEN length(evidence) > 500 THEN left(evidence, 500) || '...' ELSE evidence END ELSE '' END AS v FROM r WHERE rank <= 4)
SELECT name, md5('## UNIQUE NAME 1: ' || name || chr(10) || string_agg(v, chr(10) ORDER BY rank)) AS prompt FROM v GROUP BY name""")
def judging_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge of names is shown: up to four versions of each, their first three concepts and cut evidence."""
    k = F.from_json("key_concepts", "array<struct<concept:string,description:string>>")
    t = table(spark, d, "theories").where("name IS NOT NULL").where(F.expr("try_parse_json(key_concepts)").isNotNull() & F.col("key_concepts").startswith("["))
    few = batching.exemplars(t.select("name", F.col("id").cast("string").alias("id"), "evidence", k.alias("concepts")), "name", "id", 4)
    out = annotators.judging_prompt(few.withColumn("batch", F.col("name")), evidence=True)
    return out.select(F.col("batch").alias("name"), F.md5("prompt").alias("prompt"))


@query("SELECT item_id, ((row_number() OVER (ORDER BY item_id) - 1) // 50 + 1)::INT AS \"group\", ((row_number() OVER (ORDER BY item_id) - 1) % 50 % 10 + 1)::INT AS slot FROM eval_items")
def request_groups(spark: SparkSession, d: str) -> DataFrame:
    """Requests in groups of fifty, ten at a time."""
    return annotate.in_groups(table(spark, d, "eval_items").select("item_id"), "item_id")


@query(f"""WITH q AS (SELECT *, vec_id // 20 % 9 + 1 AS number FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, number, e.vec_id, round({COS.format(a='e.embedding::DOUBLE[]', b='q.embedding::DOUBLE[]')}, 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, similarity, rank::INT AS rank FROM r WHERE rank <= CASE WHEN number = 1 THEN 12 WHEN number IN (2, 3) THEN 10 WHEN number IN (4, 5, 6) THEN 8 ELSE 15 END""")
def retrieved_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For each question (every twentieth vector) the most similar chunks, as many as its number calls for."""
    e = table(spark, d, "embeddings")
    found = vectors.most_similar(e, "vec_id", "embedding", e.where(F.col("vec_id") % 20 == 0), 15)
    return found.where(F.col("rank") <= annotate.chunk_budget(F.floor(F.col("query") / 20) % 9 + 1)).select("query", "vec_id", "similarity", "rank")


SOURCES = {"scored": "[a-z]{9,}", "entities": r"\b([A-Z][a-z]+) (?:cells|mice|rats)\b", "mechanisms": r"\b([a-z]+ (?:loss|repair|damage|folding))\b", "patterns": r"\b([a-z]+ pathway)\b"}


@query(f"""WITH s AS (SELECT doi AS key, keyword, 1 AS source, least(0.2 * count(*), 1.0) AS score FROM (SELECT doi, unnest(regexp_extract_all(lower(abstract), '{SOURCES['scored']}')) AS keyword FROM papers WHERE doi IS NOT NULL) GROUP BY 1, 2),
x AS (SELECT * FROM s UNION ALL SELECT doi, lower(unnest(regexp_extract_all(abstract, '{SOURCES['entities']}', 1))), 1, 0.85 FROM papers UNION ALL SELECT doi, unnest(regexp_extract_all(lower(abstract), '{SOURCES['mechanisms']}', 1)), 2, 0.95 FROM papers
  UNION ALL SELECT doi, unnest(regexp_extract_all(lower(abstract), '{SOURCES['patterns']}', 1)), 3, 0.9 FROM papers),
b AS (SELECT key, keyword, arg_max(score, (source, score)) AS score FROM x GROUP BY 1, 2)
SELECT key, keyword, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, keyword) AS rank FROM b) WHERE rank <= 10""")
def merged_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of abstracts from a scorer, entities, mechanisms and patterns, the ten best."""
    p = table(spark, d, "papers").where("doi IS NOT NULL AND abstract IS NOT NULL")
    of = lambda name, low=True, group=1: p.select(F.col("doi").alias("key"), F.explode(F.regexp_extract_all(F.lower("abstract") if low else F.col("abstract"), F.lit(SOURCES[name]), F.lit(group))).alias("keyword"))
    scored = of("scored", group=0).groupBy("key", "keyword").agg(F.least(0.2 * F.count(F.lit(1)), F.lit(1.0)).alias("score"))
    return annotate.merge_keywords(scored, of("entities", low=False), of("mechanisms"), of("patterns")).withColumn("score", F.round("score", 6))


@query(LINEAGE + " SELECT theory_id, final_name, 'valid' AS final_status FROM f WHERE final_status = 'valid' AND coalesce(final_name, '') <> ''")
def valid_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The mentions that the lineage found valid, as clustering takes them."""
    return lineage_rows(spark, d).where("final_status = 'valid' AND coalesce(final_name, '') <> ''").select("theory_id", "final_name", "final_status")


@query("WITH e AS (SELECT count(*) AS done, greatest(epoch(max(ts)) - epoch(min(ts)), 1) / 60.0 AS minutes FROM events) SELECT round(done / minutes, 6) AS per_minute, (SELECT count(*) FROM papers) AS total, round((SELECT count(*) FROM papers) / (done / minutes) / 60, 6) AS hours FROM e")
def throughput_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Requests per minute so far, and how long all papers will take at that rate."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").agg(F.count(F.lit(1)).alias("done"), (F.greatest((F.max(at) - F.min(at)) / 1e6, F.lit(1.0)) / 60).alias("minutes"))
    total = table(spark, d, "papers").agg(F.count(F.lit(1)).alias("total"))
    rate = F.col("done") / F.col("minutes")
    return e.join(total).select(F.round(rate, 6).alias("per_minute"), "total", F.round(F.col("total") / rate / 60, 6).alias("hours"))
