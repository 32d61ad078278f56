"""Queries on sources and sinks: files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names, similarity
from corvane.operators import qa, quality
from corvane.plans.documents import DOI
from corvane.plans.registry import query
from corvane.session import shared_folder, table
from corvane.sources import readers, sinks

CONCEPTS = "array<struct<concept:string,description:string>>"


@query(f"""WITH t AS (SELECT {DOI.format('doi')} AS doi, id, name, mode, paper_focus::VARCHAR AS paper_focus, from_json(CASE WHEN json_valid(key_concepts) AND key_concepts LIKE '[%' THEN key_concepts ELSE '[]' END, '[{{"concept": "VARCHAR"}}]') AS k FROM theories)
SELECT doi, (row_number() OVER (PARTITION BY doi ORDER BY id) - 1)::INT AS theory_pos, name, mode, paper_focus, len(k)::INT AS concepts FROM t WHERE doi IS NOT NULL""")
def mentions_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Theories nested in one JSON document a paper, written, read with an explicit schema and flattened again."""
    k = F.coalesce(F.from_json(F.when(F.col("key_concepts").startswith("["), F.col("key_concepts")), CONCEPTS), F.array().cast(CONCEPTS))
    t = table(spark, d, "theories").select(names.doi_key(F.col("doi")).alias("doi"), "id", "name", "mode", F.col("paper_focus").cast("string").alias("paper_focus"), k.alias("key_concepts")).where("doi IS NOT NULL")
    packed = t.groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("id", F.struct("name", "key_concepts", "mode", "paper_focus").alias("t")))).alias("l"))
    paper = F.struct("doi", F.transform("l", lambda x: x["t"]).alias("theories"))
    path = shared_folder(spark, "json")
    packed.select(F.to_json(F.struct(F.array(paper).alias("results"))).alias("value")).write.text(path)
    read = readers.extraction_results(spark, path, lines=True)
    return read.select("doi", "theory_pos", "name", "mode", "paper_focus", F.size("key_concepts").alias("concepts"))


@query(f"SELECT DISTINCT {DOI.format('doi')} AS doi FROM papers WHERE {DOI.format('doi')} IS NOT NULL")
def dois_from_a_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of DOIs with comments, blanks and repetitions, read in order."""
    path = shared_folder(spark, "list")
    p = table(spark, d, "papers").select(names.doi_key(F.col("doi")).alias("doi")).where("doi IS NOT NULL")
    lines = p.select(F.explode(F.array(F.lit("# a comment"), F.col("doi"), F.lit(""), F.concat(F.lit("  "), F.col("doi"), F.lit(" ")))).alias("value"))
    lines.write.text(path)
    return readers.doi_list(spark, path).select("doi")


@query("SELECT question_name, 'What about ' || question_name || '?' AS question, 'Yes|No' AS options FROM (SELECT DISTINCT question_name FROM eval_items WHERE question_name IS NOT NULL)")
def questions_from_a_file(spark: SparkSession, d: str) -> DataFrame:
    """A questionnaire as one JSON map, its options parted by slashes."""
    path = shared_folder(spark, "questions")
    q = table(spark, d, "eval_items").select("question_name").where("question_name IS NOT NULL").distinct()
    entry = F.struct("question_name", F.struct(F.concat(F.lit("What about "), "question_name", F.lit("?")).alias("question"), F.lit("Yes / No").alias("answers")))
    q.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")).coalesce(1).write.text(path)
    return readers.questions(spark, path).select("question_name", "question", F.array_join("options", "|").alias("options"))


NESTED = "(SELECT category, subcategory, name, coalesce(aliases, []) AS aliases FROM ontology)"


def _ontology_file(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark, "ontology")
    o = table(spark, d, "ontology")
    low = o.groupBy("category", "subcategory").agg(F.array_sort(F.collect_list(F.struct("name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("abbreviations", F.array().cast("array<string>")).alias("abbreviations")))).alias("entries"))
    mid = low.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subcategory", "entries")))).alias("m"))
    top = mid.agg(F.map_from_entries(F.collect_list(F.struct("category", "m"))).alias("m"))
    top.select(F.to_json(F.struct(F.col("m").alias("TheoriesOfAging"))).alias("value")).coalesce(1).write.text(path)
    return path


@query(f"SELECT category, subcategory, name, array_to_string(aliases, '|') AS aliases FROM {NESTED}")
def ontology_from_a_file(spark: SparkSession, d: str) -> DataFrame:
    """The three-level ontology, nested in one JSON document."""
    return readers.alias_ontology(spark, _ontology_file(spark, d)).select("category", "subcategory", "name", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT DISTINCT name FROM ontology WHERE name IS NOT NULL")
def ontology_names_at_any_depth(spark: SparkSession, d: str) -> DataFrame:
    return readers.ontology_names(spark, _ontology_file(spark, d))


@query("SELECT doi, title, confidence_score FROM paper_evaluations")
def evaluations_through_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV with quotes and line ends within fields, written and read with an explicit schema."""
    path = shared_folder(spark, "csv")
    rows = table(spark, d, "paper_evaluations").select("doi", "title", "confidence_score")
    sinks.write_csv(rows, path)
    return spark.read.schema("doi string, title string, confidence_score int").csv(path, header=True, quote='"', escape='"', multiLine=True)


@query("SELECT batch_id, cluster_name, batch_num, len(batch_result.subclusters)::INT AS subclusters FROM stage6_batches WHERE cluster_name IS NOT NULL AND batch_result IS NOT NULL")
def batches_from_checkpoint_files(spark: SparkSession, d: str) -> DataFrame:
    """Batch results in folders named after clusters and batch numbers, read back together."""
    path = shared_folder(spark, "batches")
    b = table(spark, d, "stage6_batches").where("cluster_name IS NOT NULL AND batch_result IS NOT NULL")
    sinks.write_batches(b.withColumn("name", F.col("cluster_name")).withColumn("number", F.col("batch_num")), path)
    schema = b.select("batch_id", F.col("cluster_name").alias("name"), F.col("batch_num").alias("number"), "batch_result").schema
    read = spark.read.schema(schema).json(path)
    return read.select("batch_id", F.col("name").alias("cluster_name"), F.col("number").alias("batch_num"), F.when(F.col("batch_result.subclusters").isNotNull(), F.size("batch_result.subclusters")).alias("subclusters"))


LABELS = {"Does it suggest a biomarker?": "aging_biomarker", "Does it suggest a mechanism?": "molecular_mechanism_of_aging"}


@query("SELECT doi, 'aging_biomarker' AS question_name, upper(result) AS label FROM paper_evaluations WHERE result IS NOT NULL UNION ALL SELECT doi, 'molecular_mechanism_of_aging', confidence_score::VARCHAR FROM paper_evaluations WHERE confidence_score IS NOT NULL")
def labels_by_question_text(spark: SparkSession, d: str) -> DataFrame:
    """Label columns named by literal question texts as rows of question ids; unknown columns are dropped."""
    e = table(spark, d, "paper_evaluations")
    wide = e.select("doi", F.upper("result").alias("Does it suggest a biomarker?"), F.col("confidence_score").cast("string").alias("Does it suggest a mechanism?"), F.col("title").alias("Something else?"))
    return qa.unpivoted(wide, LABELS)


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT theory_id FROM theory_entries EXCEPT SELECT DISTINCT theory_id FROM theory_entries WHERE mapped_name IS NOT NULL)) = 0 AS same")
def same_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whether mapping kept the set of ids."""
    e = table(spark, d, "theory_entries")
    return quality.same_keys(e.select("theory_id"), e.where("mapped_name IS NOT NULL").select("theory_id"), "theory_id")


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT original_name AS a, mapped_name AS b FROM theory_entries WHERE length(original_name) > 0 AND length(mapped_name) > 0),
r AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS row FROM p
  UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, greatest(row[j + 1], acc[-1], row[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE 0 END)), [0::BIGINT]) FROM r WHERE i < length(a))
SELECT a, b, round(200.0 * row[-1] / (length(a) + length(b)), 4) AS ratio FROM r WHERE i = length(a)""")
def indel_ratios(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of each name as typed and as mapped, by longest common subsequence."""
    e = table(spark, d, "theory_entries").select(F.col("original_name").alias("a"), F.col("mapped_name").alias("b")).where("length(a) > 0 AND length(b) > 0").distinct()
    return e.select("a", "b", F.round(similarity.ratio(F.col("a"), F.col("b")), 4).alias("ratio"))
