"""Queries on mentions under their final names: summaries, ownership, lineage, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import consolidate, lineage, matching, quality
from corvane.plans.documents import DOI, LEVEL
from corvane.plans.naming import ABBR, EXACT, SHORT, fuzzy_sql
from corvane.plans.registry import query
from corvane.session import cut, table

MENTION = "(SELECT DISTINCT theory_id, original_name, normalized_name, mapped_name, mapping_confidence_stage1_5, confidence_is_theory, mode, paper_focus, nullif(lower(doi), '') AS doi, pmid FROM theory_entries)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions, re-delivered ones once, DOIs in lower case."""
    e = table(spark, d, "theory_entries").drop("match_result", "extracted_at", "ingested_at").withColumn("doi", F.nullif(F.lower("doi"), F.lit("")))
    return e.distinct()


@query(f"""WITH m AS (SELECT * FROM (SELECT *, confidence_is_theory AS c FROM {MENTION})), kept AS (SELECT *, {LEVEL} AS lvl FROM m),
k AS (SELECT theory_id, original_name AS n, doi, coalesce(paper_focus, 0) AS f FROM kept WHERE lvl <> 'low' AND original_name IS NOT NULL AND doi IS NOT NULL),
t AS (SELECT * FROM k QUALIFY f = max(f) OVER (PARTITION BY doi)), a AS (SELECT n, arg_min(canonical, i) AS canonical FROM (SELECT n, unnest({ABBR}) AS a, generate_subscripts({ABBR}, 1) AS i FROM (SELECT DISTINCT n FROM t)) JOIN {SHORT} s ON a = s.abbr GROUP BY 1),
e AS (SELECT n, x.canonical FROM (SELECT DISTINCT n FROM t) JOIN {EXACT} x ON {fuzzy_sql('n')} = x.key)
SELECT coalesce(a.canonical, e.canonical) AS canonical, count(DISTINCT t.doi) AS docs, count(*) AS mentions FROM t LEFT JOIN a USING (n) LEFT JOIN e USING (n) WHERE coalesce(a.canonical, e.canonical) IS NOT NULL GROUP BY 1""")
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Canonical name -> documents at their best focus: filter, cheap matches on distinct names, ties kept, counts."""
    m = mentions(spark, d).where(names.confidence_level(F.col("confidence_is_theory")) != "low").where("original_name IS NOT NULL AND doi IS NOT NULL")
    m = cut(consolidate.tops(m.select("theory_id", F.col("original_name").alias("name"), "doi", F.coalesce("paper_focus", F.lit(0)).alias("f")), "doi", "f"))
    ontology, todo = table(spark, d, "ontology"), m.select("name").distinct()
    a = matching.match_abbreviation(todo, ontology).select("name", F.col("canonical").alias("a"))
    e = matching.match_exact(todo, ontology).withColumnRenamed("canonical", "e")
    found = m.join(a, "name", "left").join(e, "name", "left").withColumn("canonical", F.coalesce("a", "e")).where("canonical IS NOT NULL")
    return found.groupBy("canonical").agg(F.count_distinct("doi").alias("docs"), F.count(F.lit(1)).alias("mentions"))


@query(f"SELECT theory_id, doi, f FROM (SELECT theory_id, doi, coalesce(paper_focus, 0) AS f FROM {MENTION} WHERE doi IS NOT NULL) QUALIFY f = max(f) OVER (PARTITION BY doi)")
def best_focus_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).where("doi IS NOT NULL").select("theory_id", "doi", F.coalesce("paper_focus", F.lit(0)).alias("f"))
    return consolidate.tops(m, "doi", "f")


@query(f"SELECT normalized_name AS name, count(DISTINCT doi) AS docs, count(*) AS mentions FROM {MENTION} WHERE normalized_name IS NOT NULL GROUP BY 1")
def docs_per_name(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).where("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("name")).agg(F.count_distinct("doi").alias("docs"), F.count(F.lit(1)).alias("mentions"))


@query(f"SELECT doi FROM {MENTION} WHERE doi IS NOT NULL GROUP BY doi HAVING max(coalesce(paper_focus, 0)) <= 6")
def low_focus_documents(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.low_focus_docs(mentions(spark, d))


PAIRS = f"(SELECT DISTINCT normalized_name AS name, doi FROM {MENTION} WHERE coalesce(normalized_name, '') <> '' AND doi IS NOT NULL)"


@query(f"WITH p AS {PAIRS}, s AS (SELECT name, count(*) AS size FROM p GROUP BY 1) SELECT doi, arg_min(name, struct_pack(size := size, name := name)) AS name FROM p JOIN s USING (name) GROUP BY 1")
def smallest_group_owner(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).where("coalesce(normalized_name, '') <> '' AND doi IS NOT NULL")
    return consolidate.owners(m.select(F.col("normalized_name").alias("name"), "doi"))


@query(f"""WITH m AS (SELECT normalized_name AS name, doi, coalesce(paper_focus, 0) AS f FROM {MENTION} WHERE coalesce(normalized_name, '') <> '' AND doi IS NOT NULL), ok AS (SELECT doi FROM m GROUP BY 1 HAVING max(f) > 6),
p AS (SELECT DISTINCT name, doi FROM m SEMI JOIN ok USING (doi)), s AS (SELECT name, count(*) AS size FROM p GROUP BY 1) SELECT arg_min(name, struct_pack(size := size, name := name)) AS name, doi FROM p JOIN s USING (name) GROUP BY doi""")
def final_name_to_docs(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.final_map(mentions(spark, d).withColumnRenamed("normalized_name", "name"))


@query(f"""SELECT mapped_name AS name, count(theory_id) AS total_papers, count(DISTINCT doi) AS distinct_docs, count(DISTINCT original_name) AS originals,
  md5(array_to_string(list_sort(list(DISTINCT theory_id)), ',')) AS ids, md5(array_to_string(list(coalesce(doi, '') ORDER BY theory_id), ',')) AS dois, coalesce(array_to_string(list_sort(list(DISTINCT mode) FILTER (mode IS NOT NULL)), ','), '') AS modes FROM {MENTION} WHERE coalesce(mapped_name, '') <> '' GROUP BY 1""")
def final_name_summary(spark: SparkSession, d: str) -> DataFrame:
    s = consolidate.summary(mentions(spark, d).where("coalesce(mapped_name, '') <> ''").withColumnRenamed("mapped_name", "name"), "name", "mode")
    dois = F.md5(F.array_join(F.transform("dois", lambda x: F.coalesce(x, F.lit(""))), ","))
    return s.select("name", "total_papers", "distinct_docs", F.col("original_names_count").alias("originals"), F.md5(F.array_join("theory_ids", ",")).alias("ids"), dois.alias("dois"), F.array_join("modes", ",").alias("modes"))


FOLDED = r"regexp_replace(lower(mapped_name), '[^a-z0-9]+', ' ', 'g')"


@query(f"""WITH n AS (SELECT mapped_name AS was, {FOLDED} AS name, list_sort(list(DISTINCT theory_id)) AS ids FROM {MENTION} WHERE coalesce(mapped_name, '') <> '' GROUP BY 1, 2),
u AS (SELECT name, was, len(ids) AS n, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM n), f AS (SELECT name, id, min((-n, was, p)) AS o FROM u GROUP BY 1, 2)
SELECT name, count(*)::INT AS total_papers, md5(string_agg(id, ',' ORDER BY o)) AS ids FROM f GROUP BY 1""")
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of mapped names brought together under their folded form: ids in order, each once."""
    s = consolidate.summary(mentions(spark, d).where("coalesce(mapped_name, '') <> ''").withColumnRenamed("mapped_name", "name"), "name")
    mapping = s.select("name", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ").alias("mapped"))
    m = consolidate.merged_summary(s, mapping)
    return m.select("name", "total_papers", F.md5(F.array_join("theory_ids", ",")).alias("ids"))


@query("""WITH v AS (SELECT normalized_name AS k, mapped_name AS v, count(*) AS n, min(theory_id) AS f FROM theory_entries WHERE coalesce(mapped_name, '') <> '' AND normalized_name IS NOT NULL GROUP BY 1, 2),
w AS (SELECT k, arg_min(v, (-n, f)) AS v FROM v GROUP BY 1)
SELECT e.normalized_name, w.v AS mapped_name, count(*) AS mentions, count(*) FILTER (e.mapped_name <> w.v) AS changed FROM theory_entries e JOIN w ON e.normalized_name = w.k WHERE coalesce(mapped_name, '') <> '' GROUP BY 1, 2""")
def overruled_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Mapped names overwritten by the majority of their normalised name, with the number of changes."""
    e = table(spark, d, "theory_entries").where("coalesce(mapped_name, '') <> '' AND normalized_name IS NOT NULL").select("theory_id", "normalized_name", "mapped_name")
    rows, _ = consolidate.overruled(e, "normalized_name", "mapped_name", "theory_id")
    return rows.groupBy("normalized_name", "mapped_name").agg(F.count(F.lit(1)).alias("mentions"), F.count("note").alias("changed"))


ASSIGNED = """(SELECT batch_id, cluster_name, s.i - 1 AS sub_pos, batch_result.subclusters[s.i].subcluster_name AS subcluster_name, unnest(batch_result.subclusters[s.i].theory_ids) AS theory_id
  FROM stage6_batches, unnest(range(1, len(batch_result.subclusters) + 1)) AS s(i))"""
LAST = f"(SELECT theory_id, arg_max(coalesce(subcluster_name, ''), batch_id * 1000 + sub_pos) AS sub FROM {ASSIGNED} WHERE coalesce(theory_id, '') <> '' GROUP BY 1)"


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """(batch_id, cluster_name, sub_pos, subcluster_name, theory_id) of the stored splits."""
    b = table(spark, d, "stage6_batches").select("batch_id", "cluster_name", F.posexplode("batch_result.subclusters").alias("sub_pos", "s"))
    return b.select("batch_id", "cluster_name", "sub_pos", "s.subcluster_name", F.explode("s.theory_ids").alias("theory_id"))


def _split(spark: SparkSession, d: str, **variant: bool) -> DataFrame:
    a = assigned(spark, d).where(F.coalesce("theory_id", F.lit("")) != "").withColumn("subcluster_name", F.coalesce("subcluster_name", F.lit("")))
    members = mentions(spark, d).where("normalized_name IS NOT NULL").select("theory_id", F.col("normalized_name").alias("name"))
    return consolidate.split_names(members, a, **variant)


@query(rf"SELECT theory_id, normalized_name AS parent, coalesce(regexp_replace(sub, '(?i)[\s\p{{Z}}]*\(Batch\s+[0-9]+\)[\s\p{{Z}}]*$', ''), normalized_name) AS name, sub IS NOT NULL AS separated FROM {MENTION} LEFT JOIN {LAST} USING (theory_id) WHERE normalized_name IS NOT NULL")
def split_keeping_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@query(f"SELECT theory_id, normalized_name AS parent, sub AS name, true AS separated FROM {MENTION} JOIN {LAST} USING (theory_id) WHERE normalized_name IS NOT NULL")
def split_dropping_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, keep_unmapped=False, strip_suffix=False)


SIZES = f"(SELECT normalized_name AS name, count(*) AS total_papers FROM {MENTION} WHERE normalized_name IS NOT NULL GROUP BY 1)"


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).where("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("name")).agg(F.count(F.lit(1)).alias("total_papers"))


@query(f"SELECT name, total_papers FROM {SIZES} WHERE total_papers > 40")
def large_groups(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d).where("total_papers > 40")


@query(f"SELECT theory_id, normalized_name AS name FROM {MENTION} WHERE normalized_name IN (SELECT name FROM {SIZES} ORDER BY total_papers DESC, name LIMIT 3)")
def largest_three(spark: SparkSession, d: str) -> DataFrame:
    """Members of the three largest groups (a trial run over few clusters)."""
    top = sizes(spark, d).orderBy(F.desc("total_papers"), "name").limit(3)
    return mentions(spark, d).select("theory_id", F.col("normalized_name").alias("name")).join(top.select("name"), "name", "left_semi").select("theory_id", "name")


@query(f"SELECT name, CASE WHEN total_papers >= 6 THEN 'reference' ELSE 'rare' END AS first_role, CASE WHEN total_papers >= 3 THEN 'reference' WHEN total_papers <= 1 THEN 'rare' ELSE 'between' END AS last_role FROM {SIZES}")
def reference_and_rare(spark: SparkSession, d: str) -> DataFrame:
    s = consolidate.split_by_size(sizes(spark, d), "total_papers", 5).withColumnRenamed("role", "first_role")
    return consolidate.split_by_size(s, "total_papers", 7).select("name", "first_role", F.col("role").alias("last_role"))


@query(f"SELECT CASE WHEN total_papers > 100 THEN '>100' WHEN total_papers > 40 THEN '41-100' WHEN total_papers > 20 THEN '21-40' WHEN total_papers > 10 THEN '11-20' WHEN total_papers > 5 THEN '6-10' ELSE '1-5' END AS bucket, count(*) AS groups, sum(total_papers)::BIGINT AS members FROM {SIZES} GROUP BY 1")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.size_histogram(sizes(spark, d), "total_papers")


@query(f"WITH s AS (SELECT list_sort(list(total_papers)) AS l, count(*) AS n FROM {SIZES}) SELECT l[n * 25 // 100 + 1] AS p25, l[n // 2 + 1] AS p50, l[n * 75 // 100 + 1] AS p75, l[n] AS max, l[1] AS min, n FROM s")
def size_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quality.at_share(sizes(spark, d), "total_papers", 0.25, 0.5, 0.75)


@query("SELECT event_type, sum(event_id % 1000)::BIGINT AS tokens_in, round(sum(coalesce((event_id % 1000), 0) * 0.4 + coalesce(value, 0) * 1.6) / 1e6, 8) AS cost, round(count(*) / (greatest(epoch(max(ts)) - epoch(min(ts)), 1) / 60.0), 6) AS per_minute FROM events GROUP BY 1")
def token_costs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("tokens_in", F.col("event_id") % 1000)
    span = F.greatest(F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6 - F.unix_micros(F.min(F.col("ts").cast("timestamp"))) / 1e6, F.lit(1.0)) / 60
    return e.groupBy("event_type").agg(F.sum("tokens_in").alias("tokens_in"), F.round(F.sum(quality.cost(F.col("tokens_in"), F.col("value"), 0.4, 1.6)), 8).alias("cost"), F.round(F.count(F.lit(1)) / span, 6).alias("per_minute"))


@query(f"SELECT count(DISTINCT subcluster_name) AS names, count(DISTINCT theory_id) AS ids FROM {ASSIGNED} WHERE coalesce(theory_id, '') <> ''")
def distinct_nested(spark: SparkSession, d: str) -> DataFrame:
    a = assigned(spark, d).where(F.coalesce("theory_id", F.lit("")) != "")
    return a.agg(F.count_distinct("subcluster_name").alias("names"), F.count_distinct("theory_id").alias("ids"))



def lineage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mentions through matching, mapping and splitting, judged by their confidence labels."""
    ontology = table(spark, d, "ontology").select("name")
    e = table(spark, d, "theory_entries")
    rows = lineage.seed(e)
    matched = e.where("match_result.matched").groupBy("theory_id").agg(F.min("match_result.canonical_name").alias("v"))
    rows = lineage.stage(rows, "match", matched, ontology, "theory_id", "v")
    mapped = e.groupBy("theory_id").agg(F.min("mapped_name").alias("v"))
    rows = lineage.stage(rows, "map", mapped, ontology, "theory_id", "v")
    grouped = e.groupBy("original_name").agg(F.min("normalized_name").alias("v"))
    rows = lineage.stage(rows, "group", grouped, ontology, "original_name", "v", fallback="original_name")
    level = names.confidence_level(F.col("confidence_is_theory"))
    judged = F.when(level == "high", "valid").when(level == "low", "invalid").otherwise("doubted")
    votes = rows.where("done_at IS NULL AND name IS NOT NULL").groupBy("name").agg(F.min(judged).alias("is_valid_theory"))
    votes = votes.select(F.col("name").alias("original_name"), "is_valid_theory", F.lit(False).alias("is_listed"), F.lit(None).cast("string").alias("listed_name"))
    return lineage.verdict(rows, votes, ontology)


LINEAGE = f"""WITH o AS (SELECT name AS o FROM ontology), ee AS (SELECT theory_id, min(original_name) AS n0, min(confidence_is_theory) AS c, min(CASE WHEN match_result.matched THEN nullif(match_result.canonical_name, '') END) AS v1, min(mapped_name) AS v2 FROM theory_entries WHERE coalesce(theory_id, '') <> '' GROUP BY 1),
s1 AS (SELECT *, coalesce(v1, n0) AS n1, CASE WHEN v1 IN (FROM o) THEN 'completed' WHEN v1 IS NOT NULL THEN 'mapped' ELSE 'warning' END AS match_status FROM ee),
s2 AS (SELECT *, match_status = 'completed' AS d1, CASE WHEN match_status = 'completed' THEN 'skipped' WHEN nullif(v2, '') IN (FROM o) THEN 'completed' WHEN nullif(v2, '') IS NOT NULL THEN 'mapped' ELSE 'warning' END AS map_status FROM s1),
s3 AS (SELECT *, CASE WHEN d1 THEN n1 ELSE coalesce(nullif(v2, ''), n1) END AS n2, d1 OR map_status = 'completed' AS d2 FROM s2),
g AS (SELECT original_name AS k, nullif(min(normalized_name), '') AS v FROM theory_entries WHERE original_name IS NOT NULL GROUP BY 1),
s4 AS (SELECT s3.*, coalesce(a.v, b.v) AS v3 FROM s3 LEFT JOIN g a ON s3.n2 = a.k LEFT JOIN g b ON s3.n0 = b.k),
s5 AS (SELECT *, CASE WHEN d2 THEN 'skipped' WHEN v3 IN (FROM o) THEN 'completed' WHEN v3 IS NOT NULL THEN 'mapped' ELSE 'warning' END AS group_status, CASE WHEN d2 THEN n2 ELSE coalesce(v3, n2) END AS n3 FROM s4),
s6 AS (SELECT *, d2 OR group_status = 'completed' AS d3, CASE {LEVEL} WHEN 'high' THEN 'valid' WHEN 'low' THEN 'invalid' ELSE 'doubted' END AS j FROM s5),
v AS (SELECT n3, min(j) AS j FROM s6 WHERE NOT d3 AND n3 IS NOT NULL GROUP BY 1),
f AS (SELECT s6.theory_id, match_status, map_status, group_status, s6.n3 AS final_name, CASE WHEN d3 THEN 'valid' WHEN v.j = 'valid' THEN 'valid' WHEN v.j IS NOT NULL THEN 'not valid' ELSE 'unknown' END AS final_status FROM s6 LEFT JOIN v ON s6.n3 = v.n3)"""


@query(LINEAGE + " SELECT * FROM f")
def lineage_final(spark: SparkSession, d: str) -> DataFrame:
    return lineage_rows(spark, d).select("theory_id", "match_status", "map_status", "group_status", "final_name", "final_status")


@query(LINEAGE + " SELECT final_status, count(*) AS mentions FROM f GROUP BY 1")
def lineage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return lineage_rows(spark, d).groupBy("final_status").agg(F.count(F.lit(1)).alias("mentions"))


@query(LINEAGE + " SELECT stage, status, count(*) AS mentions FROM (SELECT 'match' AS stage, match_status AS status FROM f UNION ALL SELECT 'map', map_status FROM f UNION ALL SELECT 'group', group_status FROM f) GROUP BY 1, 2")
def lineage_counters(spark: SparkSession, d: str) -> DataFrame:
    return lineage.counters(lineage_rows(spark, d), ["match", "map", "group"]).select("stage", "status", "mentions")


@query(f"SELECT CASE WHEN coalesce(mapped_name, '') <> '' AND mapping_confidence_stage1_5 >= 0.9 THEN 'mapped surely' WHEN coalesce(mapped_name, '') <> '' THEN 'mapped' WHEN doi IS NULL THEN 'no document' WHEN coalesce(paper_focus, 0) <= 6 THEN 'low focus' WHEN original_name IS NULL THEN 'no name' ELSE 'unmatched' END AS bucket, count(*) AS n FROM {MENTION} GROUP BY 1")
def priority_waterfall(spark: SparkSession, d: str) -> DataFrame:
    named = F.coalesce("mapped_name", F.lit("")) != ""
    return lineage.waterfall(
        mentions(spark, d),
        ("mapped surely", named & (F.col("mapping_confidence_stage1_5") >= 0.9)), ("mapped", named), ("no document", F.col("doi").isNull()),
        ("low focus", F.coalesce("paper_focus", F.lit(0)) <= 6), ("no name", F.col("original_name").isNull()),
    )


@query(f"SELECT k AS doi, count(*) AS theories FROM (SELECT {DOI.format('doi')} AS k FROM theories) WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def papers_with_several(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicated(table(spark, d, "theories").select(names.doi_key(F.col("doi")).alias("doi")), "doi").withColumnRenamed("n", "theories")
