"""Queries on papers, their evaluations and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names, text
from corvane.operators import consolidate
from corvane.plans.registry import query
from corvane.session import table
from corvane.sources import readers, sinks

DOI = r"nullif(regexp_replace(lower(trim({0})), '^(https?://(dx\.)?doi\.org/|doi:\s*)', ''), '')"
LEVEL = """CASE WHEN c IS NULL OR trim(c) = '' THEN 'unknown' WHEN lower(trim(c)) IN ('high', 'medium', 'low', 'unknown') THEN lower(trim(c))
  WHEN contains(c, '(') AND trim(split_part(lower(c), '(', 1)) IN ('high', 'medium', 'low') THEN trim(split_part(lower(c), '(', 1))
  WHEN lower(c) LIKE '%high%' AND lower(c) LIKE '%medium%' THEN 'medium' WHEN lower(c) LIKE '%low%' AND (lower(c) LIKE '%medium%' OR lower(c) LIKE '%high%') THEN 'low'
  WHEN lower(c) LIKE '%high%' THEN 'high' WHEN lower(c) LIKE '%medium%' THEN 'medium' WHEN lower(c) LIKE '%low%' THEN 'low'
  WHEN lower(c) LIKE '%classical%' OR lower(c) LIKE '%established%' THEN 'high' ELSE 'unknown' END"""
VALID = "(result IN ('valid', 'doubted') OR (result = 'not_valid' AND confidence_score <= 7))"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers")


def validated(evaluations: DataFrame) -> DataFrame:
    """Valid and doubted papers, and rejected ones that were rejected without much confidence."""
    return evaluations.where(F.expr(VALID))


@query(f"SELECT p.doi, p.title, e.result, e.confidence_score FROM paper_evaluations e JOIN papers p ON {DOI.format('e.doi')} = {DOI.format('p.doi')} WHERE {VALID}")
def validated_papers(spark: SparkSession, d: str) -> DataFrame:
    e = validated(table(spark, d, "paper_evaluations")).select(names.doi_key(F.col("doi")).alias("k"), "result", "confidence_score")
    p = _papers(spark, d).select("doi", "title", names.doi_key(F.col("doi")).alias("k"))
    return e.join(p, "k").select("doi", "title", "result", "confidence_score")


@query(f"""WITH e AS (SELECT {DOI.format('doi')} AS k, coalesce(max(nullif(title, '')), '') AS t, coalesce(max(nullif(pmid, '')), '') AS m, max(result) AS r, max(confidence_score) AS c FROM paper_evaluations GROUP BY 1),
want AS (SELECT DISTINCT {DOI.format('doi')} AS k FROM theory_entries WHERE coalesce(doi, '') <> ''), p AS (SELECT {DOI.format('doi')} AS k, max(title) AS title, max(pmid) AS pmid FROM papers GROUP BY 1)
SELECT w.k AS doi, coalesce(nullif(p.title, ''), e.t, '') AS title, coalesce(nullif(p.pmid, ''), e.m, '') AS pmid, coalesce(e.r, 'unknown') AS result, coalesce(e.c, 0) AS confidence_score
FROM want w LEFT JOIN p USING (k) LEFT JOIN e USING (k)""")
def wanted_papers_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Wanted DOIs with data of two fallback sources and defaults; DOIs that neither has are kept."""
    e = table(spark, d, "paper_evaluations").groupBy(names.doi_key(F.col("doi")).alias("k")).agg(
        F.coalesce(F.max(names.falsy(F.col("title"))), F.lit("")).alias("t"), F.coalesce(F.max(names.falsy(F.col("pmid"))), F.lit("")).alias("m"), F.max("result").alias("r"), F.max("confidence_score").alias("c")
    )
    p = _papers(spark, d).groupBy(names.doi_key(F.col("doi")).alias("k")).agg(F.max("title").alias("title"), F.max("pmid").alias("pmid"))
    want = table(spark, d, "theory_entries").select(names.doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").distinct()
    return want.join(p, "k", "left").join(e, "k", "left").select(
        F.col("k").alias("doi"), F.coalesce(names.falsy(F.col("title")), "t", F.lit("")).alias("title"), F.coalesce(names.falsy(F.col("pmid")), "m", F.lit("")).alias("pmid"),
        F.coalesce("r", F.lit("unknown")).alias("result"), F.coalesce("c", F.lit(0)).alias("confidence_score"),
    )


def availability(papers: DataFrame) -> DataFrame:
    """Adds has_full_text, has_sections (unparseable JSON counts as there) and the source of the text."""
    parsed = F.expr("try_parse_json(full_text_sections)")
    compact = F.regexp_replace("full_text_sections", r"\s", "")
    sections = (F.coalesce(F.trim("full_text_sections"), F.lit("")) != "") & (parsed.isNull() | ~compact.isin("{}", "[]", "null", '""'))
    full = F.coalesce(F.trim("full_text"), F.lit("")) != ""
    abstract = F.coalesce(F.trim("abstract"), F.lit("")) != ""
    source = F.when(full | sections, "full_text").when(abstract, "abstract").otherwise("none")
    return papers.withColumn("has_full_text", full).withColumn("has_sections", sections).withColumn("source", source)


def abstract_papers(papers: DataFrame, done: DataFrame | None = None, only_missing: bool = False, limit: int | None = None) -> DataFrame:
    """Papers to extract from their abstracts: with an abstract and, unless ``only_missing``, without full text or sections.

    ``done`` (doi): papers that are left out, being there already. ``limit`` counts eligible papers, in the order of doi.
    """
    rows = availability(papers).where(F.coalesce(F.trim("abstract"), F.lit("")) != "")
    if not only_missing:
        rows = rows.where(~F.col("has_full_text") & ~F.col("has_sections"))
    if done is not None:
        key = names.doi_key(F.col("doi"))
        rows = rows.withColumn("__k", key).join(done.select(key.alias("__k")).where("__k IS NOT NULL").distinct(), "__k", "left_anti").drop("__k")
    return rows if limit is None else rows.orderBy("doi").limit(limit)


def papers_metadata(want: DataFrame, evaluations: DataFrame, papers: DataFrame, keep_unfound: bool = True) -> DataFrame:
    """(doi, pmid, title, result, confidence_score) of wanted DOIs (keys): all their evaluations, else the paper with the defaults
    'unknown' and 0; DOIs that neither has are kept with nulls and an empty title, or dropped."""
    key = names.doi_key(F.col("doi"))
    e = evaluations.select(key.alias("doi"), "pmid", "title", "result", "confidence_score").join(want, "doi", "left_semi")
    rest = want.join(e.select("doi").distinct(), "doi", "left_anti")
    p = papers.groupBy(key.alias("doi")).agg(F.min("pmid").alias("pmid"), F.min("title").alias("title"), F.lit(True).alias("found"))
    other = rest.join(p, "doi", "left").where(F.lit(keep_unfound) | F.col("found"))
    title = F.when(F.col("found"), F.col("title")).otherwise("")
    return e.unionByName(other.select("doi", "pmid", title.alias("title"), F.lit("unknown").alias("result"), F.lit(0).alias("confidence_score")))


AVAILABLE = r"""SELECT doi, abstract, coalesce(trim(full_text), '') <> '' AS has_full_text, coalesce(trim(full_text_sections), '') <> '' AND regexp_replace(full_text_sections, '\s', '', 'g') NOT IN ('{}', '[]', 'null', '""') AS has_sections FROM papers"""


@query(f"SELECT doi, has_full_text, has_sections, CASE WHEN has_full_text OR has_sections THEN 'full_text' WHEN coalesce(trim(abstract), '') <> '' THEN 'abstract' ELSE 'none' END AS source FROM ({AVAILABLE})")
def text_sources(spark: SparkSession, d: str) -> DataFrame:
    return availability(_papers(spark, d)).select("doi", "has_full_text", "has_sections", "source")


@query(f"SELECT doi FROM ({AVAILABLE}) WHERE coalesce(trim(abstract), '') <> '' AND NOT has_full_text AND NOT has_sections")
def abstract_only(spark: SparkSession, d: str) -> DataFrame:
    return availability(_papers(spark, d)).where((F.col("source") == "abstract")).select("doi")


@query(f"SELECT has_full_text, has_sections, count(*) AS papers FROM ({AVAILABLE}) WHERE has_full_text OR has_sections OR coalesce(trim(abstract), '') = '' GROUP BY 1, 2")
def skipped_reasons(spark: SparkSession, d: str) -> DataFrame:
    return availability(_papers(spark, d)).where(F.col("source") != "abstract").groupBy("has_full_text", "has_sections").agg(F.count(F.lit(1)).alias("papers"))


CLEAN = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"
for _p, _b in (
    (" +", " "), (r"\n\s*\n\s*\n+", r"\n\n"), (r"\n\s*\d+\s*\n", r"\n"), (r"\n\s*(Fig\.|Figure|Table|Supplementary)\s+\d+[A-Za-z]?\s*[:\.]?\s*\n", r"\n"),
    (text.URL, ""), (r"\S+@\S+", ""), (r"(?i)doi:\s*\S+", ""), (r"^\s+|\s+$", ""),
):
    CLEAN = f"regexp_replace({CLEAN}, '{_p}', '{_b}', 'g')" if "\\n" not in _b else f"regexp_replace({CLEAN}, '{_p}', {' || '.join(['chr(10)'] * _b.count(chr(92) + 'n'))}, 'g')"


@query(f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def cleaned_documents(spark: SparkSession, d: str) -> DataFrame:
    """The cleaning rules over whole texts, with non-ASCII characters left out rather than decomposed."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_ascii(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("cleaned"))


@query()
def decomposed_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.clean_text(F.col("text"))).alias("chars"))


@query()
def documents_without_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.remove_references(F.col("text"))).alias("chars"))


@query()
def assembled_papers(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doi", F.length(text.assemble_sections(F.col("full_text_sections"))).alias("reduced"), F.length(text.assemble_sections_whole(F.col("full_text_sections"))).alias("whole"))


@query()
def preprocessed_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with the text for annotators, or the issue that keeps them out."""
    p = availability(_papers(spark, d))
    p = p.withColumn("processed", F.when(F.col("source") == "full_text", text.preprocessed(F.col("full_text"), F.col("full_text_sections"), F.col("abstract"))).when(F.col("source") == "abstract", F.col("abstract")))
    issue = F.when(F.col("processed").isNotNull(), "none").when(F.col("source") == "full_text", "empty after preprocessing").otherwise("no text")
    return p.select("doi", "source", F.length("processed").alias("chars"), issue.alias("issue"))


@query(r"""SELECT record_id, md5(trim(regexp_extract('```json' || chr(10) || payload || chr(10) || '```', '(?s)```(?:json)?\s*(.*?)\s*```', 1))) AS body FROM extraction_results WHERE coalesce(payload, '') <> ''""")
def unfenced_replies(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))
    return table(spark, d, "extraction_results").where(F.coalesce("payload", F.lit("")) != "").select("record_id", F.md5(text.unfenced(fenced)).alias("body"))


@query(r"""WITH f AS (SELECT record_id, CASE record_id % 3 WHEN 0 THEN '```json' || chr(10) || payload || chr(10) || '```' WHEN 1 THEN '```' || payload || '```' ELSE payload END AS p FROM extraction_results WHERE coalesce(payload, '') <> '')
SELECT record_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(trim(p), '^```json', ''), '^```', ''), '```$', ''))) AS body FROM f""")
def trimmed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a fence of either kind, or none."""
    r = table(spark, d, "extraction_results").where(F.coalesce("payload", F.lit("")) != "")
    p = F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).when(F.col("record_id") % 3 == 1, F.concat(F.lit("```"), "payload", F.lit("```"))).otherwise(F.col("payload"))
    return r.select("record_id", F.md5(text.trimmed_fence(p)).alias("body"))


@query("SELECT doi, lower(doi) AS of_file, replace(translate(title, '/ ', '__'), ':', '') AS title_file FROM papers")
def file_keys(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d)
    path = F.concat(F.lit("/answers/"), F.regexp_replace("doi", "/", "_"), F.lit(".json"))
    return p.select("doi", names.doi_of_file(path).alias("of_file"), names.file_name(F.col("title")).alias("title_file"))


@query(f"SELECT doi, title FROM papers WHERE {DOI.format('doi')} IN (SELECT {DOI.format('doi')} FROM theory_entries WHERE doi IS NOT NULL)")
def papers_with_mentions(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d).withColumn("k", names.doi_key(F.col("doi")))
    return p.join(table(spark, d, "theory_entries").select(names.doi_key(F.col("doi")).alias("k")).distinct(), "k", "left_semi").select("doi", "title")


@query(f"SELECT doi FROM papers p WHERE NOT EXISTS (SELECT 1 FROM extraction_results r WHERE {DOI.format('r.doi')} = {DOI.format('p.doi')})")
def papers_to_extract(spark: SparkSession, d: str) -> DataFrame:
    """Resume: papers without an extraction result."""
    done = table(spark, d, "extraction_results").select(names.doi_key(F.col("doi")).alias("k"))
    return sinks.pending(_papers(spark, d).select("doi", names.doi_key(F.col("doi")).alias("k")), done, ["k"]).select("doi")


@query()
def extracted_mentions(spark: SparkSession, d: str) -> DataFrame:
    return readers.parsed_payloads(table(spark, d, "extraction_results")).drop("key_concepts")


@query(f"""WITH s AS (SELECT id, {DOI.format('doi')} AS k, nullif(name, '') AS name, mode FROM theories), f AS (SELECT * FROM s WHERE mode LIKE '%propose%' OR name IS NULL), a AS (SELECT * FROM s WHERE NOT coalesce(mode LIKE '%propose%' OR name IS NULL, false))
SELECT id, k, name FROM f UNION ALL SELECT id, k, name FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.name IS NOT NULL AND f.k IS NOT DISTINCT FROM a.k)""")
def precedence_union(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a preferred source, and those of a second one for documents that the first has nothing on."""
    rows = table(spark, d, "theories").select("id", names.doi_key(F.col("doi")).alias("k"), F.nullif("name", F.lit("")).alias("name"), "mode")
    first = F.coalesce(F.col("mode").contains("propose") | F.col("name").isNull(), F.lit(False))
    return readers.with_precedence(rows.where(first), rows.where(~first), "k").select("id", "k", "name")


@query("SELECT doi, 'P' || lpad(row_number() OVER (ORDER BY doi)::VARCHAR, 6, '0') AS surrogate_id FROM (SELECT DISTINCT doi FROM papers)")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return readers.surrogate_ids(_papers(spark, d).select("doi").distinct(), "doi", prefix="P").select("doi", "surrogate_id")


@query(f"SELECT DISTINCT c AS label, {LEVEL} AS level FROM (SELECT confidence_is_theory AS c FROM theory_entries UNION ALL SELECT confidence_is_theory FROM theories)")
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "theory_entries").select("confidence_is_theory").union(table(spark, d, "theories").select("confidence_is_theory"))
    return both.select(F.col("confidence_is_theory").alias("label"), names.confidence_level(F.col("confidence_is_theory")).alias("level")).distinct()


@query(f"SELECT level, count(*) AS mentions, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent, level <> 'low' AS kept FROM (SELECT {LEVEL} AS level FROM (SELECT confidence_is_theory AS c FROM theory_entries)) GROUP BY level")
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "theory_entries").groupBy(names.confidence_level(F.col("confidence_is_theory")).alias("level")).agg(F.count(F.lit(1)).alias("mentions"))
    share = F.round(F.try_divide(100.0 * F.col("mentions"), F.sum("mentions").over(Window.partitionBy(F.lit(1)))), 4)
    return rows.select("level", "mentions", share.alias("percent"), (F.col("level") != "low").alias("kept"))


@query("SELECT id, least(coalesce(try_cast(nullif(regexp_extract(evidence, '([0-9]{1,2})', 1), '') AS INT), 0), 10) AS focus FROM theories")
def parsed_focus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "theories").select("id", names.focus(F.col("evidence")).alias("focus"))


@query("""WITH t AS (SELECT id, name, evidence, from_json(CASE WHEN json_valid(key_concepts) AND key_concepts LIKE '[%' THEN key_concepts ELSE '[]' END, '[{"concept": "VARCHAR", "description": "VARCHAR"}]') AS k FROM theories),
c AS (SELECT *, array_to_string(list_transform(list_filter(k, lambda x: coalesce(x.concept, '') <> ''), lambda x: x.concept || ': ' || coalesce(x.description, '')), ' | ') AS concepts FROM t)
SELECT id, md5(array_to_string(list_filter([name, concepts, evidence], lambda x: trim(x) <> ''), '. ')) AS enriched FROM c""")
def enriched_mentions(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<concept:string,description:string>>"
    k = F.from_json(F.when(F.col("key_concepts").startswith("[") & F.expr("try_parse_json(key_concepts)").isNotNull(), F.col("key_concepts")), kind)
    rows = table(spark, d, "theories").withColumn("k", F.coalesce(k, F.array().cast(kind)))  # concepts that can't be read are none
    return rows.select("id", F.md5(text.enriched_text(F.col("name"), F.col("k"), F.col("evidence"))).alias("enriched"))


@query("SELECT doc_id, (length(text) // 4 + 2000)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text"), 2000).cast("bigint").alias("tokens"))


@query(f"""WITH t AS (SELECT {DOI.format('doi')} AS k, id, name, coalesce(paper_focus, 0) AS f FROM theories), c AS (SELECT p.doi, t.id, coalesce(t.name, '') AS name, row_number() OVER (PARTITION BY p.doi ORDER BY t.f DESC, t.id) AS pos FROM papers p JOIN t ON {DOI.format('p.doi')} = t.k)
SELECT p.doi, (SELECT count(*) FROM c WHERE c.doi = p.doi) AS theories, coalesce((SELECT string_agg(name, '|' ORDER BY pos) FROM c WHERE c.doi = p.doi), '') AS names FROM papers p""")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their theories nested, highest focus first; papers without any have an empty list."""
    t = table(spark, d, "theories").select(names.doi_key(F.col("doi")).alias("k"), "id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("paper_focus", F.lit(0)).alias("f")).where("k IS NOT NULL")
    nested = sinks.nested_children(_papers(spark, d).select("doi", names.doi_key(F.col("doi")).alias("k")), t, "k", "theories", -F.col("f"), F.col("id"))
    return nested.select("doi", F.size("theories").alias("theories"), F.array_join(F.transform("theories", lambda x: x["name"]), "|").alias("names"))


@query(f"""WITH k AS (SELECT DISTINCT doi FROM papers WHERE doi IS NOT NULL ORDER BY md5('42|' || doi), doi LIMIT 50), t AS (SELECT {DOI.format('doi')} AS k, count(*) AS n FROM theories GROUP BY 1)
SELECT k.doi, t.n AS theories FROM k LEFT JOIN t ON {DOI.format('k.doi')} = t.k""")
def sampled_export(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 50 papers with the number of their theories (null: none)."""
    keys = sinks.sampled_keys(_papers(spark, d), "doi", 50).withColumn("k", names.doi_key(F.col("doi")))
    t = table(spark, d, "theories").groupBy(names.doi_key(F.col("doi")).alias("k")).agg(F.count(F.lit(1)).alias("theories"))
    return keys.join(t, "k", "left").select("doi", "theories")


@query("SELECT doi, pmid, title FROM papers ORDER BY doi LIMIT 100")
def table_dump(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doi", "pmid", "title").orderBy("doi").limit(100)


@query("SELECT doi, result FROM paper_evaluations WHERE result = 'doubted' AND coalesce(doi, '') <> '' ORDER BY doi, confidence_score LIMIT 5")
def doubted_few(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "paper_evaluations").where((F.col("result") == "doubted") & (F.coalesce("doi", F.lit("")) != ""))
    return e.orderBy(F.asc_nulls_last("doi"), F.asc_nulls_last("confidence_score")).limit(5).select("doi", "result")


@query(f"SELECT {DOI.format('doi')} AS k, 'old' AS version FROM papers p WHERE NOT EXISTS (SELECT 1 FROM paper_evaluations e WHERE {DOI.format('e.doi')} = {DOI.format('p.doi')}) UNION ALL SELECT {DOI.format('doi')}, arg_max(coalesce(result, '') || ':' || coalesce(confidence_score, -1), (coalesce(confidence_score, -1), coalesce(result, ''))) FROM paper_evaluations WHERE {DOI.format('doi')} IS NOT NULL GROUP BY 1")
def upserted_papers(spark: SparkSession, d: str) -> DataFrame:
    old = _papers(spark, d).select(names.doi_key(F.col("doi")).alias("k"), F.lit("old").alias("version"))
    e = table(spark, d, "paper_evaluations").select(names.doi_key(F.col("doi")).alias("k"), F.coalesce("result", F.lit("")).alias("r"), F.coalesce("confidence_score", F.lit(-1)).alias("c")).where("k IS NOT NULL")
    new = e.select("k", F.concat("r", F.lit(":"), F.col("c").cast("string")).alias("version"), "c", "r")
    return sinks.upsert_parents(old, new, "k", F.struct("c", "r")).select("k", "version")


@query(f"""WITH o AS (SELECT {DOI.format('doi')} AS k, name, id FROM theories WHERE doi IS NOT NULL), n AS (SELECT {DOI.format('doi')} AS k, original_name AS name, min(theory_id) AS t FROM theory_entries WHERE coalesce(doi, '') <> '' AND original_name IS NOT NULL GROUP BY 1, 2)
SELECT k, name, id::VARCHAR AS ref FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, name, t FROM n""")
def replaced_children(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "theories").where("doi IS NOT NULL").select(names.doi_key(F.col("doi")).alias("k"), "name", F.col("id").cast("string").alias("ref"))
    new = table(spark, d, "theory_entries").select(names.doi_key(F.col("doi")).alias("k"), F.col("original_name").alias("name"), F.col("theory_id").alias("ref")).where("k IS NOT NULL AND name IS NOT NULL")
    return sinks.replace_children(old, new, "k", ["k", "name"], F.col("ref"))


@query(f"""WITH n AS (SELECT {DOI.format('doi')} AS k, min_by(result, (coalesce(confidence_score, -1), coalesce(result, ''))) AS r FROM paper_evaluations WHERE coalesce(doi, '') <> '' GROUP BY 1)
SELECT {DOI.format('doi')} AS k, 'paper' AS r FROM papers UNION ALL SELECT k, r FROM n WHERE k NOT IN (SELECT {DOI.format('doi')} FROM papers)""")
def inserted_or_ignored(spark: SparkSession, d: str) -> DataFrame:
    old = _papers(spark, d).select(names.doi_key(F.col("doi")).alias("k"), F.lit("paper").alias("r"))
    new = table(spark, d, "paper_evaluations").select(names.doi_key(F.col("doi")).alias("k"), F.col("result").alias("r"), F.coalesce("confidence_score", F.lit(-1)).alias("o")).where("k IS NOT NULL")
    return sinks.insert_or_ignore(old, new.select("k", "r", "o"), ["k"], F.struct("o", F.coalesce("r", F.lit("")))).select("k", "r")


@query("SELECT theory_id, arg_max(coalesce(mode, ''), ingested_at) AS mode, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS seen FROM theory_entries GROUP BY 1")
def last_deliveries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries").select("theory_id", F.coalesce("mode", F.lit("")).alias("mode"), F.col("ingested_at").alias("seen"))
    return sinks.insert_or_replace(e, ["theory_id"], F.desc("seen")).withColumn("seen", F.date_format("seen", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT doi, NULL::VARCHAR AS result, title FROM papers UNION ALL SELECT doi, result, NULL FROM paper_evaluations")
def evolved_schema(spark: SparkSession, d: str) -> DataFrame:
    return sinks.evolved(_papers(spark, d).select("doi", "title"), table(spark, d, "paper_evaluations").select("doi", "result"))


@query(f"""SELECT CASE WHEN lvl = 'low' THEN 'invalid' WHEN coalesce(mapped_name, '') <> '' THEN 'mapped' WHEN mapping_confidence_stage1_5 IS NOT NULL THEN 'novel' ELSE 'unmatched' END AS category, count(*) AS mentions, round(avg(mapping_confidence_stage1_5), 6) AS confidence
FROM (SELECT *, {LEVEL} AS lvl FROM (SELECT *, confidence_is_theory AS c FROM theory_entries)) GROUP BY 1""")
def export_categories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries")
    category = (
        F.when(names.confidence_level(F.col("confidence_is_theory")) == "low", "invalid")
        .when(F.coalesce("mapped_name", F.lit("")) != "", "mapped").when(F.col("mapping_confidence_stage1_5").isNotNull(), "novel").otherwise("unmatched")
    )
    return e.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("mapping_confidence_stage1_5"), 6).alias("confidence"))


@query(f"SELECT round(avg(n), 6) AS mean, count(*) AS papers FROM (SELECT {DOI.format('doi')} AS k, count(*) AS n FROM theories WHERE coalesce(doi, '') <> '' GROUP BY 1)")
def theories_per_paper(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "theories").select(names.doi_key(F.col("doi")).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"), F.count(F.lit(1)).alias("papers"))


@query("SELECT doi, max(coalesce(confidence_score, -1)) AS confidence FROM paper_evaluations WHERE doi IS NOT NULL GROUP BY doi")
def best_evaluations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "paper_evaluations").where("doi IS NOT NULL").withColumn("confidence", F.coalesce("confidence_score", F.lit(-1)))
    return consolidate.tops(e, "doi", "confidence").select("doi", "confidence").distinct()
