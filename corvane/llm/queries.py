"""Registered queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import canonical, copies, leak, mixture, packing, residue, sampling
from corvane.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- problem 1


def _inline(sql: str) -> str:
    """Write out @(x), the bare text of x."""
    out, i = "", 0
    while (j := sql.find("@(", i)) >= 0:
        k, depth = j + 2, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out += sql[i:j] + "regexp_replace(lower(" + sql[j + 2 : k - 1] + r"), '[\s\p{Z}\p{C}\p{P}]+', '', 'g')"
        i = k
    return out + sql[i:]


@query(_inline(r"""WITH e AS (SELECT DISTINCT theory_id, regexp_replace(lower(doi), '[\s\p{Z}\p{C}\p{P}]+', '', 'g') AS d,
    regexp_replace(lower(original_name), '[\s\p{Z}\p{C}\p{P}]+', '', 'g') AS n FROM theory_entries
  WHERE coalesce(doi, '') <> '' AND regexp_matches(original_name, '[\p{L}\p{N}]')),
t AS (SELECT id, concat_ws('|', coalesce('=' || @(doi), '~'), coalesce('=' || @(name), '~'), coalesce('=' || @(mode), '~'), coalesce('=' || @(evidence), '~'),
    coalesce('=' || @(confidence_is_theory), '~'), coalesce('=' || @(criteria_reasoning), '~'), coalesce('=' || paper_focus::VARCHAR, '~'),
    CASE WHEN key_concepts IS NULL THEN '~' WHEN json_valid(key_concepts) AND key_concepts LIKE '[%' THEN 'j' || array_to_string(list_transform(from_json(key_concepts, '["MAP(VARCHAR, VARCHAR)"]'),
      lambda m: array_to_string(list_sort(list_transform(map_entries(m), lambda x: @(x.key) || '^' || coalesce('=' || @(x.value), '~'))), '#')), '##') ELSE 't' || @(key_concepts) END) AS c
  FROM theories)
SELECT 'theory_entries' AS table_name, m AS first_key, theory_id AS copy_key FROM (SELECT theory_id, min(theory_id) OVER (PARTITION BY d, n) AS m FROM e) WHERE theory_id <> m
UNION ALL SELECT 'theories', m::VARCHAR, id::VARCHAR FROM (SELECT id, min(id) OVER (PARTITION BY c) AS m FROM t) WHERE id <> m"""))
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies_found(table(spark, d, "theories"), table(spark, d, "theory_entries"))


@query(r"""SELECT doi AS canonical_doi, n AS canonical_original_name, min(theory_id) AS first_key, count(*) AS copies FROM
(SELECT theory_id, regexp_replace(lower(doi), '[\s\p{Z}\p{C}\p{P}]+', '', 'g') AS doi, regexp_replace(lower(original_name), '[\s\p{Z}\p{C}\p{P}]+', '', 'g') AS n
 FROM theory_entries WHERE coalesce(doi, '') <> '' AND regexp_matches(original_name, '[\p{L}\p{N}]')) GROUP BY 1, 2""")
def p1_entry_groups(spark: SparkSession, d: str) -> DataFrame:
    return copies.entry_copies(table(spark, d, "theory_entries")).groups.drop("spellings")


@query(_inline(r"""WITH t AS (SELECT id, doi, name, mode, evidence, confidence_is_theory, criteria_reasoning, paper_focus, key_concepts, concat_ws('|', coalesce('=' || @(doi), '~'), coalesce('=' || @(name), '~'), coalesce('=' || @(mode), '~'), coalesce('=' || @(evidence), '~'),
    coalesce('=' || @(confidence_is_theory), '~'), coalesce('=' || @(criteria_reasoning), '~'), coalesce('=' || paper_focus::VARCHAR, '~'),
    CASE WHEN key_concepts IS NULL THEN '~' WHEN json_valid(key_concepts) AND key_concepts LIKE '[%' THEN 'j' || array_to_string(list_transform(from_json(key_concepts, '["MAP(VARCHAR, VARCHAR)"]'),
      lambda m: array_to_string(list_sort(list_transform(map_entries(m), lambda x: @(x.key) || '^' || coalesce('=' || @(x.value), '~'))), '#')), '##') ELSE 't' || @(key_concepts) END) AS c
  FROM theories WHERE id IS NOT NULL)
SELECT min(id) AS first_key, count(*) AS copies, count(DISTINCT (doi, name, mode, evidence, confidence_is_theory, criteria_reasoning, paper_focus, key_concepts)) AS spellings FROM t GROUP BY c"""))
def p1_theory_groups(spark: SparkSession, d: str) -> DataFrame:
    return copies.theory_copies(table(spark, d, "theories")).groups.select("first_key", "copies", "spellings")


# ---- problem 2


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.pairs_found(table(spark, d, "theories"))


@query()
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mixture.all_clusters(table(spark, d, "theories"))


@query()
def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Every theory with its class (equal concepts) and its cluster."""
    return mixture.members(table(spark, d, "theories"))


@query()
def p2_class_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between classes of different texts."""
    return mixture.class_links(table(spark, d, "theories"))


@query("SELECT count(*) AS records, count(*) AS members, 0::BIGINT AS in_several, 0::BIGINT AS loose_links FROM (SELECT DISTINCT id FROM theories WHERE id IS NOT NULL)")
def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether every theory is in one cluster, and every pair found within one."""
    theories = table(spark, d, "theories")
    held = cut(mixture.members(theories))
    of = held.groupBy("id").agg(F.min("cluster_id").alias("c"), F.count(F.lit(1)).alias("n"))
    pairs = mixture.pairs_found(theories)
    loose = pairs.join(of.select(F.col("id").alias("first_id"), F.col("c").alias("a")), "first_id").join(of.select(F.col("id").alias("second_id"), F.col("c").alias("b")), "second_id").agg(F.count_if(F.col("a") != F.col("b")).alias("loose_links"))
    counted = of.agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("n") > 1).alias("in_several"))
    records = theories.where("id IS NOT NULL").agg(F.count_distinct("id").alias("records"))
    one = F.lit(1).alias("one")
    return records.select("*", one).join(counted.select("*", one), "one").join(loose.select("*", one), "one").drop("one")


# ---- problem 4


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.names_found(table(spark, d, "theory_entries"), table(spark, d, "ontology"))


@query()
def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(table(spark, d, "theory_entries"), table(spark, d, "ontology"))


@query("""WITH m AS (SELECT DISTINCT theory_id, unnest([original_name, mapped_name, match_result.canonical_name]) AS v, unnest(['original_name', 'mapped_name', 'canonical_name']) AS field FROM theory_entries WHERE theory_id IS NOT NULL)
SELECT field, count(*) AS mentions FROM m WHERE coalesce(v, '') <> '' GROUP BY 1""")
def p4_conserves(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each field, mapped and unmapped ones together."""
    entries, listed = table(spark, d, "theory_entries"), table(spark, d, "ontology")
    rows = cut(canonical.mentions(entries))
    matched = cut(canonical.match_values(cut(rows.select("value").distinct()), listed))
    mapped = rows.join(matched, "value").groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    open_ = rows.join(matched.select("value"), "value", "left_anti").groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return mapped.unionByName(open_).groupBy("field").agg(F.sum("n").alias("mentions"))


# ---- problem 5

SAMPLE = """WITH u AS (SELECT {unit} AS unit, strftime(min(ingested_at), '%Y-%m-%d') AS batch FROM theory_entries WHERE coalesce({unit}, '') <> '' GROUP BY 1),
h AS (SELECT *, md5('{salt}|' || unit) AS h FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY h, unit) AS rank, count(*) OVER (PARTITION BY batch) AS n FROM h)
SELECT unit AS {unit}, batch FROM r WHERE CASE WHEN batch IS NULL THEN ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0 < 0.1 ELSE rank <= ceil(0.1 * n - 1e-9) END"""


@query(SAMPLE.format(unit="theory_id", salt="corvane-id-1"))
def p5_sample_by_id(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_id(table(spark, d, "theory_entries"))


@query(SAMPLE.format(unit="normalized_name", salt="corvane-name-1"))
def p5_sample_by_name(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by_name(table(spark, d, "theory_entries"))


@query(f"""SELECT e.theory_id, e.normalized_name, count(*) AS deliveries FROM theory_entries e JOIN ({SAMPLE.format(unit="normalized_name", salt="corvane-name-1")}) s
  USING (normalized_name) GROUP BY 1, 2""")
def p5_rows_of_sampled_names(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "theory_entries")
    rows = sampling.rows_of_names(entries, sampling.sample_by_name(entries))
    return rows.groupBy("theory_id", "normalized_name").agg(F.count(F.lit(1)).alias("deliveries"))


# ---- problem 7


@query()
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


@query()
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack_documents(table(spark, d, "documents")))


@query("SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS split_needlessly, 0::BIGINT AS lost, true AS well_filled FROM documents")
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing is one: nothing lost, no container overfull, no two pieces in one place, no needless split, within 3 % of the least number of containers."""
    docs = table(spark, d, "documents")
    packed = packing.pack_documents(docs)
    lengths = packing.token_lengths(docs).groupBy("doc_id").agg(F.sum("tokens").alias("want"))
    return packing.checks(packed, lengths, docs.count())


# ---- problem 8


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query()
def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how many hold a smaller part."""
    found = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_if(F.col("level") == "passage").alias("documents"), F.count_if(F.col("level") == "part").alias("parts"), F.round(F.max("cover"), 2).alias("most"))


# ---- problem 9


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_found(table(spark, d, "documents"))


@query()
def p9_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_corpus(table(spark, d, "documents")).select("doc_id", "lang", "source", "n_chars")


@query("SELECT count(*) AS documents, 0::BIGINT AS in_both FROM documents")
def p9_conserves(spark: SparkSession, d: str) -> DataFrame:
    """Documents, the clean ones and those with residue together."""
    docs = table(spark, d, "documents")
    found, clean = cut(residue.residue_found(docs)), residue.clean_corpus(docs).select("doc_id")
    both = found.join(clean, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("in_both"), F.lit(1).alias("one"))
    dirty = docs.select("doc_id").join(found, "doc_id", "left_semi")
    return clean.unionByName(dirty).agg(F.count(F.lit(1)).alias("documents"), F.lit(1).alias("one")).join(both, "one").select("documents", "in_both")


@query()
def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = residue.residue(table(spark, d, "documents")).select(F.explode("kinds").alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
