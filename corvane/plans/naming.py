"""Queries on names: keys, list lookups, votes, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import annotate, batching, consolidate, matching
from corvane.plans.registry import query
from corvane.session import table

GENERIC = "|".join(names.GENERIC)
WS = r"[\s\p{Z}]"
SQUEEZE = "trim(regexp_replace({0}, '" + WS.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"



def _rr(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"


def fuzzy_sql(x: str) -> str:
    """The fuzzy key in SQL."""
    x = _rr(_strip(f"lower({x})"), WS + r"*[\(\[][a-z]{2,6}[0-9]*[\)\]]" + WS + "*", " ")
    x = _rr(_rr(x, r"[-_/\\()\[\]{}]", " "), "[‘’]", "'")
    x = _rr(SQUEEZE.format(x), "'s |s' ", " ")
    x = _rr(SQUEEZE.format(x), "'s|s'", "")
    return SQUEEZE.format(_rr(_rr(x, rf"\b({GENERIC})\b", ""), r"\b(of cellular|of|the|a|an)\b", ""))


def grouping_sql(x: str) -> str:
    x = _rr(_rr(_strip(x), WS + r"*[\(\[][A-Z]{2,6}[0-9]*[\)\]]" + WS + "*", " "), r"(?i)\bageing\b", "aging")
    return SQUEEZE.format(_rr(x, "(?i)" + WS + "+of" + WS + "+aging" + WS + "*$", ""))


def final_sql(x: str) -> str:
    base = _rr(_strip(x), r"(?i)\bageing\b", "aging")
    cut = _rr(base, "(?i)" + WS + "+of" + WS + "+aging" + WS + "*$", "")
    return f"CASE WHEN {x} = 'SINE Retrotransposon Activation Theory' THEN 'Retrotransposon Activation Theory' ELSE {SQUEEZE.format(f'CASE WHEN lower({x}) LIKE $${chr(37)}hallmark{chr(37)}$$ THEN {base} ELSE {cut} END')} END"


def voting_sql(x: str) -> str:
    out = f"rtrim({_strip(x)}, '.')"
    for a, b in (("Signalling", "Signaling"), ("signalling", "signaling"), ("Ageing", "Aging"), ("ageing", "aging")):
        out = f"replace({out}, '{a}', '{b}')"
    return SQUEEZE.format(out)


CLUSTERING = SQUEEZE.format(r"replace(regexp_replace(regexp_replace(lower(n), '[^\w\s]', '', 'g'), '\b(theory|hypothesis|model|framework|the)\b', '', 'g'), 'ageing', 'aging')")
def title_sql(x: str) -> str:
    """Every letter after a non-letter in upper case, all others in lower case."""
    one = rf"CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '\p{{L}}') THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END"
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: {one}), '')"


NAMES = "(SELECT DISTINCT original_name AS n FROM theory_entries WHERE original_name IS NOT NULL)"
ALIASES = "(SELECT ontology_id, name AS canonical, unnest(list_concat([name], coalesce(aliases, []))) AS alias, unnest(range(0, 1 + len(coalesce(aliases, [])))) AS p FROM ontology)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "theory_entries").select(F.col("original_name").alias("name")).where("name IS NOT NULL").distinct()


def _keys(spark: SparkSession, d: str, f) -> DataFrame:
    return _names(spark, d).select(F.col("name").alias("n"), f(F.col("name")).alias("key"))


@query(f"SELECT n, {fuzzy_sql('n')} AS key FROM {NAMES}")
def name_key_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.fuzzy_key)


@query(f"SELECT n, {grouping_sql('n')} AS key FROM {NAMES}")
def name_key_grouping(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.grouping_key_sql)


@query(f"SELECT n, {title_sql('g')} AS key FROM (SELECT n, {grouping_sql('n')} AS g FROM {NAMES})")
def name_key_titled(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.grouping_key)


@query(f"SELECT n, {final_sql('n')} AS key FROM {NAMES}")
def name_key_final(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.final_name)


@query(f"SELECT n, {CLUSTERING} AS key FROM {NAMES}")
def name_key_clustering(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.clustering_key)


@query(f"SELECT n, {voting_sql('n')} AS key FROM {NAMES}")
def name_key_voting(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, names.voting_key)


@query(rf"SELECT n, regexp_replace(n || ' (Batch 12)', '(?i){WS}*\(Batch\s+[0-9]+\){WS}*$', '') AS key FROM {NAMES}")
def name_without_batch(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, lambda n: names.strip_batch_suffix(F.concat(n, F.lit(" (Batch 12)"))))


ABBR = r"regexp_extract_all(n, '[\(\[]([A-Z]{2,6}[0-9]*)[\)\]]', 1)"


@query(f"SELECT n, array_to_string(list_sort({ABBR}), ',') AS abbreviations FROM {NAMES}")
def name_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select(F.col("name").alias("n"), F.array_join(F.array_sort(names.abbreviations(F.col("name"))), ",").alias("abbreviations"))


def core_sql(x: str) -> str:
    x = fuzzy_sql(x)
    for s in names.SUFFIXES:
        x = f"replace({x}, '{s}', '')"
    stop = ", ".join(f"'{w}'" for w in names.CORE_STOP)
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: length(t) > 2 AND t NOT IN ({stop}))))"


@query(f"SELECT n, array_to_string({core_sql('n')}, ' ') AS tokens FROM {NAMES}")
def name_core_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select(F.col("name").alias("n"), F.array_join(names.core_tokens(F.col("name")), " ").alias("tokens"))


@query(f"SELECT ontology_id, p::INT AS p, canonical, alias FROM {ALIASES}")
def searchable_names(spark: SparkSession, d: str) -> DataFrame:
    return matching.searchable(table(spark, d, "ontology")).select("pos.ontology_id", "pos.p", "canonical", "alias")


EXACT = f"(SELECT {fuzzy_sql('alias')} AS key, arg_max(canonical, ontology_id * 1000 + p) AS canonical FROM {ALIASES} GROUP BY 1)"
SHORT = "(SELECT upper(trim(a)) AS abbr, arg_max(name, ontology_id) AS canonical FROM (SELECT ontology_id, name, unnest(abbreviations) AS a FROM ontology) GROUP BY 1)"


@query(f"SELECT n AS name, e.canonical FROM {NAMES} JOIN {EXACT} e ON {fuzzy_sql('n')} = e.key")
def exact_alias_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_exact(_names(spark, d), table(spark, d, "ontology"))


@query(f"SELECT n AS name, arg_min(s.canonical, i) AS canonical FROM (SELECT n, unnest({ABBR}) AS a, generate_subscripts({ABBR}, 1) AS i FROM {NAMES}) JOIN {SHORT} s ON a = s.abbr GROUP BY 1")
def abbreviation_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_abbreviation(_names(spark, d), table(spark, d, "ontology")).select("name", "canonical")


@query()
def fuzzy_match_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviation, exact, fuzzy: every distinct name of the mentions with its match or its nearest alias."""
    return matching.match_names(_names(spark, d), table(spark, d, "ontology")).withColumn("score", F.round("score", 4))


@query(f"SELECT n AS name FROM {NAMES} WHERE n <> '' AND n NOT IN (SELECT name FROM ontology)")
def names_not_listed(spark: SparkSession, d: str) -> DataFrame:
    return matching.not_listed(_names(spark, d), table(spark, d, "ontology"))


@query(f"SELECT n AS name FROM {NAMES} WHERE n <> '' AND lower(n) NOT IN (SELECT lower(name) FROM ontology)")
def names_not_listed_folded(spark: SparkSession, d: str) -> DataFrame:
    return matching.not_listed(_names(spark, d), table(spark, d, "ontology"), fold_case=True)


@query("SELECT count(*) AS names, round(avg(n), 6) AS mean, max(n) AS largest FROM (SELECT normalized_name, count(*) AS n FROM theory_entries WHERE coalesce(normalized_name, '') <> '' GROUP BY 1)")
def name_group_stats(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "theory_entries").where(F.coalesce("normalized_name", F.lit("")) != "").groupBy("normalized_name").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("names"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("largest"))


@query(f"""WITH v AS (SELECT {voting_sql('normalized_name')} AS k, mapped_name, count(*) AS votes, min(theory_id) AS f, avg(mapping_confidence_stage1_5) AS c FROM theory_entries WHERE coalesce(mapped_name, '') <> '' AND normalized_name IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(votes) OVER (PARTITION BY k) AS voters, row_number() OVER (PARTITION BY k ORDER BY votes DESC, f) AS n FROM v)
SELECT k, mapped_name, votes, voters::BIGINT AS voters, round(c, 6) AS confidence FROM r WHERE n = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries").where(F.coalesce("mapped_name", F.lit("")) != "").where("normalized_name IS NOT NULL")
    e = e.select(names.voting_key(F.col("normalized_name")).alias("k"), "mapped_name", "theory_id", "mapping_confidence_stage1_5")
    return consolidate.majority(e, "k", "mapped_name", "theory_id", "mapping_confidence_stage1_5").withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT {voting_sql('normalized_name')} AS k, count(DISTINCT mapped_name) AS mapped FROM theory_entries WHERE coalesce(mapped_name, '') <> '' AND normalized_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT mapped_name) > 1")
def inconsistent_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries").where(F.coalesce("mapped_name", F.lit("")) != "").where("normalized_name IS NOT NULL")
    return e.groupBy(names.voting_key(F.col("normalized_name")).alias("k")).agg(F.count_distinct("mapped_name").alias("mapped")).where("mapped > 1")


PAPER = "coalesce(nullif(lower(doi), ''), nullif(pmid, ''), substr(theory_id, 1, 6))"


@query(f"SELECT coalesce(mapped_name, '') AS canonical, {PAPER} AS paper, min(theory_id) AS theory_id FROM theory_entries GROUP BY 1, 2")
def first_per_paper(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries").select(F.coalesce("mapped_name", F.lit("")).alias("canonical"), F.expr(PAPER).alias("paper"), "theory_id")
    return consolidate.first_of(e, ["canonical", "paper"], "theory_id")


@query(f"""SELECT mapped_name AS canonical, count(*) AS mentions, count(DISTINCT {PAPER}) AS papers, count(DISTINCT original_name) AS variants, array_to_string(list_slice(list_sort(list(DISTINCT theory_id)), 1, 10), ',') AS first_ids
FROM theory_entries WHERE coalesce(mapped_name, '') <> '' GROUP BY 1""")
def by_canonical(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "theory_entries").where(F.coalesce("mapped_name", F.lit("")) != "").withColumn("paper", F.expr(PAPER))
    stats = e.groupBy(F.col("mapped_name").alias("canonical")).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("paper").alias("papers"), F.count_distinct("original_name").alias("variants"))
    # the first ten of each of 64 parts, then of each name, so that a name with most of the rows is no long task
    rank = lambda *by: F.row_number().over(Window.partitionBy("mapped_name", *by).orderBy("theory_id"))
    few = e.select("mapped_name", "theory_id").distinct().withColumn("part", F.pmod(F.xxhash64("theory_id"), F.lit(64)))
    few = few.withColumn("r", rank("part")).where("r <= 10").withColumn("r", rank()).where("r <= 10").groupBy(F.col("mapped_name").alias("canonical")).agg(F.array_join(F.array_sort(F.collect_list("theory_id")), ",").alias("first_ids"))
    return stats.join(few, "canonical")


@query("SELECT n AS names_per_target, count(*) AS targets FROM (SELECT mapped_name, count(DISTINCT normalized_name) AS n FROM theory_entries WHERE coalesce(mapped_name, '') <> '' GROUP BY 1) GROUP BY 1")
def mapping_value_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "theory_entries").where(F.coalesce("mapped_name", F.lit("")) != "").groupBy("mapped_name").agg(F.count_distinct("normalized_name").alias("names_per_target"))
    return g.groupBy("names_per_target").agg(F.count(F.lit(1)).alias("targets"))


@query("SELECT theory_id, coalesce(m.v, e.normalized_name) AS name FROM (SELECT DISTINCT theory_id, normalized_name FROM theory_entries) e LEFT JOIN (SELECT normalized_name AS k, min(mapped_name) AS v FROM theory_entries WHERE coalesce(mapped_name, '') <> '' GROUP BY 1) m ON e.normalized_name = m.k")
def identity_default_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries")
    mapping = e.where(F.coalesce("mapped_name", F.lit("")) != "").groupBy(F.col("normalized_name").alias("name")).agg(F.min("mapped_name").alias("mapped"))
    return consolidate.remapped(e.select("theory_id", F.col("normalized_name").alias("name")).distinct(), mapping).select("theory_id", "name")


@query("SELECT upper(substr(n, 1, 1)) AS initial, count(*) AS names FROM " + NAMES + " WHERE n <> '' GROUP BY 1")
def alphabetical_groups(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).where("name <> ''").groupBy(batching.initial(F.col("name")).alias("initial")).agg(F.count(F.lit(1)).alias("names"))


@query()
def alphabetical_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.alphabetical(_names(spark, d), 100)


@query(f"SELECT batches, n AS names, 0::BIGINT AS oversized, 0::BIGINT AS torn FROM (VALUES ('alphabetical'), ('topped up'), ('similar')) v(batches), (SELECT count(*) AS n, count(*) FILTER (n NOT IN (SELECT name FROM ontology)) AS open FROM {NAMES} WHERE n <> '') WHERE batches <> 'similar' UNION ALL SELECT 'similar', count(*), 0, 0 FROM {NAMES} WHERE n <> '' AND n NOT IN (SELECT name FROM ontology)")
def batch_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether batches hold every name once and none is larger than allowed."""
    every = _names(spark, d)
    out = None
    for label, made, most in (
        ("alphabetical", batching.alphabetical(every, 100), 100), ("topped up", batching.alphabetical(every, 100, top_up=True), 100),
        ("similar", batching.similar_batches(matching.not_listed(every, table(spark, d, "ontology")), 20), 20),
    ):
        made = made.select(F.col("batch").cast("string").alias("batch"), "name")
        over = made.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > most).alias("oversized"), F.sum("n").alias("names"))
        torn = made.groupBy("name").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
        one = over.withColumn("one", F.lit(1)).join(torn.withColumn("one", F.lit(1)), "one").select(F.lit(label).alias("batches"), "names", "oversized", "torn")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def topped_up_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.alphabetical(_names(spark, d), 100, top_up=True)


@query("SELECT name, ((row_number() OVER (PARTITION BY category ORDER BY name) - 1) // 5 + 1)::INT AS batch, ((row_number() OVER (PARTITION BY category ORDER BY name) - 1) % 5 + 1)::INT AS place FROM ontology")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.fixed(table(spark, d, "ontology"), 5, ["category"], "name").select("name", "batch", "place")


@query("""WITH r AS (SELECT category, ontology_id, row_number() OVER (PARTITION BY category ORDER BY ontology_id) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM ontology),
p AS (SELECT *, ceil(n / 26.0)::BIGINT AS parts FROM r), q AS (SELECT *, n // parts AS base, n % parts AS extra FROM p)
SELECT ontology_id, (CASE WHEN r < extra * (base + 1) THEN r // (base + 1) ELSE extra + (r - extra * (base + 1)) // greatest(base, 1) END + 1)::INT AS batch FROM q""")
def even_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.even(table(spark, d, "ontology"), 26, "category", "ontology_id").select("ontology_id", "batch")


@query("""SELECT normalized_name, theory_id, rank::INT AS rank FROM (SELECT normalized_name, theory_id, row_number() OVER (PARTITION BY normalized_name ORDER BY md5('42|' || theory_id), theory_id) AS rank FROM (SELECT DISTINCT normalized_name, theory_id FROM theory_entries WHERE normalized_name IS NOT NULL)) WHERE rank <= 4""")
def name_exemplars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "theory_entries").where("normalized_name IS NOT NULL").select("normalized_name", "theory_id").distinct()
    return batching.exemplars(e, "normalized_name", "theory_id").select("normalized_name", "theory_id", "rank")


@query()
def similarity_batches(spark: SparkSession, d: str) -> DataFrame:
    """The names of the mentions that the list does not hold."""
    return batching.similar_batches(matching.not_listed(_names(spark, d), table(spark, d, "ontology")), 20)


@query("SELECT category, subcategory, name, alias FROM (SELECT category, subcategory, name, unnest(coalesce(aliases, [])) AS alias FROM ontology)")
def hierarchy_flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ontology").select("category", "subcategory", "name", F.explode("aliases").alias("alias"))


@query("SELECT category, subcategory, count(*) AS entries, sum(len(coalesce(aliases, [])))::BIGINT AS aliases FROM ontology GROUP BY ROLLUP (category, subcategory)")
def hierarchy_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ontology").withColumn("k", F.coalesce(F.size("aliases"), F.lit(0)))
    return o.rollup("category", "subcategory").agg(F.count(F.lit(1)).alias("entries"), F.sum("k").alias("aliases"))


@query("""WITH low AS (SELECT category, subcategory, list({'name': name, 'aliases': coalesce(aliases, [])} ORDER BY name) AS entries FROM ontology GROUP BY ALL)
SELECT category, to_json(list({'subcategory': subcategory, 'entries': entries} ORDER BY subcategory))::VARCHAR AS children FROM low GROUP BY 1""")
def hierarchy_nested(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "ontology").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    low = o.groupBy("category", "subcategory").agg(F.array_sort(F.collect_list(F.struct("name", "aliases"))).alias("entries"))
    return low.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("subcategory", "entries"))).alias("children")).select("category", F.to_json("children").alias("children"))


@query()
def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    return annotate.keywords(table(spark, d, "papers").where("abstract IS NOT NULL"), "doi", "abstract")


@query(f"SELECT n AS name, CASE WHEN length(n) % 7 > 0 THEN coalesce(nullif({title_sql('s')}, ''), n) ELSE n END AS mapped FROM (SELECT n, {_strip('n')} AS s FROM {NAMES}) WHERE n <> '' AND n NOT IN (SELECT name FROM ontology)")
def annotated_names(spark: SparkSession, d: str) -> DataFrame:
    """Names mapped by an annotator (here: a rule), with retries and identity for what stays open."""
    todo = matching.not_listed(_names(spark, d), table(spark, d, "ontology"))

    def rule(batches):
        for pdf in batches:
            pdf = pdf[pdf.name.str.len() % 7 > 0]  # a rule that leaves some names unanswered
            yield pdf.assign(mapped=pdf.name.str.strip().str.title())[["name", "mapped"]]

    good, _ = annotate.annotate(todo, rule, "name string, mapped string", ["name"], F.coalesce("mapped", F.lit("")) != "")
    return annotate.with_fallback(todo, good)
