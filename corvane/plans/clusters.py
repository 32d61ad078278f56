"""Queries on stored cluster splits: conservation, health, verdicts, reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import annotate, consolidate, quality
from corvane.plans.registry import query
from corvane.plans.summaries import ASSIGNED, MENTION, assigned, mentions
from corvane.session import table
from corvane.sources import sinks

OK = f"(SELECT * FROM {ASSIGNED} WHERE coalesce(theory_id, '') <> '' AND cluster_name IS NOT NULL)"
LISTED = "(SELECT DISTINCT cluster_name, a.theory_id FROM (SELECT cluster_name, unnest(batch_result.original_format.theory_assignments) AS a FROM stage6_batches) WHERE coalesce(a.theory_id, '') <> '' AND cluster_name IS NOT NULL)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).where("coalesce(theory_id, '') <> '' AND cluster_name IS NOT NULL")


def _requested(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a split was asked for, as its original reply lists them."""
    rows = table(spark, d, "stage6_batches").select("cluster_name", F.explode("batch_result.original_format.theory_assignments").alias("a"))
    return rows.select("cluster_name", "a.theory_id").where("coalesce(theory_id, '') <> '' AND cluster_name IS NOT NULL").distinct()


@query(f"""WITH r AS (SELECT DISTINCT theory_id FROM {LISTED}), a AS (SELECT theory_id, count(*) AS k FROM {OK} GROUP BY 1)
SELECT count(*) FILTER (a.k IS NULL) AS missing, count(*) FILTER (r.theory_id IS NULL) AS extra, count(*) FILTER (a.k > 1) AS duplicates FROM r FULL JOIN a USING (theory_id)""".replace("FILTER (r.theory_id IS NULL)", "FILTER (NOT EXISTS (SELECT 1 FROM r r2 WHERE r2.theory_id = a.theory_id) AND a.k IS NOT NULL)"))
def conservation(spark: SparkSession, d: str) -> DataFrame:
    return quality.conservation(_requested(spark, d), _assigned(spark, d), "theory_id")


@query(f"SELECT theory_id, count(*) AS n FROM {OK} GROUP BY 1 HAVING count(*) > 1")
def ids_in_several_places(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicated(_assigned(spark, d), "theory_id")


STATUS = """(SELECT cluster_name, batch_id * 1000 + s.i AS sub, batch_result.subclusters[s.i].status AS status, unnest(batch_result.subclusters[s.i].theory_ids) AS theory_id
  FROM stage6_batches, unnest(range(1, len(batch_result.subclusters) + 1)) AS s(i) WHERE cluster_name IS NOT NULL)"""


@query(f"""WITH s AS (SELECT * FROM {STATUS} WHERE coalesce(theory_id, '') <> ''), names AS (SELECT cluster_name FROM s UNION SELECT cluster_name FROM {LISTED}),
e AS (SELECT cluster_name, list(DISTINCT theory_id) AS expected FROM {LISTED} GROUP BY 1), p AS (SELECT cluster_name, list(DISTINCT theory_id) AS processed, count(DISTINCT sub) FILTER (status = 'singleton_warning') AS warnings, count(*) FILTER (status = 'singleton_warning') AS in_warnings FROM s GROUP BY 1),
j AS (SELECT cluster_name, coalesce(expected, []) AS x, coalesce(processed, []) AS y, coalesce(warnings, 0) AS warnings, coalesce(in_warnings, 0) AS in_warnings FROM names LEFT JOIN e USING (cluster_name) LEFT JOIN p USING (cluster_name)),
h AS (SELECT *, len(x) AS requested, len(y) AS assigned, len(list_filter(x, lambda i: NOT list_contains(y, i))) AS missing, len(list_filter(y, lambda i: NOT list_contains(x, i))) AS extra, CASE WHEN len(x) > 0 THEN in_warnings / len(x) ELSE 0 END AS rate FROM j)
SELECT cluster_name, requested, assigned, missing, extra, warnings, in_warnings, round(rate, 6) AS rate,
  CASE WHEN missing > 0 OR extra > 0 OR requested <> assigned OR assigned = 0 THEN 'critical' WHEN rate > 0.3 THEN 'warning' ELSE 'ok' END AS severity FROM h""")
def checkpoint_health(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "stage6_batches").where("cluster_name IS NOT NULL").select("cluster_name", "batch_id", F.posexplode("batch_result.subclusters").alias("pos", "s"))
    listed = b.select("cluster_name", F.struct("batch_id", "pos").alias("sub"), "s.status", F.explode("s.theory_ids").alias("theory_id")).where("theory_id <> ''")
    return quality.health(_requested(spark, d), listed).withColumn("rate", F.round("rate", 6))


STARTED = f"(SELECT DISTINCT cluster_name, theory_id FROM {ASSIGNED} JOIN stage6_batches USING (batch_id, cluster_name) WHERE coalesce(theory_id, '') <> '' AND cluster_name IS NOT NULL AND batch_num = 1)"


def _started(spark: SparkSession, d: str) -> DataFrame:
    """What the first batch of each cluster assigned: a run that stopped there."""
    first = table(spark, d, "stage6_batches").where("batch_num = 1").select("batch_id")
    return _assigned(spark, d).join(first, "batch_id", "left_semi")


@query(f"""WITH r AS {LISTED}, a AS {STARTED}, m AS (SELECT * FROM r ANTI JOIN a USING (cluster_name, theory_id)), n AS (SELECT cluster_name, count(*) AS n FROM r GROUP BY 1), k AS (SELECT cluster_name, count(*) AS k FROM m GROUP BY 1)
SELECT m.cluster_name, m.theory_id, round(k * 1.0 / n, 6) AS share FROM m JOIN n USING (cluster_name) JOIN k USING (cluster_name)""")
def missing_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a run lacks which stopped after the first batches, with their share of the cluster."""
    return quality.missing_ids(_requested(spark, d), _started(spark, d)).withColumn("share", F.round("share", 6))


@query(f"""WITH r AS {LISTED}, a AS {STARTED}, m AS (SELECT * FROM r ANTI JOIN a USING (cluster_name, theory_id)), n AS (SELECT cluster_name, count(*) AS n FROM r GROUP BY 1), k AS (SELECT cluster_name, count(*) AS k FROM m GROUP BY 1),
f AS (SELECT m.cluster_name, m.theory_id, k * 1.0 / n AS share, row_number() OVER (PARTITION BY m.cluster_name ORDER BY m.theory_id) AS i FROM m JOIN n USING (cluster_name) JOIN k USING (cluster_name))
SELECT printf('%s%s%.1f %%%s%s', cluster_name, chr(9), share * 100, chr(9), theory_id) AS line FROM f WHERE i <= 20""")
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of missing ids, clusters with the highest share first."""
    return sinks.missing_report(quality.missing_ids(_requested(spark, d), _started(spark, d)))


@query(f"""WITH r AS {LISTED}, a AS {STARTED}, w AS (SELECT DISTINCT normalized_name AS cluster_name, theory_id FROM {MENTION} WHERE normalized_name IS NOT NULL), m AS (SELECT * FROM r ANTI JOIN a USING (cluster_name, theory_id))
SELECT m.cluster_name, w.cluster_name AS other, count(DISTINCT m.theory_id) AS ids FROM m JOIN w ON w.theory_id = m.theory_id AND w.cluster_name <> m.cluster_name GROUP BY 1, 2""")
def missing_found_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Ids that such a run lacks, by the names under which the mentions have them."""
    other = mentions(spark, d).where("normalized_name IS NOT NULL").select(F.col("normalized_name").alias("cluster_name"), "theory_id")
    return quality.found_elsewhere(quality.missing_ids(_requested(spark, d), _started(spark, d)), other)


@query(f"SELECT theory_id, arg_min(cluster_name, batch_id) AS cluster_name FROM {OK} WHERE theory_id IN (SELECT theory_id FROM {MENTION} WHERE doi IS NULL) GROUP BY 1")
def first_container(spark: SparkSession, d: str) -> DataFrame:
    lost = mentions(spark, d).where("doi IS NULL").select("theory_id")
    return quality.first_container(lost, _assigned(spark, d).withColumnRenamed("batch_id", "pos"))


SUBS = f"(SELECT cluster_name, subcluster_name, theory_id FROM {OK})"


@query(f"""WITH a AS {SUBS}, r AS {LISTED}, s AS (SELECT cluster_name, count(*) AS subs, count(*) FILTER (n < 2) AS small FROM (SELECT cluster_name, subcluster_name, count(theory_id) AS n FROM a GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT cluster_name, theory_id, count(*) AS k FROM a GROUP BY 1, 2), i AS (SELECT coalesce(r.cluster_name, k.cluster_name) AS cluster_name, r.theory_id AS rid, k.k FROM r FULL JOIN k ON r.cluster_name = k.cluster_name AND r.theory_id = k.theory_id),
c AS (SELECT cluster_name, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (rid IS NULL) AS extra, count(*) FILTER (k > 1) AS duplicates FROM i GROUP BY 1)
SELECT cluster_name, CASE WHEN coalesce(subs, 0) = 0 THEN 'empty' WHEN extra > 0 THEN 'extra' WHEN duplicates > 0 THEN 'duplicate' WHEN small = subs THEN 'all_small' WHEN small > 0 OR missing > 0 THEN 'singletons' ELSE 'valid' END AS verdict,
  missing, extra, duplicates, coalesce(small, 0) AS small FROM c LEFT JOIN s USING (cluster_name)""")
def split_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return annotate.check_split(_requested(spark, d), _assigned(spark, d))


@query(f"""WITH a AS (SELECT DISTINCT * FROM {SUBS}), n AS (SELECT *, count(*) OVER (PARTITION BY cluster_name, subcluster_name) AS n FROM a), k AS (SELECT cluster_name, subcluster_name, theory_id, 'ok' AS status FROM n WHERE n >= 2)
SELECT * FROM k UNION ALL SELECT cluster_name, cluster_name, theory_id, 'singleton_warning' FROM {LISTED} r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.cluster_name = r.cluster_name AND k.theory_id = r.theory_id)""")
def splits_with_singletons(spark: SparkSession, d: str) -> DataFrame:
    a = _assigned(spark, d).select("cluster_name", "subcluster_name", "theory_id").distinct()
    return annotate.with_singletons(_requested(spark, d), a)


@query(f"SELECT b.batch_id, o.cluster_key FROM stage6_batches b JOIN (SELECT DISTINCT replace(translate(name, '/ ', '__'), ':', '') AS cluster_key FROM ontology) o ON replace(translate(b.cluster_name, '/ ', '__'), ':', '') = o.cluster_key")
def batches_by_file_key(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "stage6_batches").select("batch_id", names.file_name(F.col("cluster_name")).alias("cluster_key"))
    return b.join(table(spark, d, "ontology").select(names.file_name(F.col("name")).alias("cluster_key")).distinct(), "cluster_key").select("batch_id", "cluster_key")


@query("WITH n AS (SELECT * FROM stage6_batches WHERE batch_num > 1) SELECT cluster_name, batch_id, 'old' AS version FROM stage6_batches WHERE cluster_name IS NULL OR cluster_name NOT IN (SELECT cluster_name FROM n WHERE cluster_name IS NOT NULL) UNION ALL SELECT cluster_name, batch_id, 'new' FROM n")
def selective_rerun(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "stage6_batches").select("cluster_name", "batch_id", "batch_num")
    new = b.where("batch_num > 1").select("cluster_name", "batch_id", F.lit("new").alias("version"))
    return consolidate.replace_clusters(b.select("cluster_name", "batch_id", F.lit("old").alias("version")), new)


@query()
def reclustered(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all clusters split anew by a rule in the annotator's place, with carry-forward of what stays alone."""

    def by_digit(batches):
        for pdf in batches:
            yield pdf.assign(subcluster_name=pdf.cluster_name + " / " + pdf.theory_id.str[-1])

    words = table(spark, d, "theory_entries").select("theory_id", F.explode(names.core_tokens(F.col("original_name"))).alias("concept"))
    return annotate.recluster(_requested(spark, d), by_digit, words)
