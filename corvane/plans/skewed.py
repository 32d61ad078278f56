"""Queries on keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import skew
from corvane.plans.registry import query
from corvane.session import table

ELEMENTS = """e AS (SELECT batch_id, cluster_name, s.i AS sub_pos, unnest(batch_result.subclusters[s.i].theory_ids) AS theory_id
  FROM stage6_batches, unnest(range(1, len(batch_result.subclusters) + 1)) AS s(i)),
ok AS (SELECT * FROM e WHERE coalesce(theory_id, '') <> '')"""


@query(f"WITH {ELEMENTS} SELECT cluster_name FROM ok WHERE cluster_name IS NOT NULL GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM ok)")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_clusters(table(spark, d, "stage6_batches"))


@query(f"""WITH {ELEMENTS} SELECT cluster_name, count(DISTINCT (batch_id, sub_pos)) AS subclusters, count(*) AS ids,
  count(DISTINCT theory_id) AS distinct_ids FROM ok GROUP BY 1""")
def p3_cluster_report(spark: SparkSession, d: str) -> DataFrame:
    return skew.cluster_report(table(spark, d, "stage6_batches"))


@query(f"""WITH {ELEMENTS}, known AS (SELECT theory_id, min(lower(doi)) AS doi FROM theory_entries GROUP BY 1)
SELECT cluster_name, (SELECT count(*) FROM ok o WHERE o.cluster_name = p.cluster_name) AS ids, count(*) AS known_ids, count(DISTINCT k.doi) AS docs
FROM (SELECT DISTINCT cluster_name, theory_id FROM ok WHERE cluster_name IS NOT NULL) p JOIN known k USING (theory_id) GROUP BY 1""")
def p3_cluster_attributes(spark: SparkSession, d: str) -> DataFrame:
    return skew.cluster_attributes(table(spark, d, "stage6_batches"), table(spark, d, "theory_entries"))
