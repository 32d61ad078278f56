"""Queries on nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import shred
from corvane.plans.registry import query
from corvane.session import table


@query("""WITH b AS (SELECT batch_id, s.i AS p, batch_result.subclusters[s.i].theory_ids AS ids FROM stage6_batches, unnest(range(1, len(batch_result.subclusters) + 1)) AS s(i)),
i AS (SELECT 'stage6_batches' AS table_name, batch_id AS record_key, p - 1 AS parent_pos, q.i - 1 AS child_pos, ids[q.i] AS child_key FROM b, unnest(range(1, len(ids) + 1)) AS q(i)),
x AS (SELECT record_id, payload::JSON->'theories' AS t FROM extraction_results WHERE json_valid(payload)),
x1 AS (SELECT record_id, CASE json_type(t) WHEN 'ARRAY' THEN t WHEN 'OBJECT' THEN json_array(t) ELSE '[]'::JSON END AS t FROM x WHERE t IS NOT NULL),
th AS (SELECT record_id, p.i AS p, json_extract(t, '$[' || p.i || '].key_concepts') AS k FROM x1, unnest(range(0, json_array_length(t)::BIGINT)) AS p(i)),
k0 AS (SELECT record_id, p, CASE WHEN json_type(k) = 'VARCHAR' AND json_valid(k->>'$') THEN (k->>'$')::JSON ELSE k END AS k FROM th WHERE k IS NOT NULL),
k1 AS (SELECT record_id, p, CASE json_type(k) WHEN 'ARRAY' THEN k WHEN 'NULL' THEN '[]'::JSON ELSE json_array(k) END AS k FROM k0),
c AS (SELECT record_id, p, q.i AS q, json_extract(k, '$[' || q.i || ']') AS c FROM k1, unnest(range(0, json_array_length(k)::BIGINT)) AS q(i)),
f AS (SELECT 'extraction_results' AS table_name, record_id AS record_key, p AS parent_pos, q AS child_pos, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' WHEN 'OBJECT' THEN c->>'$.concept' END AS child_key FROM c)
SELECT table_name, record_key, parent_pos::INT AS parent_pos, child_pos::INT AS child_pos, child_key FROM (SELECT * FROM i UNION ALL SELECT * FROM f) WHERE trim(coalesce(child_key, '')) <> ''""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.shred_found(table(spark, d, "stage6_batches"), table(spark, d, "extraction_results"))


@query("""SELECT batch_id AS record, (s.i - 1)::INT AS sub_pos, batch_result.subclusters[s.i].subcluster_name AS subcluster_name, batch_result.subclusters[s.i].mechanism_focus AS mechanism_focus,
  batch_result.subclusters[s.i].theory_count::VARCHAR AS theory_count, batch_result.subclusters[s.i].status AS status, batch_result.subclusters[s.i].warning_reason AS warning_reason
FROM stage6_batches, unnest(range(1, len(batch_result.subclusters) + 1)) AS s(i) WHERE batch_result.subclusters[s.i] IS NOT NULL""")
def p6_subclusters(spark: SparkSession, d: str) -> DataFrame:
    return shred.subcluster_tables(shred.batch_nodes(table(spark, d, "stage6_batches")))[0]


THEORIES = """WITH x AS (SELECT record_id, payload::JSON->'theories' AS t FROM extraction_results WHERE json_valid(payload)),
x0 AS (SELECT record_id, CASE WHEN json_type(t) = 'VARCHAR' AND json_valid(t->>'$') THEN (t->>'$')::JSON ELSE t END AS t FROM x WHERE t IS NOT NULL),
x1 AS (SELECT record_id, CASE json_type(t) WHEN 'ARRAY' THEN t WHEN 'OBJECT' THEN json_array(t) ELSE '[]'::JSON END AS t FROM x0),
th AS (SELECT record_id AS record, p.i::INT AS theory_pos, json_extract(t, '$[' || p.i || ']') AS v FROM x1, unnest(range(0, json_array_length(t)::BIGINT)) AS p(i))"""


@query(THEORIES + """ SELECT record, theory_pos, CASE WHEN json_type(v->'name') NOT IN ('OBJECT', 'ARRAY') THEN v->>'name' END AS name,
  CASE WHEN json_type(v->'mode') NOT IN ('OBJECT', 'ARRAY') THEN v->>'mode' END AS mode, CASE WHEN json_type(v->'evidence') NOT IN ('OBJECT', 'ARRAY') THEN v->>'evidence' END AS evidence,
  CASE WHEN json_type(v->'confidence_is_theory') NOT IN ('OBJECT', 'ARRAY') THEN v->>'confidence_is_theory' END AS confidence_is_theory,
  CASE WHEN json_type(v->'paper_focus') NOT IN ('OBJECT', 'ARRAY') THEN v->>'paper_focus' END AS paper_focus FROM th WHERE json_type(v) = 'OBJECT'""")
def p6_theories(spark: SparkSession, d: str) -> DataFrame:
    return shred.theory_tables(shred.payload_nodes(table(spark, d, "extraction_results")))[0]


@query("SELECT record_id AS record, CASE WHEN coalesce(trim(payload), '') = '' THEN 'missing' ELSE 'broken' END AS reason FROM extraction_results WHERE coalesce(trim(payload), '') = '' OR NOT json_valid(payload)")
def p6_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Records whose payload is missing or can't be parsed as a whole."""
    return shred.rejected(shred.payload_nodes(table(spark, d, "extraction_results"))).select("record", "reason")
