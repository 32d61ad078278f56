"""Queries on vectors and concept sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import similarity
from corvane.operators import matching, vectors
from corvane.operators.skew import skew_join
from corvane.plans.registry import query
from corvane.session import table

MEANS = "(SELECT label, list(m ORDER BY i) AS mean, max(n) AS size FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"SELECT label, size, i::INT AS at, round(m, 6) AS mean FROM (SELECT label, size, unnest(mean) AS m, unnest(range(0, 64)) AS i FROM {MEANS})")
def centroid_means(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.means(_embeddings(spark, d), "label", "embedding")
    return m.select("label", "size", F.posexplode("mean").alias("at", "m")).select("label", "size", "at", F.round("m", 6).alias("mean"))


@query(f"""WITH s AS (SELECT vec_id, m.label, round(1 - {COS.format(a='embedding::DOUBLE[]', b='m.mean')}, 9) AS distance FROM embeddings, {MEANS} m)
SELECT vec_id, arg_min(label, struct_pack(distance := distance, label := label)) AS label, round(min(distance), 6) AS distance FROM s GROUP BY 1""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return vectors.nearest_mean(e.select("vec_id", "embedding"), "vec_id", "embedding", vectors.means(e, "label", "embedding"), "label").withColumn("distance", F.round("distance", 6))


@query(f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, e.vec_id, round({COS.format(a='e.embedding::DOUBLE[]', b='q.embedding::DOUBLE[]')}, 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query, vec_id, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def most_similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of all vectors for every twentieth one."""
    e = _embeddings(spark, d)
    return vectors.most_similar(e, "vec_id", "embedding", e.where(F.col("vec_id") % 20 == 0), 5)


CLUSTERED = "(SELECT vec_id, embedding, CASE WHEN vec_id % 97 = 0 THEN vec_id + 1000 WHEN vec_id % 89 = 0 THEN 100 + vec_id // 300 ELSE label END AS cluster FROM embeddings)"


@query(f"""WITH c AS {CLUSTERED}, m AS (SELECT cluster, list(m ORDER BY i) AS mean FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM c) GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT cluster, mean, n FROM m JOIN (SELECT cluster, count(*) AS n FROM c GROUP BY 1) USING (cluster)),
t AS (SELECT s.cluster, arg_min(b.cluster, (round(1 - {COS.format(a='s.mean', b='b.mean')}, 9), b.cluster)) AS target FROM z s JOIN z b ON s.n < 5 AND b.n >= 5 GROUP BY 1)
SELECT vec_id, coalesce(target, cluster) AS cluster FROM c LEFT JOIN t USING (cluster)""")
def small_clusters_absorbed(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    e = _embeddings(spark, d).withColumn("cluster", F.when(v % 97 == 0, v + 1000).when(v % 89 == 0, 100 + F.floor(v / 300)).otherwise(F.col("label")))
    return vectors.absorb_small(e, "vec_id", "embedding", "cluster")


@query()
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Ward's clusters within each label: the set is divided first, so that no task grows with the whole."""
    return vectors.ward(_embeddings(spark, d), "vec_id", "embedding", 1.8, group="label")


@query("""WITH c AS (SELECT id, name, list_distinct(list_transform(list_filter(from_json(CASE WHEN json_valid(key_concepts) AND key_concepts LIKE '[%' THEN key_concepts ELSE '[]' END, '[{"concept": "VARCHAR"}]'), lambda x: x.concept IS NOT NULL), lambda x: lower(trim(x.concept)))) AS k FROM theories WHERE name IS NOT NULL),
f AS (SELECT name, arg_min(id, id) AS first, arg_min(k, id) AS kf FROM c GROUP BY 1)
SELECT id, first, round(CASE WHEN least(len(k), len(kf)) = 0 THEN 0 ELSE len(list_intersect(k, kf)) * 1.0 / least(len(k), len(kf)) END, 6) AS overlap FROM c JOIN f USING (name)""")
def concept_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared concepts of each theory with the first one of its name; a list that can't be read counts as empty."""
    none = F.array().cast("array<struct<concept:string>>")
    c = F.coalesce(F.from_json(F.when(F.col("key_concepts").startswith("["), F.col("key_concepts")), "array<struct<concept:string>>"), none)
    k = F.array_distinct(F.transform(F.filter(c, lambda x: x["concept"].isNotNull()), lambda x: F.lower(F.trim(x["concept"]))))
    t = table(spark, d, "theories").where("name IS NOT NULL").select("id", "name", k.alias("k"))
    first = t.groupBy("name").agg(F.min_by(F.struct("id", "k"), "id").alias("f"))
    joined = skew_join(t, first, "name")
    return joined.select("id", F.col("f.id").alias("first"), F.round(similarity.overlap_coefficient(F.col("k"), F.col("f.k")), 6).alias("overlap"))


@query()
def subclusters_to_recluster_with(spark: SparkSession, d: str) -> DataFrame:
    """For clusters with ids left alone: the sub-clusters that they are clustered anew with."""
    b = table(spark, d, "stage6_batches").where("cluster_name IS NOT NULL").select("cluster_name", F.explode("batch_result.subclusters").alias("s"))
    b = b.select("cluster_name", "s.subcluster_name", F.size(F.coalesce("s.theory_ids", F.array().cast("array<string>"))).alias("size"), F.split(F.lower(F.coalesce("s.mechanism_focus", F.lit(""))), " of ").alias("concepts")).where("subcluster_name IS NOT NULL")
    failed = b.where("size = 1").groupBy("cluster_name").agg(F.count(F.lit(1)).alias("failed"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("concepts")))).alias("concepts"))
    grown = b.where("size > 1").groupBy("cluster_name", "subcluster_name").agg(F.sum("size").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("concepts")))).alias("concepts"))
    return vectors.similar_subclusters(failed, grown)


@query()
def alphabetical_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The names of the mentions that the list does not hold."""
    names = table(spark, d, "theory_entries").select(F.col("original_name").alias("name"))
    return vectors.neighbours_by_tfidf(matching.not_listed(names, table(spark, d, "ontology")))
