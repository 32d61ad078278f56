"""The whole naming cascade, stage by stage, on DataFrames; rules stand in the annotators' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.operators import annotate, annotators, consolidate, matching, quality
from corvane.plans.registry import query
from corvane.plans.summaries import mentions
from corvane.session import cut, table


def filtered(m: DataFrame) -> DataFrame:
    """Stage 0: mentions with a name whose confidence isn't low; medium ones validated."""
    kept = m.where("coalesce(name, '') <> ''").where(names.confidence_level(F.col("confidence_is_theory")) != "low")
    return annotators.validate_medium(kept, annotators.rule_valid).where("is_validated")


def named(m: DataFrame, ontology: DataFrame) -> DataFrame:
    """Stages 1 to 3: (theory_id, original, name, stage): names matched by the whole ladder, then mapped ones, then refined ones."""
    rows = m.select("theory_id", F.col("name").alias("original"))
    distinct = cut(rows.select(F.col("original").alias("name")).distinct())
    matched = cut(matching.match_names(distinct, ontology).where("matched").select("name", F.col("canonical").alias("mapped")))
    left = cut(distinct.join(matched, "name", "left_anti"))
    mapped = cut(annotators.map_names(left, annotators.rule_key).select("name", "mapped"))
    refined = annotators.map_names(mapped.select(F.col("mapped").alias("name")), annotators.rule_key).select(F.col("name").alias("mapped"), F.col("mapped").alias("refined"))
    second = mapped.join(refined, "mapped").select("name", F.col("refined").alias("mapped"), F.lit("refined").alias("stage"))
    every = matched.select("name", "mapped", F.lit("matched").alias("stage")).unionByName(second)
    return rows.join(every.withColumnRenamed("name", "original"), "original").select("theory_id", "original", F.col("mapped").alias("name"), "stage")


def clustered(rows: DataFrame, stage: int = 5) -> DataFrame:
    """Names in clusters of a common first core word (in the place of embeddings), with their role by size."""
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("total"))
    key = F.coalesce(F.get(names.core_tokens(F.col("name")), 0), F.lower("name"))
    return consolidate.split_by_size(sizes.withColumn("cluster", key), "total", stage)


def gathered(rows: DataFrame) -> DataFrame:
    """Stage 7: the names that stage 6 left in clusters again; singletons take a reference name of theirs, if there is one."""
    mapped = annotators.refine_rare(clustered(rows, 7), annotators.rule_first_reference, prefer="map").groupBy("name").agg(F.min("mapped").alias("mapped"))
    return consolidate.remapped(rows, mapped).select("theory_id", "original", "name")


def cascade(m: DataFrame, ontology: DataFrame, large: int = 40, kept: DataFrame | None = None) -> DataFrame:
    """(theory_id, original, name): the final name of every mention that passes stage 0; ``kept``: these mentions, if at hand."""
    rows = cut(named(filtered(m) if kept is None else kept, ontology))
    verdicts = annotators.validate_names(rows.join(m.select("theory_id", "evidence"), "theory_id").select("name", "theory_id", "evidence"), annotators.rule_verdict)
    rows = rows.join(verdicts.where("verdict = 'valid'").select("name"), "name", "left_semi")
    refined = annotators.refine_rare(clustered(rows), annotators.rule_first_reference).groupBy("name").agg(F.min("mapped").alias("mapped"))
    rows = cut(consolidate.remapped(rows, refined))
    big = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("name")
    asked = rows.join(big, "name", "left_semi").select(F.col("name").alias("cluster_name"), "theory_id")

    def by_digit(batches):
        for pdf in batches:
            yield pdf.assign(subcluster_name=pdf.cluster_name + " / " + pdf.theory_id.str[-1])

    concepts = m.select("theory_id", F.explode(names.core_tokens(F.col("name"))).alias("concept"))
    parts = annotate.recluster(asked, by_digit, concepts)
    split = parts.select("theory_id", "subcluster_name")
    return gathered(cut(rows.join(split, "theory_id", "left").select("theory_id", "original", F.coalesce("subcluster_name", "name").alias("name"))))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("theory_id", F.col("original_name").alias("name"), "confidence_is_theory", "doi", "paper_focus", F.col("mode").alias("evidence"))


@query()
def naming_cascade(spark: SparkSession, d: str) -> DataFrame:
    return cascade(_mentions(spark, d), table(spark, d, "ontology"))


@query("SELECT 0::BIGINT AS extra, 0::BIGINT AS duplicates")
def naming_cascade_conserves(spark: SparkSession, d: str) -> DataFrame:
    """Ids made up or doubled between stage 0 and the final names (ids that got lost were judged invalid)."""
    m = cut(_mentions(spark, d))
    kept = cut(filtered(m))
    return quality.conservation(kept, cascade(m, table(spark, d, "ontology"), kept=kept), "theory_id").select("extra", "duplicates")


@query()
def cascade_final_map(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_mentions(spark, d))
    final = cascade(m, table(spark, d, "ontology"))
    return consolidate.final_map(final.join(m.select("theory_id", "doi", "paper_focus"), "theory_id"))
