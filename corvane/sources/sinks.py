"""Sinks: snapshots with metadata, upserts by anti-join, nested exports, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_with_metadata(rows: DataFrame, statistics: dict[str, object], path: str) -> None:
    """Rows as Parquet beside a one-row table of metadata; consumers of JSON get ``as_json``."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    facts = rows.sparkSession.createDataFrame([(k, str(v)) for k, v in statistics.items()], "key string, value string")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def as_json(rows: DataFrame) -> DataFrame:
    """(json): one JSON document a row, null fields included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(rows: DataFrame, path: str, plain: bool = False) -> None:
    """CSV with header; ``plain`` replaces commas in texts by semicolons for readers that know no quotes."""
    if plain:
        rows = rows.select(*[F.translate(c, ",", ";").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_as(rows: DataFrame, path: str, form: str, text: Column | None = None, newest: str | None = None) -> None:
    """txt, json or csv, newest first where ``newest`` names a timestamp."""
    if newest:
        rows = rows.orderBy(F.desc_nulls_last(newest))
    if form == "csv":
        write_csv(rows, path)
    elif form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "txt":
        rows.select((text if text is not None else F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns])).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError("form must be txt, json or csv")


def missing_report(missing: DataFrame, each: int = 20) -> DataFrame:
    """(line): clusters by share of missing ids, highest first, with their first ids. ``missing``: cluster_name, theory_id, share."""
    rank = F.row_number().over(Window.partitionBy("cluster_name").orderBy("theory_id"))
    few = missing.withColumn("rank", rank).where(F.col("rank") <= each)
    return few.orderBy(F.desc("share"), "cluster_name", "rank").select(F.format_string("%s\t%.1f %%\t%s", "cluster_name", F.col("share") * 100, "theory_id").alias("line"))


def upsert_parents(existing: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The new snapshot: rows of ``new`` replace those of ``existing`` with their key; of equal keys in ``new`` the last by ``order`` wins."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("__row")).select("__row.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_children(existing: DataFrame, new: DataFrame, parent: str, unique: list[str], order: Column) -> DataFrame:
    """Delete the children of all parents in ``new``, then insert ``new``; of equal ``unique`` the first by ``order`` stays."""
    first = F.row_number().over(Window.partitionBy(*unique).orderBy(order))
    fresh = new.withColumn("__first", first).where("__first = 1").drop("__first")
    return existing.join(new.select(parent).distinct(), parent, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_or_ignore(existing: DataFrame, new: DataFrame, unique: list[str], order: Column) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, first of equal keys, after the existing ones."""
    first = F.row_number().over(Window.partitionBy(*unique).orderBy(order))
    fresh = new.withColumn("__first", first).where("__first = 1").drop("__first")
    return existing.unionByName(fresh.join(existing.select(*unique).distinct(), unique, "left_anti"), allowMissingColumns=True)


def insert_or_replace(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("__last", last).where("__last = 1").drop("__last")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot is there: a folder with a finished write in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and any(p.getPath().getName() == "_SUCCESS" for p in fs.listStatus(folder))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of an old and a new schema: columns that one side lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def nested_children(parents: DataFrame, children: DataFrame, key: str, name: str, *order: Column) -> DataFrame:
    """Each parent with its children as an array in the given order; parents without children get an empty one."""
    fields = [c for c in children.columns if c != key]
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("v")))).alias("l"))
    packed = packed.select(key, F.transform("l", lambda x: x["v"]).alias(name))
    out = parents.join(packed, key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)))


def answer_map(answers: DataFrame, key: str = "doi", limit: int | None = None) -> DataFrame:
    """(key, answers): a map from question to answer, confidence and reasoning (and original_answer, if there is such a column), in the
    order of questions; with ``limit`` the first keys in order only."""
    if limit is not None:
        answers = answers.join(answers.select(key).distinct().orderBy(key).limit(limit), key, "left_semi")
    fields = ["answer", "confidence_score", "reasoning", *[c for c in ("original_answer",) if c in answers.columns]]
    entry = F.struct("question_name", F.struct(*fields).alias("v"))
    return answers.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("answers"))


def sampled_keys(parents: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` distinct keys in the order of a seeded hash: the same on every run."""
    return parents.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key).limit(n)


def write_batches(results: DataFrame, path: str) -> None:
    """Batch results as checkpoint folders by sanitised cluster name and batch number."""
    from corvane.functions.names import file_name

    results.withColumn("cluster_key", file_name(F.col("cluster_name"))).write.mode("overwrite").partitionBy("cluster_key", "batch_num").json(path)


def pending(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Requests without a response yet: what a resumed run still has to ask."""
    return requests.join(responses.select(*key).distinct(), key, "left_anti")
