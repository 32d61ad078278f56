"""Sources: nested JSON documents, SQLite tables, lists of DOIs, ontologies, checkpoint files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from corvane import schemas


def extraction_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per theory of ``{results: [{..., theories: [...]}]}``: papers without theories give none.

    paper_pos and theory_pos keep the file's order. One document a file, or with ``lines`` one a line (splittable).
    """
    doc = spark.read.schema(schemas.EXTRACTION).json(path, multiLine=not lines)
    papers = doc.select(F.posexplode("results").alias("paper_pos", "p"))
    return papers.select("paper_pos", "p.doi", "p.pmid", F.col("p.title").alias("paper_title"), "p.timestamp", F.posexplode("p.theories").alias("theory_pos", "t")).select(
        "paper_pos", "theory_pos", "doi", "pmid", "paper_title", "timestamp", "t.*"
    )


def parsed_payloads(results: DataFrame) -> DataFrame:
    """``payload`` texts as theories: like ``extraction_results``, for documents that are kept in a table."""
    parsed = results.select("record_id", F.from_json("payload", f"STRUCT<doi: STRING, pmid: STRING, validation_result: STRING, confidence_score: INT, theories: ARRAY<{schemas.THEORY}>>").alias("p"))
    return parsed.select("record_id", "p.doi", "p.pmid", F.posexplode("p.theories").alias("theory_pos", "t")).select("record_id", "doi", "pmid", "theory_pos", "t.name", "t.mode", "t.confidence_is_theory", "t.paper_focus", "t.key_concepts")


def with_precedence(first: DataFrame, second: DataFrame, key: str, decides: str = "name") -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key isn't among the rows of ``first`` with ``decides`` set.

    Null keys equal each other.
    """
    taken = first.where(F.col(decides).isNotNull()).select(F.col(key).alias("__key")).distinct()
    return first.unionByName(second.join(taken, second[key].eqNullSafe(F.col("__key")), "left_anti"), allowMissingColumns=True)


def surrogate_ids(rows: DataFrame, *order: str, prefix: str = "T", width: int = 6) -> DataFrame:
    """Running ids ``T000001`` in the given order, without a global sort in one task.

    Rows are range-partitioned by the order and written once with the number of their partition; each partition's size
    is counted, and the sizes before it are added to the ranks within it.
    """
    from pyspark.sql.types import LongType

    from corvane.session import cut

    spread = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).cast(LongType()).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = spread.withColumn("__rank", rank).join(F.broadcast(offsets), "__part")
    return numbered.withColumn("surrogate_id", F.concat(F.lit(prefix), F.lpad((F.col("__rank") + F.col("__offset")).cast("string"), width, "0"))).drop("__part", "__rank", "__offset")


def doi_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, doi) of a text file: blanks and # comments left out, first occurrences in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "doi"))
    kept = lines.select("pos", F.trim("doi").alias("doi")).where((F.col("doi") != "") & ~F.col("doi").startswith("#"))
    return kept.groupBy("doi").agg(F.min("pos").alias("pos")).select("pos", "doi")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_name, question, options) of a JSON map; options are parted by ' / '."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schemas.QUESTIONS)).alias("question_name", "q"))
    return parsed.select("question_name", "q.question", F.transform(F.split("q.answers", "/"), lambda o: F.trim(o)).alias("options"))


def synonyms(spark: SparkSession, path: str | None) -> DataFrame:
    """(question_name, keywords) of a JSON map; without a file there are none."""
    if path is None:
        return spark.createDataFrame([], "question_name string, keywords array<string>")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schemas.SYNONYMS)).alias("question_name", "keywords"))


def alias_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(pos, category, subcategory, name, aliases, abbreviations) of the three-level JSON map."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.ALIAS_ONTOLOGY).alias("m"))
    level = parsed.select(F.explode("m").alias("root", "c")).select(F.posexplode("c").alias("p1", "category", "s"))
    level = level.select("p1", "category", F.posexplode("s").alias("p2", "subcategory", "e"))
    return level.select("p1", "p2", "category", "subcategory", F.posexplode("e").alias("p3", "e")).select(
        F.struct("p1", "p2", "p3").alias("pos"), "category", "subcategory", "e.name", "e.aliases", "e.abbreviations"
    )


def ontology_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of every JSON object with a ``name``, at any depth; aliases don't count. Distinct."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    from corvane.operators.shred import adjacency

    return named_nodes(adjacency(doc, "file", F.col("text")))


def named_nodes(nodes: DataFrame) -> DataFrame:
    """(name) of the objects of an adjacency table that have a scalar ``name``, those below aliases or abbreviations left out. Distinct.

    Names are few; what lies below an excluded list is found by going down from its node, level by level.
    """
    from corvane.session import cut

    edges = cut(nodes.where("parent IS NOT NULL").select("record", "node", "parent"))
    below = cut(nodes.where("label IN ('aliases', 'abbreviations')").select("record", "node"))
    out = below
    while not below.isEmpty():
        below = cut(edges.join(below.select("record", F.col("node").alias("parent")), ["record", "parent"]).select("record", "node"))
        out = out.unionByName(below)
    found = nodes.where("kind = 'scalar' AND label = 'name'").select("record", "node", F.col("scalar").alias("name"))
    return found.join(out.distinct(), ["record", "node"], "left_anti").select("name").distinct()


def mechanism_ontology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MECHANISM).json(path, multiLine=True)


def stage_rows(spark: SparkSession, path: str, array: str, element: str, key: str) -> DataFrame:
    """The elements of one array of a stage's JSON output; those without a key are left out."""
    doc = spark.read.schema(f"{array} ARRAY<{element}>").json(path, multiLine=True)
    return doc.select(F.explode(array).alias("r")).select("r.*").where(F.coalesce(F.col(key), F.lit("")) != "")


def checkpoint_files(spark: SparkSession, glob: str) -> DataFrame:
    """Batch results of many JSON files, with the file's name."""
    return spark.read.schema(schemas.STAGE6).json(glob, multiLine=True).select("*", F.col("_metadata.file_name").alias("file_name"))


def answers_of_files(spark: SparkSession, glob: str) -> DataFrame:
    """(doi, question_name, answer, confidence, reasoning) of files that are named after DOIs."""
    from corvane.functions.names import doi_of_file

    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.from_json("value", schemas.ANSWERS).alias("m"))
    return files.select(doi_of_file(F.col("f")).alias("doi"), F.explode("m").alias("question_name", "a")).select("doi", "question_name", "a.*")


def files_without(spark: SparkSession, folder: str, denied: DataFrame) -> DataFrame:
    """(path, doi) of the files below ``folder`` whose DOI isn't in ``denied`` (doi): the plan of a filtered copy."""
    from corvane.functions.names import doi_key, doi_of_file

    files = spark.read.format("binaryFile").load(folder).select("path", doi_of_file(F.col("path")).alias("doi"))
    return files.join(denied.select(doi_key(F.col("doi")).alias("doi")).distinct(), "doi", "left_anti")


class _Slice(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Reads row-id slices in parallel; pushes simple filters into SQLite's own WHERE."""

    OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = '"' + f.attribute[0].replace('"', '""') + '"' if len(f.attribute) == 1 else None
            if name and type(f) in self.OPS:
                self.where.append(f"{name} {self.OPS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, In):
                self.where.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values.extend(f.value)
            elif name and isinstance(f, IsNull | IsNotNull):
                self.where.append(f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts = int(self.options.get("numpartitions", "1"))
        if parts < 2:
            return [_Slice(None, None)]
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return [_Slice(None, None)]
        step = (high - low) // parts + 1
        return [_Slice(low + k * step, low + (k + 1) * step) for k in range(parts)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        columns = ", ".join('"' + f.replace('"', '""') + '"' for f in self.schema.fieldNames())
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [partition.low, partition.high]
        sql = f'SELECT {columns} FROM "{self.options["table"]}"' + (" WHERE " + " AND ".join(where) if where else "")
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            yield from con.execute(sql, values)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").schema(...).option("path", ...).option("table", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the schema explicitly")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    """A SQLite table; the file must be readable where tasks run."""
    from corvane.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("path", path).option("table", table).option("numPartitions", str(partitions)).load()
