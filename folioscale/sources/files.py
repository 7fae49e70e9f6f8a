"""Files in and out: records, selections, journals, listings, classified and versioned tables.

Every reader has its schema given, so nothing is inferred. Tables are written under a version folder and named by one small
pointer file at the end, so a reader sees a whole version or the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.operators import library

#: Schema of one record document.
RECORD = """paper_id STRING, schema_version INT, file_name STRING, extractor STRING, extractor_version STRING, file_size BIGINT, file_mtime BIGINT, degraded BOOLEAN, degraded_reason STRING,
metadata STRUCT<title: STRING, authors: ARRAY<STRING>, year: INT, journal: STRING, doi: STRING, num_pages: INT, project_tag: STRING, research_area: STRING>,
blocks ARRAY<STRUCT<i: BIGINT, type: STRING, text: STRING, page_idx: BIGINT, level: BIGINT, bbox: ARRAY<INT>>>"""
GOLDEN = "query_id STRING, text STRING, kind STRING, terms ARRAY<ARRAY<STRING>>, source_message_id BIGINT, occurrences BIGINT, conversations BIGINT"
JOURNAL = "paper_id STRING, stage STRING, status STRING, seq BIGINT, seconds DOUBLE, note STRING"
_BAD = "_corrupt"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of JSON documents (or lines); malformed ones, a torn last line included, are left out."""
    reader = spark.read.schema(f"{schema}, {_BAD} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD)
    rows = reader.option("multiLine", not lines).json(path)
    return rows.where(F.col(_BAD).isNull()).drop(_BAD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RECORD)


def record_blocks(records: DataFrame) -> DataFrame:
    """paper_id, i, type, text, page_idx, level of all blocks of records."""
    return records.select("paper_id", F.inline("blocks")).select("paper_id", "i", "type", F.coalesce("text", F.lit("")).alias("text"), "page_idx", F.coalesce("level", F.lit(1)).alias("level"))


def build_records(blocks: DataFrame, papers: DataFrame, schema_version: int = 2) -> DataFrame:
    """One nested record a paper of its blocks in order; papers without blocks give a degraded record without any."""
    body = blocks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("i", "type", "text", "page_idx", "level"))).alias("blocks"))
    rows = papers.join(body, "paper_id", "left")
    return rows.select(
        "paper_id", F.lit(schema_version).alias("schema_version"), "file_name", F.col("blocks").isNull().alias("degraded"),
        F.when(F.col("blocks").isNull(), "extraction_failed").alias("degraded_reason"),
        F.coalesce("blocks", F.array().cast("array<struct<i:bigint,type:string,text:string,page_idx:bigint,level:bigint>>")).alias("blocks"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines in 256 folders by the first two digits of their id; only folders that get rows are replaced."""
    rows = records.withColumn("part", F.substring("paper_id", 1, 2))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """line: entries of a text file without comments (from ``#`` on) and blank lines."""
    entry = F.trim(F.element_at(F.split("value", "#", 2), 1))
    return spark.read.text(path).select(entry.alias("line")).where("line <> ''")


def list_files(spark: SparkSession, path: str, suffix: str = "pdf", recursive: bool = True) -> DataFrame:
    """path, file_name, size, modified of the files with the suffix in any case; side files (``._*``) are left out.

    Contents are not read.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    rows = rows.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.where("file_name not like '._%'")


def file_digests(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """path, sha256, base64 of the files' contents."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.base64("content").alias("base64"))


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def journal_state(spark: SparkSession, path: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Last row of each paper and stage, over the journal and a snapshot before it."""
    rows = read_json(spark, path, JOURNAL, lines=True).withColumn("key", F.concat_ws("|", "paper_id", "stage"))
    old = rows.limit(0) if snapshot is None else snapshot.withColumn("key", F.concat_ws("|", "paper_id", "stage"))
    return library.replayed(old, rows, "key", "seq").drop("key")


def write_classified(rows: DataFrame, column: str, path: str, by: Column | None = None) -> None:
    """One folder a class; ``by`` spreads a class of many rows over files."""
    spread = rows if by is None else rows.repartition(F.col(column), by)
    spread.write.mode("append").partitionBy(column).json(path)


def write_version(rows: DataFrame, path: str, note: dict | None = None) -> str:
    """Writes the rows as a new version of the table at ``path`` and points readers to it; returns the version."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{path}/v={version}")
    spark = rows.sparkSession
    pointer = json.dumps({"version": version, **(note or {})})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT.{version}")
    fs = target.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(bytearray(pointer, "utf-8"))
    out.close()
    fs.delete(target, False)
    fs.rename(fresh, target)
    return version


def read_version(spark: SparkSession, path: str, expect: dict | None = None) -> DataFrame:
    """The current version of a table; an error if its note does not hold what is expected (a scheme number, a dimension)."""
    note = json.loads("".join(r.value for r in spark.read.text(f"{path}/CURRENT").collect()))
    for key, value in (expect or {}).items():
        if note.get(key) != value:
            raise ValueError(f"{path}: {key} is {note.get(key)!r}, not {value!r}")
    return spark.read.parquet(f"{path}/v={note['version']}")


class VectorTable:
    """A versioned table of vectors of one dimension by chunk id: create, upsert, delete, update, count."""

    def __init__(self, spark: SparkSession, path: str, dimension: int) -> None:
        self.spark, self.path, self.dimension = spark, path, dimension

    def create(self, schema: str = "chunk_id STRING, paper_id STRING, chunk_type STRING, embedding ARRAY<FLOAT>") -> bool:
        """True if there was none."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        if where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return False
        write_version(self.spark.createDataFrame([], schema), self.path, {"dimension": self.dimension})
        return True

    def read(self) -> DataFrame:
        return read_version(self.spark, self.path, {"dimension": self.dimension})

    def _replace(self, rows: DataFrame) -> None:
        write_version(rows, self.path, {"dimension": self.dimension})

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Puts the rows in by chunk id; returns the papers touched. Vectors of another length are an error."""
        checked = rows.withColumn("embedding", F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors must have {self.dimension} numbers"))))
        self._replace(library.upsert(self.read(), checked, "chunk_id"))
        return rows.select("paper_id").distinct()

    def delete_papers(self, papers: DataFrame) -> int:
        """Deletes the papers' chunks; returns how many there were, all of them."""
        old = self.read()
        n = old.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").count()
        self._replace(library.without(old, papers, "paper_id").select(old.columns))
        return n

    def update(self, papers: DataFrame, values: dict[str, object]) -> None:
        """Sets the columns of the papers' chunks."""
        old = self.read()
        mark = papers.select("paper_id").distinct().withColumn("__hit", F.lit(True))
        rows = old.join(mark, "paper_id", "left").withColumns({c: F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
        self._replace(rows.select(old.columns))

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("points"), F.count_distinct("paper_id").alias("papers"), F.max(F.size("embedding")).alias("dimension"))
