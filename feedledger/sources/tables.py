"""Scans of stored tables and of exported JSON files."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas as S


def read_table(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """Parquet scan with an explicit schema; a missing path fails loudly."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).parquet(*paths)


def read_items_json(spark: SparkSession, path: str) -> DataFrame:
    """Items from a JSON array file; anything off schema fails the read."""
    names = {"sourceId": "source_id", "dateBasis": "date_basis"}
    file_schema = ("id STRING, sourceId STRING, heading STRING, label STRING, link STRING, "
                   "date DATE, dateBasis STRING, category STRING, tags ARRAY<STRING>")
    raw = (spark.read.schema(file_schema).option("multiLine", True)
           .option("mode", "FAILFAST").json(path))
    return raw.withColumnsRenamed(names)


def _keyed(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """Rows of a JSON file that keeps records in an object keyed by id."""
    raw = (spark.read.schema(f"schemaVersion INT, {field} MAP<STRING, {value}>")
           .option("multiLine", True).option("mode", "FAILFAST").json(path))
    checked = raw.withColumn("schemaVersion", F.when(
        F.col("schemaVersion") == 1, F.col("schemaVersion")).otherwise(
        F.raise_error(F.lit("Unsupported schemaVersion")).cast("int")))
    return checked.where(F.col("schemaVersion") == 1).select(
        F.explode(field).alias("key", "v"))


def read_states_json(spark: SparkSession, path: str) -> DataFrame:
    rows = _keyed(spark, path, "items", "STRUCT<state: STRING, updatedAt: TIMESTAMP, "
                  "readAt: TIMESTAMP, ignoredAt: TIMESTAMP>")
    return rows.select(F.col("key").alias("id"), "v.state", F.col("v.updatedAt").alias("updated_at"),
                       F.col("v.readAt").alias("read_at"), F.col("v.ignoredAt").alias("ignored_at"))


def read_cursors_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cursors, known undated ids and lifecycle stages from one cursor file."""
    rows = _keyed(spark, path, "cursors", "STRUCT<lastRunAt: TIMESTAMP, lastItemDate: DATE, "
                  "lastItemId: STRING, knownUndatedIds: ARRAY<STRING>, "
                  "proposalStages: MAP<STRING, STRING>>").withColumnRenamed("key", "source_id")
    cursors = rows.select("source_id", F.col("v.lastRunAt").alias("last_run_at"),
                          F.col("v.lastItemDate").alias("last_item_date"),
                          F.col("v.lastItemId").alias("last_item_id"))
    known = rows.select("source_id", F.explode("v.knownUndatedIds").alias("id")).distinct()
    stages = rows.select("source_id", F.explode("v.proposalStages").alias("slug", "stage"))
    return cursors, known, stages


def read_status_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Run row and per-source status rows from one status file."""
    raw = (spark.read.schema(
        "schemaVersion INT, lastRunAt TIMESTAMP, "
        "coverage STRUCT<succeeded: BIGINT, failed: BIGINT, planned: BIGINT, added: BIGINT, "
        "total: BIGINT>, rejected STRUCT<reason: STRING, detail: STRING>, "
        "sources MAP<STRING, STRUCT<status: STRING, lastSuccessAt: TIMESTAMP, "
        "lastAttemptAt: TIMESTAMP, failureClass: STRING, reason: STRING>>")
        .option("multiLine", True).option("mode", "FAILFAST").json(path))
    runs = raw.select(F.lit(0).cast("long").alias("run_id"), F.col("lastRunAt").alias("last_run_at"),
                      "coverage", "rejected")
    status = raw.select(F.explode("sources").alias("source_id", "v")).select(
        "source_id", "v.status", F.col("v.lastSuccessAt").alias("last_success_at"),
        F.col("v.lastAttemptAt").alias("last_attempt_at"),
        F.col("v.failureClass").alias("failure_class"), "v.reason")
    return runs, status


def categories(spark: SparkSession) -> DataFrame:
    """The category dimension, a fixed handful of rows in display order."""
    rows = [(i, name, title) for i, (name, title) in enumerate(S.CATEGORIES)]
    return spark.createDataFrame(rows, "ord INT, category STRING, title STRING")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest row of the runs table, as an aggregate rather than a global sort."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).where(
        "r IS NOT NULL").select("r.*")
