"""The archive of landed payloads, read from a moment on.

Payloads lie in files by the day they were fetched; a list of files, by day as well, says
what times each of them holds. A run reads the list from its window's first day on and
opens the files that reach into the window: as many as the window has, however old the archive is.
"""

import uuid

from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import PAYLOAD

#: A file, the first and last time that it holds and whether it has rows without one.
LANDED_FILE = "path STRING, low TIMESTAMP, high TIMESTAMP, undated BOOLEAN, fetch_day DATE"


@dataclass(frozen=True)
class Landing:
    spark: SparkSession
    root: str

    def land(self, payloads: DataFrame) -> None:
        """Add payloads. Their files are listed last, so a job that dies half-way has added
        nothing; files that nothing lists are never read."""
        folder = f"{self.root}/payloads/{uuid.uuid4().hex}"
        day = F.to_date("fetched_at")
        # Rows of one day go to several tasks: a day may hold a third of all rows.
        (payloads.select(*PAYLOAD.fieldNames(), day.alias("fetch_day"))
         .write.partitionBy("fetch_day").parquet(folder))
        rows = self.spark.read.schema(PAYLOAD).parquet(folder)
        files = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high"),
            F.bool_or(F.col("fetched_at").isNull()).alias("undated"))
        (files.withColumn("fetch_day", F.to_date("low")).repartition("fetch_day")
         .write.mode("append").partitionBy("fetch_day").parquet(f"{self.root}/files"))

    def files(self, since: datetime | None = None) -> DataFrame:
        """The list of files, or of those that reach beyond ``since``. Files of undated rows
        are always among them."""
        try:
            # The schema's last column is the folders' own.
            listed = self.spark.read.schema(LANDED_FILE).parquet(f"{self.root}/files")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LANDED_FILE)
        if since is None:
            return listed
        return listed.where(F.col("fetch_day").isNull() | (F.col("fetch_day") >= F.to_date(F.lit(since)))).where(
            F.col("undated") | (F.col("high") >= F.lit(since)))

    def since(self, start: datetime | None) -> DataFrame:
        """Payloads fetched at ``start`` or later, and undated ones; all for None.

        The names of the files to open pass through the driver, as those of any scan do.
        """
        paths = [r["path"] for r in self.files(start).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], PAYLOAD)
        rows = self.spark.read.schema(PAYLOAD).parquet(*paths)
        if start is None:
            return rows
        return rows.where(F.col("fetched_at").isNull() | (F.col("fetched_at") >= F.lit(start)))
