"""Session settings the library relies on."""

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Settings for cluster and local runs alike; sizes come from the data through AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("feedledger")
               .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", cores))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows that a task parses, some seconds of work.
ROWS_A_TASK = 50_000


def evenly_parallel(rows: DataFrame) -> DataFrame:
    """Spread rows evenly over the cluster, over so many tasks that each stays short.

    Parsing costs far more than moving payloads, and the splits of a scan say nothing about
    how many rows each has: a file with one row group leaves all but one of them empty. Rows go by a
    hash of what they hold, so a retried task agrees with itself and no key is hot. Meant for
    plain scans, as the rows are counted first.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    hashed = [f"`{f.name}`" for f in rows.schema if not re.search("map<|variant", f.dataType.simpleString())]
    return rows.repartition(tasks, F.xxhash64(*hashed)) if hashed else rows.repartition(tasks)


def work_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is the cluster's checkpoint folder. Only where none is set, as in tests, a folder
    of this machine stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="feedledger-")
        spark.sparkContext.setCheckpointDir(folder)
    return os.path.join(folder, "feedledger")
