"""Helpers of the corpus operators: written stages, batch sizes, fresh column names."""

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedledger.session import work_folder


def prepare_workers(spark: SparkSession, rows: int = 20_000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so that very long texts don't pile up in a worker,
    and let workers import this package from where the driver has it (on a cluster that
    lacks the path, ship the package with ``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, in the shared folder of the cluster."""
    return os.path.join(work_folder(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def staged(rows: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write rows to the shared folder and read them back: lineage ends at shared files."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    rows.write.option("compression", compression).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each lengthened until it clashes with no column, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_hash(rows: DataFrame) -> Column:
    """A hash of a whole row, to tell apart rows that share an id; maps count as JSON."""
    def hashable(field) -> Column:
        column, kind = rows[f"`{field.name}`"], field.dataType.simpleString()
        return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column
    return F.xxhash64(*[hashable(f) for f in rows.schema.fields])


def let_sql(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"
