"""One survivor per key, as aggregates.

``min_by`` keeps one candidate per key and task before the shuffle. A ranking window
would send every copy of a hot key to a single task and sort them there.
"""

from pyspark.sql import Column, DataFrame, functions as F


def landing(rows: DataFrame) -> list[str]:
    """Columns that order rows as they landed; rows of one payload each have no ``at``."""
    return [c for c in ("seq", "at") if c in rows.columns]


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key by ``order``."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best).select("_row.*")


def most_specific(rows: DataFrame, key: Column, specificity: Column, source: Column,
                  arrival: Column, skip: Column | None = None) -> DataFrame:
    """Most specific row per key; ties go to the smaller source id, then first arrival.

    Rows marked ``skip`` never merge: they are grouped by their own arrival as well.
    """
    own = F.when(F.coalesce(skip, F.lit(False)), F.struct(source, arrival)) \
        if skip is not None else F.lit(None).cast("int")
    best = F.min_by(F.struct(*rows.columns), F.struct(-specificity, source, arrival))
    return (rows.groupBy(key.alias("_key"), own.alias("_own"))
            .agg(best.alias("_row")).select("_row.*"))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
