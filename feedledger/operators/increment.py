"""Per-source increments: window, undated baseline, cursor advance."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import now_literal, window_start
from .dedup import first_seen, landing
from .joins import lookup_join, not_in_history


def within_window(items: DataFrame, bounds: DataFrame, now) -> DataFrame:
    """Items dated on or after the day their source's window starts.

    ``bounds`` has ``source_id, initial_sync_from, last_run_at``; a source without a
    cursor has a NULL ``last_run_at`` and is marked ``is_initial``.
    """
    starts = bounds.select(
        "source_id",
        F.to_date(window_start(F.col("last_run_at"), F.col("initial_sync_from"), now)).alias("_from"),
        F.col("last_run_at").isNull().alias("is_initial"))
    return (lookup_join(items, starts, ["source_id"], "inner", ["id", "seq"])
            .where(F.col("date") >= F.col("_from")).drop("_from"))


def source_bounds(sources: DataFrame, cursors: DataFrame) -> DataFrame:
    """Window inputs of every source; both sides are one row per source."""
    return (sources.select(F.col("id").alias("source_id"), "initial_sync_from")
            .join(cursors.select("source_id", "last_run_at"), "source_id", "left"))


def fresh_undated(items: DataFrame, known: DataFrame) -> DataFrame:
    """Undated items nobody has decided on yet, one per source and id.

    Repeats of one undated item collapse before the join, so a page listed by every
    payload is no hot key.
    """
    undated = first_seen(items.where(F.col("date_basis") == "discovered"),
                         ["source_id", "id"], ["pos", *landing(items)])
    return not_in_history(undated, known, ["source_id", "id"])


def importable(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Dated items, and undated ones that are fresh and not part of a first sync."""
    return (items.where(F.col("date_basis") != "discovered")
            .unionByName(fresh.where(~F.col("is_initial"))))


def decide_undated(items: DataFrame, known: DataFrame) -> DataFrame:
    """Undated rule: items with ``imported`` and ``recorded``, those known already left out.

    Dated items pass. An undated item is decided once: recorded and withheld on the
    source's first sync, imported and recorded afterwards.
    """
    dated = items.where(F.col("date_basis") != "discovered")
    return (dated.withColumns({"imported": F.lit(True), "recorded": F.lit(False)})
            .unionByName(fresh_undated(items, known).withColumns(
                {"imported": ~F.col("is_initial"), "recorded": F.lit(True)})))


def split_undated(items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(items to import, newly known (source_id, id))`` of :func:`decide_undated`."""
    fresh = fresh_undated(items, known)
    return importable(items, fresh), fresh.select("source_id", "id")


def advance_cursors(previous: DataFrame, imported: DataFrame, succeeded: DataFrame,
                    now) -> DataFrame:
    """Cursors after a run: succeeded sources move, all others keep theirs.

    The latest item date never falls below the previous one.
    """
    latest = imported.groupBy("source_id").agg(
        F.max("date").alias("_date"), F.max_by("id", F.struct("date", *landing(imported))).alias("_id"))
    moved = (succeeded.select("source_id").distinct().join(latest, "source_id", "left")
             .withColumn("_moved", F.lit(True)))
    newer = F.col("_date").isNotNull() & (
        F.col("last_item_date").isNull() | (F.col("_date") >= F.col("last_item_date")))
    return previous.join(moved, "source_id", "full").select(
        "source_id",
        F.when(F.col("_moved"), now_literal(now)).otherwise(F.col("last_run_at")).alias("last_run_at"),
        F.greatest("last_item_date", "_date").alias("last_item_date"),
        F.when(newer, F.col("_id")).otherwise(F.col("last_item_id")).alias("last_item_id"))
