"""Per-source outcomes of a run: failures are rows, never exceptions."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import now_literal


def source_outcomes(sources: DataFrame, parsed: DataFrame, in_scope: DataFrame, now) -> DataFrame:
    """One row per source: planned, succeeded or failed.

    A source succeeds if any of its payloads was usable; its reason is otherwise the one
    of the newest payload. Both inputs are reduced to one row per source before the join,
    so a source with a third of all payloads is no hot key.
    """
    landed = parsed.groupBy("source_id").agg(
        F.count_if(F.col("error").isNull()).alias("usable"),
        F.max_by("error", "seq").alias("error"), F.max("fetched_at").alias("fetched_at"))
    counted = in_scope.groupBy("source_id").agg(F.count("*").alias("n"))
    planned = F.col("status") == "planned"
    ok = F.coalesce(F.col("usable") > 0, F.lit(False))
    return (sources.select(F.col("id").alias("source_id"), "pos", "status")
            .join(landed, "source_id", "left").join(counted, "source_id", "left")
            .select("source_id", "pos",
                    F.when(planned, F.lit("planned")).when(ok, F.lit("succeeded"))
                    .otherwise(F.lit("failed")).alias("outcome"),
                    F.when(~planned & ok, F.coalesce("n", F.lit(0).cast("long"))).alias("items"),
                    F.when(~planned & ~ok, F.coalesce("error", F.lit("No payload landed")))
                    .alias("reason"),
                    F.when(~planned, F.coalesce("fetched_at", now_literal(now)))
                    .alias("attempted_at")))


def source_status(outcomes: DataFrame, previous: DataFrame) -> DataFrame:
    """Status per source; a failure keeps the time of the last success."""
    before = previous.select("source_id", F.col("last_success_at").alias("_success"))
    failed, done = F.col("outcome") == "failed", F.col("outcome") == "succeeded"
    return outcomes.join(before, "source_id", "left").select(
        "source_id",
        F.when(done, F.lit("active")).when(failed, F.lit("failing"))
        .otherwise(F.lit("planned")).alias("status"),
        F.when(done, F.col("attempted_at")).when(failed, F.col("_success")).alias("last_success_at"),
        "attempted_at",
        F.when(failed, F.lit("runtime-failing")).alias("failure_class"), "reason",
    ).withColumnRenamed("attempted_at", "last_attempt_at")


def run_coverage(outcomes: DataFrame) -> DataFrame:
    """Outcome counts and the raw item total, in one row."""
    def count(kind: str):
        return F.count_if(F.col("outcome") == kind).alias(kind)

    return outcomes.agg(count("succeeded"), count("failed"), count("planned"),
                        F.count("*").alias("total"),
                        F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("raw_items"))


def ordered_outcomes(outcomes: DataFrame) -> DataFrame:
    """Planned sources first, then registry order."""
    return outcomes.orderBy(F.when(F.col("outcome") == "planned", 0).otherwise(1), "pos")
