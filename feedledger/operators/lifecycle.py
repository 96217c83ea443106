"""Lifecycle diff: a stage snapshot against the stages known so far."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import now_literal
from ..functions.text import item_id, label_for, lifecycle_heading, lifecycle_key, tag_union
from .dedup import landing


def stage_event(previous: Column, stage: Column) -> Column:
    """``new:<stage>``, ``transition:<stage>``, ``withdrawn``, or NULL if nothing moved."""
    return (F.when(previous.isNull(), F.concat(F.lit("new:"), stage))
            .when(previous == stage, F.lit(None))
            .when(stage == "withdrawn", F.lit("withdrawn"))
            .otherwise(F.concat(F.lit("transition:"), stage)))


def event_label(event: Column) -> Column:
    return label_for(F.when(event.startswith("new:"), F.lit("tc39-proposal-created"))
                     .when(event == "withdrawn", F.lit("tc39-withdrawal"))
                     .otherwise(F.lit("tc39-stage-transition")))


def stage_events(snapshot: DataFrame, previous: DataFrame) -> DataFrame:
    """Snapshot rows that moved, with their ``event``.

    Only two snapshots are compared: a jump over several stages is one event, and an
    edit that does not move a row to another section is none.
    """
    before = previous.select("source_id", "slug", F.col("stage").alias("_before"))
    return (snapshot.join(before, ["source_id", "slug"], "left")
            .withColumn("event", stage_event(F.col("_before"), F.col("stage")))
            .where("event IS NOT NULL").drop("_before"))


def lifecycle_items(events: DataFrame, now) -> DataFrame:
    """Items for stage events; undated, keyed by the event rather than the link."""
    return events.select(
        item_id(lifecycle_key(F.col("slug"), F.col("event"))).alias("id"), "source_id",
        lifecycle_heading(F.col("name"), F.col("stage")).alias("heading"),
        event_label(F.col("event")).alias("label"), F.col("url").alias("link"),
        F.to_date(now_literal(now)).alias("date"), F.lit("discovered").alias("date_basis"),
        "category", tag_union(F.col("source_tags"), F.lit(None).cast("array<string>")).alias("tags"),
        *landing(events), "pos", "filters")


def observed_stages(snapshot: DataFrame) -> DataFrame:
    """Stage per slug as the next run will see it; the last mention in a document wins."""
    return snapshot.groupBy("source_id", "slug").agg(F.max_by("stage", F.struct(*landing(snapshot))).alias("stage"))


def upsert_stages(previous: DataFrame, observed: DataFrame) -> DataFrame:
    """Sources seen in this run replace their stages, the others keep theirs."""
    seen = observed.select("source_id").distinct()
    return previous.join(seen, "source_id", "left_anti").unionByName(observed)
