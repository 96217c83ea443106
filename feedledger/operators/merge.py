"""Append-only merge and state sync."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import now_literal
from .dedup import first_seen
from .joins import not_in_history


def new_items(batch: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Genuinely new ids of a batch, first occurrence each; existing rows always win."""
    return not_in_history(first_seen(batch, ["id"], order), existing, ["id"])


def merge_items(existing: DataFrame, added: DataFrame) -> DataFrame:
    return existing.unionByName(added.select(*existing.columns))


def unread_states(ids: DataFrame, now) -> DataFrame:
    null = F.lit(None).cast("timestamp")
    return ids.select("id", F.lit("unread").alias("state"),
                      now_literal(now).alias("updated_at"),
                      null.alias("read_at"), null.alias("ignored_at"))


def sync_states(states: DataFrame, items: DataFrame, now) -> DataFrame:
    """Every item gets a state; states already there stay as they are."""
    missing = not_in_history(items.select("id").distinct(), states, ["id"])
    return states.unionByName(unread_states(missing, now))
