"""Parsed entries to items: id, label, tags, date and its basis."""

from itertools import chain

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import date_basis, item_date, trustworthy_timestamp
from ..functions.text import item_id, label_for, tag_union
from ..sources.adapters import AdapterRegistry
from ..sources.feeds import label_override

ITEM_COLUMNS = ["id", "source_id", "heading", "label", "link", "date", "date_basis",
                "category", "tags", "seq", "at"]


def explode_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry, ordered by ``seq`` of its payload and ``at``, its place therein."""
    return (parsed.where(F.col("error").isNull())
            .select("*", F.posexplode("entries").alias("at", "entry"))
            .drop("entries", "error", "body"))


def to_items(entries: DataFrame, registry: AdapterRegistry, now) -> DataFrame:
    """Items from exploded entries; carries ``pos`` and ``filters`` of the source along."""
    events = F.create_map(*[F.lit(x) for x in chain.from_iterable(
        (a.name, a.event) for a in registry.values())])
    dated = entries.withColumn("published", trustworthy_timestamp(F.col("entry.published")))
    label = label_for(F.try_element_at(events, F.col("adapter")))
    override = F.when(F.col("adapter") == "feed", label_override(F.col("filters")))
    return dated.select(
        item_id(F.col("entry.link")).alias("id"), "source_id",
        F.col("entry.heading").alias("heading"), F.coalesce(override, label).alias("label"),
        F.col("entry.link").alias("link"), item_date(F.col("published"), now).alias("date"),
        date_basis(F.col("published")).alias("date_basis"), "category",
        tag_union(F.col("source_tags"), F.col("entry.tags")).alias("tags"), "seq",
        "at", "pos", "filters")
