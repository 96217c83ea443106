"""Reading state: folding transitions and cleaning up."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import is_dead_tombstone, is_read_expired
from .joins import SALTS, lookup_join


def fold_transitions(transitions: DataFrame, salts: int = SALTS) -> DataFrame:
    """Net effect per id: ``id, state, updated_at, read_at, ignored_at``.

    ``ignored`` ends an item, so whatever comes after the first one does not count. Where
    each id ends is found from the ``ignored`` rows alone; the rows before it are then
    folded by a partial aggregate. The join in between is a broadcast if few ids end and
    otherwise spreads a hot id over many tasks.
    """
    at = F.struct("ts", "seq")
    cuts = (transitions.where("state = 'ignored'").groupBy("id").agg(F.min(at).alias("cut")))
    counted = lookup_join(transitions, cuts, ["id"], "left", ["ts", "seq"], salts).where(
        F.col("cut").isNull() | (at <= F.col("cut")))

    def latest(state: str) -> Column:
        return F.max(F.when(F.col("state") == state, F.col("ts")))

    return counted.groupBy("id").agg(
        F.max(F.struct("ts", "seq", "state")).alias("last"), latest("read").alias("read_at"),
        latest("ignored").alias("ignored_at"),
    ).select("id", "last.state", F.col("last.ts").alias("updated_at"), "read_at", "ignored_at",
             F.col("last.seq").alias("seq"))


def apply_transitions(items: DataFrame, states: DataFrame, transitions: DataFrame
                      ) -> tuple[DataFrame, DataFrame]:
    """``(items, states)`` after a batch of transitions.

    Active items change, and ignored ones where a transition from before they were ignored
    arrives late. The later of stored and new stamp ``(updated_at, seq)`` decides, so the
    order of batches does not matter; a stored state without ``seq`` loses a tie. The first
    time an item was ignored ends it, however late that is known, and it leaves the item
    table at once. A read stamp from after that end does not count.
    """
    if "seq" not in states.columns:
        states = states.withColumn("seq", F.lit(None).cast("long"))
    touched = items.select("id").union(states.where("state = 'ignored'").select("id")).distinct()
    folded = fold_transitions(transitions).join(touched, "id", "left_semi")
    fields = ("state", "updated_at", "seq", "read_at", "ignored_at")
    old = states.select("id", F.struct(*fields).alias("o"))
    new = folded.select("id", F.struct(*fields).alias("n"))

    def stamp(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(
            F.col(f"{side}.updated_at").alias("at"), F.col(f"{side}.seq").alias("seq")))

    def ended(side: str) -> Column:
        at = F.coalesce(f"{side}.ignored_at", f"{side}.updated_at")
        return F.when(F.col(f"{side}.state") == "ignored",
                      F.struct(at.alias("at"), F.col(f"{side}.seq").alias("seq")))

    both = old.join(new, "id", "full").withColumn("end", F.least(ended("o"), ended("n")))
    takes = stamp("o").isNull() | F.coalesce(stamp("n") >= stamp("o"), F.lit(False))

    def last(name: str) -> Column:
        return F.when(takes, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    def read(side: str) -> Column:
        at = F.col(f"{side}.read_at")
        return F.when(F.col("end").isNull() | (at <= F.col("end.at")), at)

    over = F.col("end").isNotNull()
    merged = both.select(
        "id", F.when(over, F.lit("ignored")).otherwise(last("state")).alias("state"),
        F.when(over, F.col("end.at")).otherwise(last("updated_at")).alias("updated_at"),
        F.greatest(read("o"), read("n")).alias("read_at"), F.col("end.at").alias("ignored_at"),
        F.when(over, F.col("end.seq")).otherwise(last("seq")).alias("seq"))
    kept = items.join(folded.where("state = 'ignored'").select("id"), "id", "left_anti")
    return kept, merged


@dataclass(frozen=True)
class Cleanup:
    items: DataFrame
    states: DataFrame
    pruned: DataFrame
    scrubbed: DataFrame
    expired: DataFrame

    def removed_ids(self) -> DataFrame:
        """Ids that cleanup itself took out of the item table."""
        return self.scrubbed.union(self.expired).distinct()

    def counts(self) -> DataFrame:
        """``pruned, scrubbed, expired`` in one row."""
        def marked(df: DataFrame, kind: str) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"))

        rows = (marked(self.pruned, "pruned").union(marked(self.scrubbed, "scrubbed"))
                .union(marked(self.expired, "expired")))
        return rows.agg(*[F.count_if(F.col("kind") == k).alias(k)
                          for k in ("pruned", "scrubbed", "expired")])


def with_fate(states: DataFrame, now) -> DataFrame:
    """What cleanup does with each state: pruned, ignored (live), expired or kept."""
    state = F.col("state")
    return states.withColumn(
        "fate",
        F.when(is_dead_tombstone(state, F.col("ignored_at"), now), F.lit("pruned"))
        .when(state == "ignored", F.lit("ignored"))
        .when(is_read_expired(state, F.col("read_at"), now), F.lit("expired"))
        .otherwise(F.lit("kept")))


def clean_up(items: DataFrame, states: DataFrame, now) -> Cleanup:
    """Prune dead tombstones, scrub items still tombstoned, expire read items.

    A pruned id counts as ordinary again, so its item is not scrubbed. Unread items stay
    whatever their age.
    """
    fated = with_fate(states, now)
    gone = fated.where(F.col("fate").isin("ignored", "expired")).select("id")
    live = fated.where("fate = 'ignored'").select("id")
    return Cleanup(
        items=items.join(gone, "id", "left_anti"),
        states=fated.where(F.col("fate").isin("ignored", "kept")).drop("fate"),
        pruned=fated.where("fate = 'pruned'").select("id"),
        scrubbed=items.select("id").join(live, "id", "left_semi"),
        expired=fated.where("fate = 'expired'").select("id"))
