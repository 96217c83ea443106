"""Reading-state changes against the store: one item, a batch, or a stream of batches."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import now_literal
from ..operators.checks import data_issues
from ..operators.states import apply_transitions, with_fate
from ..schemas import STATE, STATES
from .store import Store


def change_states(store: Store, transitions: DataFrame) -> None:
    """Fold a batch of transitions into the store as one version.

    Only items and states of the batch's ids are looked up, and only their states are
    written. Items that become ignored are listed as removed; both tables change in the same
    version, so nobody sees an ignored item that is still active.
    """
    store.bootstrap()
    touched = transitions.select("id").distinct()
    items = store.stored_items().join(touched, "id", "left_semi")
    states = store.read("states").join(touched, "id", "left_semi")
    _, changed = apply_transitions(items, states, transitions)
    segments = store.write_states(changed)
    if segments == store.directories.get("states"):
        return  # nothing of the batch counts
    gone = (store.scan("states", segments[-1:]).where("state = 'ignored'")
            .join(items.select("id"), "id", "left_semi")
            .select("id", F.lit(store.version).cast("long").alias("run_id")))
    removed = store.append("removed", gone, f"run_id={store.version}")
    store.publish({"states": segments, "removed": removed})


def set_state(store: Store, item_id: str, state: str, now) -> bool:
    """Set the state of one active item; False if there is no such item."""
    if state not in STATES:
        raise ValueError(f"Unknown state {state!r}")
    if store.items().where(F.col("id") == item_id).isEmpty():
        return False
    change_states(store, store.spark.range(1).select(
        F.lit(item_id).alias("id"), F.lit(state).alias("state"), now_literal(now).alias("ts"),
        F.lit(0).cast("long").alias("seq")))
    return True


def clean_store(store: Store, now) -> dict[str, int]:
    """Cleanup on its own, outside a run: one version without dead tombstones, items that are
    back under a live one and items read too long ago. Returns the counts of all three.

    The fates of states are found in one pass; of the items, only the ids of states
    that take theirs along are looked up.
    """
    store.bootstrap()
    fated = with_fate(store.read("states"), now).where("fate <> 'kept'")
    fated = store.stage(fated.select("id", "fate"), "fated")
    gone = store.stage(store.items_in(store.segments_holding(fated)).select("id").distinct().join(
        fated.where("fate IN ('ignored', 'expired')"), "id").select("id", "fate"), "gone")
    counts = (fated.where("fate IN ('pruned', 'expired')").unionByName(gone.where("fate = 'ignored'"))
              .agg(*[F.count_if(F.col("fate") == fate).alias(name) for name, fate in (
                  ("pruned", "pruned"), ("scrubbed", "ignored"), ("expired", "expired"))]).first().asDict())
    if any(counts.values()):
        dropped = fated.where("fate IN ('pruned', 'expired')").select(
            "id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields if f.name != "id"])
        removed = gone.select("id", F.lit(store.version).cast("long").alias("run_id"))
        store.publish({"states": store.write_states(dropped),
                       "removed": store.append("removed", removed, f"run_id={store.version}")})
    return counts


def may_publish(items: DataFrame, states: DataFrame, now) -> bool:
    """Reading state may be handed on only if the data check finds nothing."""
    return data_issues(items, states, now).isEmpty()
