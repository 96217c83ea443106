"""One gated collection run over landed payloads.

Payloads are parsed once and staged. Window, baseline, de-duplication and merge follow on
the staged entries. State sync, cleanup and the consistency checks all need items and
states side by side, so they share one full join on the item id, staged as the *ledger*;
every later step only filters or counts it. The ledger holds the ids that the run touches:
sums over items and states tell beforehand whether the history is whole, and the filters of
its segments where the ids may lie. Status is always published, data only if no guard
rejects the run.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.dates import now_literal, window_start
from ..functions.text import specificity
from ..operators import checks, classify, increment, lifecycle, outcomes as out
from ..operators.dedup import first_seen, most_specific
from ..operators.joins import lookup_join, not_in_history
from ..operators.scope import in_source_scope
from ..operators.states import with_fate
from ..session import evenly_parallel
from ..sources.adapters import AdapterRegistry, default_registry, parse_payloads
from ..sources.landing import Landing
from ..sources.registry import registry_issues, unsupported_adapters
from ..sources.repositories import with_added_files
from .store import Store
from .summary import failure_lines, run_summary


def together(*jobs: Callable[[], Any]) -> list:
    """Run independent Spark jobs at the same time, so they share the cluster."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


@dataclass(frozen=True)
class RunResult:
    accepted: bool
    summary: str
    rejection: dict | None = None
    aborted: bool = False
    #: All faults of the registry that ended a run before it began.
    issues: DataFrame | None = None
    #: Segments of the history whose ids were read to tell what is new.
    segments_read: list[int] | None = None


def landed_payloads(payloads: DataFrame, sources: DataFrame) -> DataFrame:
    """Payloads of collectible sources with the source columns parsers need."""
    wanted = sources.where(F.col("status") != "planned").select(
        F.col("id").alias("source_id"), "pos", "adapter", "category", "filters",
        "release_policy", F.col("tags").alias("source_tags"))
    return lookup_join(payloads, wanted, ["source_id"], "inner", ["seq"])


def selected_entries(entries: DataFrame, registry: AdapterRegistry, kept: dict[str, DataFrame]) -> DataFrame:
    """Entries, of adapters with state of their own those that they select by it."""
    fragments = registry.fragments()
    if not fragments:
        return entries
    rest = entries.where(~F.col("adapter").isin(*fragments))
    for name, fragment in fragments.items():
        chosen = fragment.select(entries.where(F.col("adapter") == name), kept[name])
        rest = rest.unionByName(chosen.select(*entries.columns))
    return rest


def collected_items(parsed: DataFrame, stages: DataFrame, registry: AdapterRegistry, now,
                    kept: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(items within scope, observed lifecycle stages)`` from parsed payloads.

    ``kept`` has the state of the adapters that keep any, by their name.
    """
    entries = selected_entries(classify.explode_entries(parsed), registry, kept or {}).withColumn(
        "slug", F.col("entry.slug"))
    checked = registry.named(needs_files=True)
    snapshots = registry.named(snapshot=True)
    plain = entries.where(~F.col("adapter").isin(*checked, *snapshots))
    if checked:
        adding = parsed.where("adding IS NOT NULL").select("source_id", F.col("adding").alias("slug")).distinct()
        plain = plain.unionByName(with_added_files(
            entries.where(F.col("adapter").isin(*checked)), adding))
    items = classify.to_items(plain, registry, now)
    observed = stages.limit(0)
    if snapshots:
        newest = parsed.where(F.col("adapter").isin(*snapshots) & F.col("error").isNull()) \
            .groupBy("source_id").agg(F.max("seq").alias("_newest"))
        snapshot = lookup_join(
            entries.where(F.col("adapter").isin(*snapshots)), newest, ["source_id"], "inner", ["seq"])
        snapshot = (snapshot.where(F.col("seq") == F.col("_newest"))
                    .select("source_id", "slug", F.col("entry.stage").alias("stage"),
                            F.col("entry.heading").alias("name"), F.col("entry.link").alias("url"),
                            "category", "source_tags", "seq", "at", "pos", "filters"))
        moved = lifecycle.lifecycle_items(lifecycle.stage_events(snapshot, stages), now)
        items = items.unionByName(moved)
        observed = lifecycle.observed_stages(snapshot)
    in_scope = in_source_scope(F.col("heading"), F.col("link"), F.col("filters"))
    return items.where(in_scope), observed


def item_ledger(existing: DataFrame, added: DataFrame, states: DataFrame, now) -> DataFrame:
    """Items and states side by side, one row per id, with what the run does to each.

    ``fate`` is that of the state (pruned, ignored, expired, kept, synced); ``leaves``
    marks ids whose item is removed. Dead tombstones are pruned before sync, so an item
    published again becomes unread.
    """
    ids = (existing.select("id", "source_id", F.lit(False).alias("new"))
           .unionByName(added.select("id", "source_id", F.lit(True).alias("new")))
           .groupBy("id").agg(F.min("source_id").alias("source_id"), F.count_if(~F.col("new")).alias("copies"),
                              F.count_if("new").alias("fresh")))
    joined = ids.join(with_fate(states, now), "id", "full")
    has_item = F.coalesce(F.col("copies") + F.col("fresh") > 0, F.lit(False))
    stateless = F.col("fate").isNull() | (F.col("fate") == "pruned")
    synced = has_item & stateless

    def after(name: str, value):
        return F.when(synced, value).otherwise(F.col(name)).alias(name)

    no_time = F.lit(None).cast("timestamp")
    return joined.select(
        "id", "source_id", has_item.alias("has_item"),
        F.coalesce(F.col("copies"), F.lit(0)).alias("copies"),
        F.coalesce(F.col("fresh") > 0, F.lit(False)).alias("is_added"),
        F.coalesce(F.col("fate") == "pruned", F.lit(False)).alias("pruned"),
        F.when(synced, F.lit("synced")).otherwise(F.col("fate")).alias("fate"),
        (has_item & F.coalesce(F.col("fate").isin("ignored", "expired"), F.lit(False))).alias("leaves"),
        after("state", F.lit("unread")), after("updated_at", now_literal(now)),
        after("read_at", no_time), after("ignored_at", no_time), after("seq", F.lit(None).cast("long")))


def ledger_inputs(store: Store, batch: DataFrame, consistent: bool, now) -> tuple[DataFrame, DataFrame, list[int]]:
    """``(items, states, segments read)`` that a run's ledger needs.

    If ids and states agree so far, only the batch and states whose fate changes can change
    anything: their ids alone are looked up, in the segments that may hold them. Otherwise it is
    all items and all states, and the ledger names every id that is amiss.
    """
    states = store.read("states")
    if not consistent:
        return store.items(), states, store.segments()
    changing = with_fate(states, now).where("fate <> 'kept'").select("id")
    touched = store.stage(batch.select("id").union(changing).distinct(), "touched")
    segments = store.segments_holding(touched)
    met = store.items_in(segments).select("id", "source_id").join(touched, "id", "left_semi")
    return store.stage(met, "met"), states.join(touched, "id", "left_semi"), segments


def changed_items(store: Store, segments: list[int]) -> DataFrame:
    """``(id, change)`` of earlier items that are not as they were published, or gone without
    being removed: those of the given segments, by the digests that each item left.

    Segments of earlier runs are carried over as they are, so what is read of them is what
    the run would publish; its own removals come later and follow from states alone.
    """
    if not segments:
        return store.spark.createDataFrame([], "id STRING, change STRING")
    items = store.items_in(segments)
    prints = store.prints().where(F.col("run_id").isin(segments))
    sides = (items.select("id", checks.item_digest(items).alias("now")).unionByName(
        prints.select("id", F.col("digest").alias("then")), allowMissingColumns=True))
    per_id = sides.groupBy("id").agg(
        F.count("now").alias("copies"), F.count("then").alias("printed"),
        *[pick(c).alias(f"{c}_{name}") for c in ("now", "then") for name, pick in (("low", F.min), ("high", F.max))])
    edited = (F.col("now_low") != F.col("then_low")) | (F.col("now_high") != F.col("then_high"))
    change = F.when(F.col("printed") > 0, F.when(F.col("copies") == 0, F.lit("deleted")).when(edited, F.lit("modified")))
    return per_id.select("id", change.alias("change")).where("change IS NOT NULL")


def ledger_issues(ledger: DataFrame) -> DataFrame:
    """The data check, read off the ledger: id format, repeats, orphaned states."""
    stays = ledger.where("has_item AND NOT leaves")
    listed = F.col("copies") + F.col("is_added").cast("int")
    malformed = stays.where(~F.col("id").rlike(checks.ID_FORMAT))
    orphans = ledger.where("NOT has_item AND fate = 'kept'")
    return (
        checks.issues(malformed, "news-id-format", F.format_string(
            'Item "%s" (source "%s") does not look like a deterministic id', "id", "source_id"), listed)
        .unionByName(checks.issues(stays.where(listed > 1), "news-duplicate-id", F.format_string(
            'Duplicate active item id "%s"', "id"), listed - 1))
        .unionByName(checks.issues(orphans, "state-orphaned-entry", F.format_string(
            'State entry "%s" has no matching active item and is not a live ignore tombstone',
            "id"))))


def changed_states(ledger: DataFrame) -> DataFrame:
    """States that a run adds, and a row without a state for each that it takes away."""
    synced = F.col("fate") == "synced"
    return ledger.where("fate IN ('synced', 'pruned', 'expired')").select(
        "id", *[F.when(synced, F.col(n)).alias(n)
                for n in ("state", "updated_at", "read_at", "ignored_at", "seq")])


def shape_issues(kind: str, rows: DataFrame, expectations: dict) -> DataFrame:
    """Fields of rows about to be written that break their schema, with how many rows do."""
    broken = checks.violations(rows, expectations).where("violations > 0")
    return checks.issues(broken, f"{kind}-shape", F.format_string(
        f'%d {kind} row(s) have an invalid "%s"', "violations", "field"))


def collect_run(store: Store, payloads: DataFrame, sources: DataFrame, references: DataFrame,
                now, registry: AdapterRegistry | None = None, volume_limit: int = S.VOLUME_LIMIT,
                allow_large_change: bool = False, dedup_policy: str = "most_specific",
                since: DataFrame | None = None) -> RunResult:
    """Run once and publish. ``allow_large_change`` waives the volume guard only.

    ``since`` has the cursors that windows and first syncs count from, where those are not
    the newest: a stream takes the ones it started from for all its batches.
    """
    registry = registry or default_registry()
    issues = registry_issues(sources, references).unionByName(unsupported_adapters(sources, registry))
    broken = issues.count()
    if broken:
        first = issues.orderBy("check", "message").take(20)
        lines = "\n".join(f"[{r['check']}] {r['message']}" for r in first)
        more = f"\n({broken} issues in all)" if broken > len(first) else ""
        return RunResult(False, f"Config invalid, collection stopped before any fetch: {lines}{more}",
                         aborted=True, issues=issues)
    store.bootstrap()
    run_id = store.version
    used = {r["adapter"] for r in sources.where("status <> 'planned'").select("adapter")
            .distinct().collect()}
    registry = AdapterRegistry(a for a in registry.values() if a.name in used)
    for fragment in registry.fragments().values():
        store.declare(fragment.table, fragment.schema)

    # Collect: parse once, then scope, window, baseline, de-duplicate, merge.
    landed = landed_payloads(evenly_parallel(payloads), sources)
    parsed = store.stage(parse_payloads(landed, registry).drop("body"), "parsed")
    stages, cursors = store.read("lifecycle_stage"), store.read("cursors")
    kept = {name: store.read(f.table) for name, f in registry.fragments().items()}
    scoped, observed = collected_items(parsed, stages, registry, now, kept)
    scoped = store.stage(scoped, "collected")
    windowed = increment.within_window(scoped, increment.source_bounds(
        sources, cursors if since is None else since), now)

    def stage_outcomes() -> DataFrame:
        return store.stage(out.source_outcomes(sources, parsed, scoped, now), "outcomes")

    def stage_fresh() -> DataFrame:
        return store.stage(increment.fresh_undated(windowed, store.read("known_undated")), "fresh")

    outcomes, fresh, (unequal, consistent) = together(stage_outcomes, stage_fresh, store.audit)
    succeeded = outcomes.where("outcome = 'succeeded'").select("source_id")
    imported = increment.importable(windowed, fresh)
    arrival = F.struct("pos", "seq", "at")
    if dedup_policy == "most_specific":
        unique = most_specific(imported, F.col("id"), specificity(F.col("filters")),
                               F.col("source_id"), arrival)
    elif dedup_policy == "first_seen":
        unique = first_seen(imported, ["id"], ["pos", "seq", "at"])
    else:
        raise ValueError(f"Unknown dedup policy {dedup_policy!r}")

    # Sync, clean up and check on one join of items with states.
    def stage_added_and_ledger() -> tuple[DataFrame, DataFrame, list[int]]:
        batch = store.stage(unique, "unique")
        existing, states, segments = ledger_inputs(store, batch, consistent, now)
        added = store.stage(not_in_history(batch, existing, ["id"])
                            .select(*classify.ITEM_COLUMNS), "added")
        return added, store.stage(item_ledger(existing, added, states, now), "ledger"), segments

    def stage_cursors() -> DataFrame:
        return store.stage(increment.advance_cursors(cursors, imported, succeeded, now), "cursors")

    (added, ledger, segments), new_cursors = together(stage_added_and_ledger, stage_cursors)
    # Of states that are there already, all are looked at; those of the ledger are the new ones.
    stored = with_fate(store.read("states"), now).where("fate IN ('ignored', 'kept')")
    states = stored.drop("fate").unionByName(ledger.where("fate = 'synced'").select(*S.STATE.fieldNames()))
    counts = ledger.agg(
        F.count_if("pruned").alias("pruned"),
        F.count_if(F.col("leaves") & (F.col("fate") == "ignored")).alias("scrubbed"),
        F.count_if(F.col("fate") == "expired").alias("expired"))
    name = f"run_id={run_id}"
    failures, statuses = together(
        lambda: store.write("failures", failure_lines(outcomes), name),
        lambda: store.write("source_status", out.source_status(outcomes, store.read("source_status")), name))
    found = (ledger_issues(ledger)
             .unionByName(shape_issues("item", added, checks.item_expectations()))
             .unionByName(shape_issues("state", states, checks.state_expectations()))
             .unionByName(shape_issues("cursor", new_cursors, checks.cursor_expectations()))
             .unionByName(shape_issues("source status", store.scan("source_status", statuses),
                                       checks.status_expectations())))
    written = store.write("issues", found, name)
    guards = (checks.append_only_guard(changed_items(store, unequal))
              .unionByName(checks.cursor_guard(cursors, new_cursors))
              .unionByName(checks.validation_guard(store.scan("issues", written))))
    if not allow_large_change:
        guards = guards.unionByName(checks.volume_guard(added, volume_limit))
    rejection = checks.first_rejection(guards)

    # Status is published whatever the guards say.
    runs = store.write("runs", run_row(outcomes, added, rejection, run_id, now), name)
    written_run = store.scan("runs", runs)
    off = checks.violations(written_run, checks.run_expectations()).where("violations > 0").collect()
    if off:
        raise ValueError(f"Run {run_id} breaks the schema of runs: {', '.join(r['field'] for r in off)}")
    row = written_run.first()
    rejected = row["rejected"].asDict() if row["rejected"] else None
    summary = run_summary(store.scan("failures", failures), counts, row)
    changed = {"source_status": statuses, "runs": store.directories["runs"] + runs,
               "issues": written, "failures": failures}
    if rejected:
        store.publish(changed)
        return RunResult(False, summary, rejected, segments_read=segments)

    leaving = ledger.where("leaves").select("id")
    stay = added.join(leaving, "id", "left_anti")
    removed = ledger.where("leaves AND copies > 0").select("id", F.lit(run_id).cast("long").alias("run_id"))

    def write_items() -> dict[str, list[str]]:
        before = store.directories.get("items", [])
        written, n = store.write_counted("items", stay, name)
        if not n:
            return {"items": before or written}
        indexed = store.index_segment(stay, name, n)
        return {"items": before + written, **{t: store.directories.get(t, []) + w for t, w in indexed.items()}}

    prints = stay.select("id", checks.item_digest(stay).alias("digest"), F.lit(run_id).cast("long").alias("run_id"))
    jobs = {
        "prints": lambda: store.append("prints", prints, name),
        "removed": lambda: store.append("removed", removed, name),
        "states": lambda: store.write_states(changed_states(ledger)),
        "cursors": lambda: store.write("cursors", new_cursors, name),
        "known_undated": lambda: store.append("known_undated", fresh.select("source_id", "id"), name),
    }
    if registry.named(snapshot=True):
        jobs["lifecycle_stage"] = lambda: store.write(
            "lifecycle_stage", lifecycle.upsert_stages(stages, observed), name)
    entries = classify.explode_entries(parsed)
    for adapter, fragment in registry.fragments().items():
        own = entries.where(F.col("adapter") == adapter)
        jobs[fragment.table] = lambda f=fragment, rows=own, a=adapter: store.write(
            f.table, f.merged(rows, kept[a]), name)
    items, *rest = together(write_items, *jobs.values())
    changed.update(items | dict(zip(jobs, rest, strict=True)))
    store.publish(changed)
    return RunResult(True, summary, segments_read=segments)


def earliest_start(sources: DataFrame, cursors: DataFrame, now):
    """The earliest moment from which a run accepts anything from a source that it collects;
    None if it collects from none."""
    collected = sources.where(F.col("status") != "planned")
    start = window_start(F.col("last_run_at"), F.col("initial_sync_from"), now)
    return increment.source_bounds(collected, cursors).agg(F.min(start).alias("start")).first()["start"]


def collect_landed(store: Store, landing: Landing, sources: DataFrame, references: DataFrame, now,
                   **options) -> RunResult:
    """:func:`collect_run` over an archive of landed payloads, of which only the files from the
    earliest window on are opened.

    What was fetched before a source's window began can hold nothing new of it: it was there
    for the run that set the cursor.
    """
    start = earliest_start(sources, store.read("cursors"), now)
    return collect_run(store, landing.since(start), sources, references, now, **options)


def run_row(outcomes: DataFrame, added: DataFrame, rejection: DataFrame, run_id: int,
            now) -> DataFrame:
    """The row of this run: coverage counts and the rejection, if any.

    Three one-row inputs are stacked and folded by an aggregate, so nothing is joined.
    """
    coverage = out.run_coverage(outcomes).select("succeeded", "failed", "planned", "total")
    total = added.agg(F.count("*").alias("added"))
    stacked = (coverage.unionByName(total, allowMissingColumns=True)
               .unionByName(rejection.select(F.struct("reason", "detail").alias("rejected")),
                            allowMissingColumns=True))
    names = ("succeeded", "failed", "planned", "added", "total")
    return stacked.agg(*[F.max(n).alias(n) for n in names], F.max("rejected").alias("rejected")).select(
        F.lit(run_id).cast("long").alias("run_id"), now_literal(now).alias("last_run_at"),
        F.struct(*names).alias("coverage"), "rejected")
