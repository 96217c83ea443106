"""Row expectations, invariants over tables, and change guards.

Counts are exact and come from aggregates. Messages are rows of an issues table, so any
number of them can be written; only a view for people takes the first few. ``times`` says
how many issues a row stands for: an id repeated a billion times is one row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.dates import is_live_tombstone
from ..functions.urls import canonical_url
from .dedup import duplicate_keys

ID_FORMAT = "^[0-9a-f]{16}$"


def _present(name: str) -> Column:
    return F.col(name) != ""


def item_expectations() -> dict[str, Column]:
    return {
        "id": _present("id"), "source_id": _present("source_id"), "heading": _present("heading"),
        "label": F.col("label").isin(*S.LABELS),
        "link": canonical_url(F.col("link")).isNotNull(),
        "date": F.col("date").isNotNull(),
        "date_basis": F.col("date_basis").isin(*S.DATE_BASES),
        "category": F.col("category").isin(*[c for c, _ in S.CATEGORIES]),
        "tags": F.col("tags").isNotNull() & ~F.exists("tags", lambda t: t.isNull()),
    }


def state_expectations() -> dict[str, Column]:
    return {
        "id": _present("id"), "state": F.col("state").isin(*S.STATES),
        "updated_at": F.col("updated_at").isNotNull(),
    }


def cursor_expectations() -> dict[str, Column]:
    return {
        "source_id": _present("source_id"), "last_run_at": F.col("last_run_at").isNotNull(),
        "last_item_id": F.col("last_item_id").isNull() | _present("last_item_id"),
    }


def status_expectations() -> dict[str, Column]:
    known = F.col("failure_class").isNull() | F.col("failure_class").isin(*S.FAILURE_CLASSES)
    return {"source_id": _present("source_id"),
            "status": F.col("status").isin(*S.SOURCE_STATUSES), "failure_class": known}


def run_expectations() -> dict[str, Column]:
    counts = F.lit(True)
    for name in ("succeeded", "failed", "planned", "added", "total"):
        counts = counts & (F.col(f"coverage.{name}") >= 0)
    rejected = F.col("rejected").isNull() | (
        F.col("rejected.reason").isin(*S.REJECTION_REASONS) & (F.col("rejected.detail") != ""))
    return {"last_run_at": F.col("last_run_at").isNotNull(), "coverage": counts,
            "rejected": rejected}


def violations(rows: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """``(field, violations)`` for every expectation, in a single aggregate pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name)
                         for name, ok in expectations.items()])
    return counted.unpivot([], list(expectations), "field", "violations")


def issues(rows: DataFrame, check: str, message: Column, times: Column | None = None) -> DataFrame:
    """Issue rows ``(check, message, times)``."""
    times = F.lit(1) if times is None else times
    return rows.select(F.lit(check).alias("check"), message.alias("message"),
                       times.cast("long").alias("times"))


def item_issues(items: DataFrame) -> DataFrame:
    """Ids of the wrong form, and an issue for each repeat of an id."""
    malformed = items.where(~F.coalesce(F.col("id").rlike(ID_FORMAT), F.lit(False)))
    repeats = duplicate_keys(items, ["id"])
    return issues(malformed, "news-id-format", F.format_string(
        'Item "%s" (source "%s") does not look like a deterministic id', "id", "source_id"),
    ).unionByName(issues(repeats, "news-duplicate-id", F.format_string(
        'Duplicate active item id "%s"', "id"), F.col("n") - 1))


def missing_states(items: DataFrame, states: DataFrame) -> DataFrame:
    return items.join(states.select("id"), "id", "left_anti")


def orphan_states(items: DataFrame, states: DataFrame, now) -> DataFrame:
    """States without an item that are not live tombstones."""
    return (states.where(~is_live_tombstone(F.col("state"), F.col("ignored_at"), now))
            .join(items.select("id"), "id", "left_anti"))


def state_issues(items: DataFrame, states: DataFrame, now) -> DataFrame:
    missing = issues(missing_states(items, states), "state-missing-for-item", F.format_string(
        'Active item "%s" has no reading state', "id"))
    orphan = issues(orphan_states(items, states, now), "state-orphaned-entry", F.format_string(
        'State entry "%s" has no matching active item and is not a live ignore tombstone', "id"))
    return missing.unionByName(orphan)


def data_issues(items: DataFrame, states: DataFrame, now) -> DataFrame:
    """The stand-alone data check, also the gate before reading state is published."""
    return item_issues(items).unionByName(state_issues(items, states, now))


# Change guards -----------------------------------------------------------------

#: The order in which rejections take precedence.
GUARD_ORDER = {"volume-guard": 1, "active-item-mutation": 2, "cursor-regression": 3,
               "validation-failed": 4}


def _guard(rows: DataFrame, reason: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(GUARD_ORDER[reason]).alias("ord"), F.lit(reason).alias("reason"),
                       detail.alias("detail"))


def volume_guard(added: DataFrame, limit: int = S.VOLUME_LIMIT) -> DataFrame:
    """Rejects if more than ``limit`` items were added."""
    return _guard(
        added.agg(F.count("*").alias("n")).where(F.col("n") > limit), "volume-guard",
        F.format_string(f"%d items added, exceeds threshold of {limit}", "n"))


#: Fields of an item that are append-only.
COMPARED = ("source_id", "heading", "label", "link", "date", "date_basis", "category", "tags")


def append_only_diff(previous: DataFrame, current: DataFrame, removed: DataFrame) -> DataFrame:
    """``(id, change)`` of items deleted outside cleanup or modified.

    A null-safe comparison of whole rows; the order of tags counts.
    """
    compared = [c for c in COMPARED if c in previous.columns]
    old = previous.select("id", F.struct(*compared).alias("_old"))
    new = current.select("id", F.struct(*compared).alias("_new"))
    changed = (old.join(new, "id", "left")
               .where(F.col("_new").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
               .select("id", F.when(F.col("_new").isNull(), F.lit("deleted"))
                       .otherwise(F.lit("modified")).alias("change")))
    legitimate = removed.select("id", F.lit("deleted").alias("change"))
    return changed.join(legitimate, ["id", "change"], "left_anti")


def item_digest(items: DataFrame) -> Column:
    """One number for the fields of an item that may never change; the order of tags counts."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in COMPARED if c in items.columns])))


def append_only_guard(changes: DataFrame) -> DataFrame:
    """First offending id stands for the rest; rows come from :func:`append_only_diff`."""
    first = changes.agg(F.min_by(F.struct("id", "change"), "id").alias("c")).where("c IS NOT NULL")
    return _guard(first, "active-item-mutation", F.when(
        F.col("c.change") == "deleted",
        F.format_string('Active item "%s" was deleted outside of cleanup', "c.id")).otherwise(
        F.format_string('Active item "%s" was modified; item metadata is append-only', "c.id")))


def cursor_regressions(previous: DataFrame, updated: DataFrame) -> DataFrame:
    """Sources whose cursor would move backward; instants are compared, not text."""
    return updated.select("source_id", F.col("last_run_at").alias("to_ts")).join(
        previous.select("source_id", F.col("last_run_at").alias("from_ts")), "source_id",
    ).where("to_ts < from_ts")


def cursor_guard(previous: DataFrame, updated: DataFrame) -> DataFrame:
    def iso(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    first = cursor_regressions(previous, updated).agg(
        F.min_by(F.struct("source_id", "from_ts", "to_ts"), "source_id").alias("c")
    ).where("c IS NOT NULL").select("c.*")
    return _guard(first, "cursor-regression", F.format_string(
        'Source "%s" cursor regressed from %s to %s', "source_id", iso("from_ts"), iso("to_ts")))


def validation_guard(found: DataFrame, shown: int = 100) -> DataFrame:
    """Rejects if there is any issue; exact count, the first ``shown`` messages."""
    line = F.concat(F.lit("["), "check", F.lit("] "), "message")
    lines = found.select(F.struct(line.alias("line"), "times").alias("l"))
    total = lines.agg(F.sum("l.times").alias("n"))
    first = lines.orderBy("l.line").limit(shown)
    one = total.unionByName(first, allowMissingColumns=True).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list("l")).alias("ls")).where("n > 0")
    repeated = F.flatten(F.transform("ls", lambda x: F.array_repeat(
        x["line"], F.least(x["times"], F.lit(shown)).cast("int"))))
    more = F.when(F.col("n") > shown, F.format_string("\n(%d issues in all)", "n")).otherwise("")
    return _guard(one, "validation-failed", F.concat(
        F.array_join(F.slice(repeated, F.lit(1), F.lit(shown)), "\n"), more))


def first_rejection(guards: DataFrame) -> DataFrame:
    """The rejection that counts, at most one row."""
    return (guards.agg(F.min_by(F.struct("reason", "detail"), "ord").alias("r"))
            .where("r IS NOT NULL").select("r.reason", "r.detail"))
