"""Read views: item page, sources by category, run status, alert."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import is_stale
from ..functions.text import plural, rejection_text
from ..operators.dedup import landing
from ..schemas import PAGE_SIZE, STATE_FILTERS
from ..sources.tables import latest_run

#: A day or range with at most this many rows before a page is not divided further to find
#: it. It bounds what a task holds and has no effect on the page.
NEAR = 100_000
#: Ranges a crowded day is divided into at a time.
PARTS = 1000
#: Registry positions that share a row of the nested sources view.
NESTED = 10_000


def with_state(items: DataFrame, states: DataFrame) -> DataFrame:
    """Items with their reading state; anything not read counts as unread."""
    read = states.where("state = 'read'").select("id", F.lit("read").alias("state"))
    return items.join(read, "id", "left").withColumn(
        "state", F.coalesce("state", F.lit("unread")))


def _in_category(items: DataFrame, category: str | None) -> DataFrame:
    return items if category is None else items.where(F.col("category") == category)


def _newest_first(rows: DataFrame) -> list[Column]:
    """Undated rows come last."""
    return [F.desc_nulls_last("date"), *[F.asc(c) for c in landing(rows)], F.asc("id")]


def _candidates(items: DataFrame, states: DataFrame, category: str | None, state: str) -> DataFrame:
    """Sort keys of the items a view shows; states are joined only if they filter."""
    if state not in STATE_FILTERS:
        raise ValueError(f"Unknown state filter {state!r}")
    keys = _in_category(items, category).select("id", "date", *landing(items))
    return keys if state == "all" else with_state(keys, states).where(F.col("state") == state)


def _page(items: DataFrame, states: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole rows and states for the few keys of a page.

    The keys go to the tables, so neither table is shuffled for a page.
    """
    ids = F.broadcast(keys.select("id"))
    shown = states.join(ids, "id", "left_semi")
    return with_state(items.join(ids, "id", "left_semi"), shown).orderBy(*_newest_first(items))


def item_page(items: DataFrame, states: DataFrame, category: str | None = None,
              state: str = "all", page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of items, newest first, ties in table order; past the end it is empty.

    Rows before the page are passed over by counts per date and, within a crowded date, per
    range of the landing order, so the top-k does not grow with the page number.
    """
    if page < 1:
        raise ValueError("page starts at 1")
    keys = _candidates(items, states, category, state)
    skip = (page - 1) * page_size
    if skip:
        keys, skip = _from_near(keys, skip)
    keys = keys.orderBy(*_newest_first(keys)).offset(skip).limit(page_size)
    return _page(_in_category(items, category), states, keys)


def _from_near(keys: DataFrame, skip: int) -> tuple[DataFrame, int]:
    """Keys from a row shortly before an offset on, and how many of them to skip.

    The date that holds the offset is found from a count per date, undated rows being the
    last of all. As long as many rows of that date lie before the offset, ranges of the
    landing order within it are counted the same way. Running totals are over the buckets,
    a row per calendar day or per range, and one row of them comes to the driver.
    """
    def locate(rows: DataFrame, bucket: Column, order: Column, skip: int):
        buckets = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy(order))
        found = buckets.withColumn("upto", upto).where(F.col("upto") > skip).orderBy("upto").first()
        return found and (found["bucket"], skip - (found["upto"] - found["n"]))

    found = locate(keys, F.col("date"), F.desc_nulls_last("bucket"), skip)
    if found is None:
        return keys.limit(0), 0
    day, skip = found
    on_day = F.col("date").eqNullSafe(F.lit(day).cast("date"))
    inside, start = keys.where(on_day), {}
    for column in landing(keys):
        while skip > NEAR:
            span = inside.agg(F.min(column).alias("low"), F.max(column).alias("high"),
                              F.count_if(F.col(column).isNull()).alias("unknown")).first()
            if span["unknown"]:
                break
            start[column] = span["low"]
            if span["low"] == span["high"]:
                break
            width = -(-(span["high"] - span["low"] + 1) // PARTS)
            part = F.floor((F.col(column) - span["low"]) / width).cast("long")
            part, skip = locate(inside, part, F.asc("bucket"), skip)
            start[column] = low = span["low"] + part * width
            inside = inside.where(F.col(column).between(low, low + width - 1))
        if skip <= NEAR or span["unknown"]:
            break
    if start:
        here = F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in start.items()])
        on_day = on_day & (F.struct(*start) >= here)
    older = F.lit(False) if day is None else F.col("date").isNull() | (F.col("date") < F.lit(day))
    return keys.where(older | on_day), skip


def items_after(items: DataFrame, states: DataFrame, date, seq: int, item_id: str,
                category: str | None = None, state: str = "all",
                page_size: int = PAGE_SIZE, at: int | None = None) -> DataFrame:
    """The page that follows a given row; its cost does not depend on how far in it is.

    ``date`` is None for an undated row; ``at`` is its place in its payload, if it has one.
    """
    keys = _candidates(items, states, category, state)
    day = F.lit(date).cast("date")
    here = [F.lit(v).cast(keys.schema[c].dataType).alias(c)
            for c, v in (("seq", seq), ("at", at), ("id", item_id)) if c in keys.columns]
    later = F.struct(*landing(keys), "id") > F.struct(*here)
    behind = (F.col("date") < day) | (F.col("date").isNull() & day.isNotNull()) | (
        F.col("date").eqNullSafe(day) & later)
    keys = keys.where(behind).orderBy(*_newest_first(keys)).limit(page_size)
    return _page(_in_category(items, category), states, keys)


def item_counts(items: DataFrame, states: DataFrame, category: str | None = None,
                page_size: int = PAGE_SIZE) -> DataFrame:
    """All, unread and read counts and the page count of each filter, in one pass."""
    counted = with_state(_in_category(items, category), states).agg(
        F.count("*").alias("all_items"), F.count_if(F.col("state") == "unread").alias("unread"),
        F.count_if(F.col("state") == "read").alias("read"))

    def pages(name: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(name) / page_size)).cast("long").alias(f"{name}_pages")

    return counted.select("all_items", "unread", "read", pages("all_items"), pages("unread"),
                          pages("read"))


def monitored_sources(sources: DataFrame, status: DataFrame) -> DataFrame:
    """Sources with their runtime status, which beats the configured one."""
    runtime = status.select(
        F.col("source_id").alias("id"), F.col("status").alias("_status"), "last_success_at",
        "last_attempt_at", F.col("reason").alias("failure_reason"))
    return sources.join(runtime, "id", "left").withColumn(
        "status", F.coalesce("_status", "status")).drop("_status")


def category_coverage(categories: DataFrame, monitored: DataFrame) -> DataFrame:
    """Coverage per category in display order, empty categories included."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("status") == kind).alias(kind)

    counts = monitored.groupBy("category").agg(
        count("active"), count("failing"), count("planned"), F.count("*").alias("total"))
    filled = categories.join(counts, "category", "left").na.fill(
        0, ["active", "failing", "planned", "total"])
    return filled.orderBy("ord")


def sources_listing(categories: DataFrame, monitored: DataFrame, references: DataFrame
                    ) -> DataFrame:
    """The sources view, one row per source with the coverage of its category.

    Categories in display order, monitored sources before reference-only ones, each in
    registry order. A category without sources has one row without a source.
    """
    null = F.lit(None)
    shown = ("pos", "id", "name", "url", "kind", "status", "last_success_at", "last_attempt_at",
             "failure_reason", "tags")
    watched = monitored.select("category", *shown, null.cast("string").alias("note"),
                               F.lit(True).alias("monitored"))
    listed = references.select("category", "pos", "id", "name", "url", "note",
                               F.lit(False).alias("monitored"))
    rows = watched.unionByName(listed, allowMissingColumns=True)
    coverage = F.struct("active", "failing", "planned", "total").alias("coverage")
    heads = category_coverage(categories, monitored).select("ord", "category", "title", coverage)
    # Categories are a fixed handful. With sources on the left a crowded category stays where
    # it was scanned; the categories that got none are added from their own table.
    listed_rows = rows.join(F.broadcast(heads), "category")
    empty = heads.join(rows.select("category").distinct(), "category", "left_anti")
    return (listed_rows.unionByName(empty, allowMissingColumns=True)
            .select("ord", "category", "title", "coverage", *[c for c in rows.columns if c != "category"])
            .orderBy("ord", F.desc("monitored"), "pos"))


def sources_by_category(categories: DataFrame, monitored: DataFrame, references: DataFrame) -> DataFrame:
    """The nested sources view, one row per category and ``part`` of the registry.

    A part spans :data:`NESTED` registry positions, so no cell grows with the registry; one
    that people can read has part 0 only. A category without sources has its row as well.
    """
    rows = sources_listing(categories, monitored, references)
    heads = ("ord", "category", "title", "coverage")
    columns = [c for c in rows.columns if c not in (*heads, "monitored")]
    one = F.struct(*columns)

    def nested(wanted: bool) -> Column:
        return F.array_sort(F.collect_list(F.when(
            F.col("id").isNotNull() & (F.col("monitored") == wanted), one)))

    part = F.coalesce(F.floor(F.col("pos") / NESTED), F.lit(0)).cast("long").alias("part")
    return rows.groupBy(*heads, part).agg(
        nested(True).alias("monitored"), nested(False).alias("reference_only")).orderBy("ord", "part")


def run_status(runs: DataFrame, now) -> DataFrame:
    """Newest run with its coverage, rejection and whether it is stale."""
    return latest_run(runs).select(
        "last_run_at", is_stale(F.col("last_run_at"), now).alias("stale"), "coverage", "rejected")


def severity(failed: Column, planned: Column, stale: Column, rejected: Column) -> Column:
    """Failure or rejection outranks incomplete or stale, which outranks healthy."""
    return (F.when(rejected | (failed > 0), F.lit("red"))
            .when((planned > 0) | stale, F.lit("orange")).otherwise(F.lit("green")))


def alert_title(failed: Column, planned: Column, stale: Column, reason: Column,
                detail: Column) -> Column:
    """Title of the alert; a rejection always comes first."""
    parts = F.concat_ws(
        ", ", F.when(planned > 0, F.concat(plural(planned, "source"), F.lit(" planned"))),
        F.when(stale, F.lit("collection is stale")))
    return (F.when(reason.isNotNull(), F.concat(
        F.lit("Collection rejected — "), rejection_text(reason, detail)))
        .when(failed > 0, F.concat(plural(failed, "source"), F.lit(" failing")))
        .when(parts != "", parts).otherwise(F.lit("All sources collecting successfully")))


def deep_link(monitored: DataFrame, categories: DataFrame, status: str) -> DataFrame:
    """First source with a status, in category then registry order; at most one row."""
    return (monitored.where(F.col("status") == status)
            .join(categories.select("category", "ord"), "category")
            .agg(F.min_by(F.struct("category", F.col("id").alias("source_id")),
                          F.struct("ord", "pos")).alias("r"))
            .where("r IS NOT NULL").select("r.*"))


def alert(status: DataFrame, monitored: DataFrame, categories: DataFrame) -> DataFrame:
    """Severity, title and the source to look at first, in one row."""
    c = F.col("coverage")
    rejected = F.col("rejected").isNotNull()
    base = status.select(
        severity(c["failed"], c["planned"], F.col("stale"), rejected).alias("severity"),
        alert_title(c["failed"], c["planned"], F.col("stale"), F.col("rejected.reason"),
                    F.col("rejected.detail")).alias("title"),
        rejected.alias("_rejected"))
    wanted = F.when(F.col("_rejected"), F.lit(None)).when(
        F.col("severity") == "red", F.lit("failing")).when(
        F.col("severity") == "orange", F.lit("planned"))
    links = deep_link(monitored, categories, "failing").withColumn("_wanted", F.lit("failing")) \
        .unionByName(deep_link(monitored, categories, "planned").withColumn("_wanted", F.lit("planned")))
    return (base.withColumn("_wanted", wanted).join(links, "_wanted", "left")
            .select("severity", "title", "category", "source_id"))
