"""What a run reads of the history: segments by their filters, whole segments only if they changed."""

import pytest
from pyspark.sql import functions as F

from feedledger.plans import collect
from feedledger.plans.store import Store
from helpers import items, payloads, references, rss, sources

DAY = "Sat, 31 Jan 2026 10:00:00 GMT"


def filled(spark, store, segments=6, each=40, ids_per_block=8):
    """A store of published segments with digests and filters; returns its items."""
    store.bootstrap()
    for _ in range(segments):  # versions of the runs that brought the segments
        store.publish({})
    changed = {"items": [], "prints": [], "digests": [], "filters": []}
    for n in range(segments):
        rows = items(spark, *({"key": f"{n}-{i}", "seq": i, "heading": f"{n} {i}"} for i in range(each)))
        name = f"run_id={n}"
        changed["items"] += store.write("items", rows, name)
        changed["prints"] += store.write("prints", rows.select("id", collect.checks.item_digest(rows).alias("digest"), F.lit(n).alias("run_id")), name)
        for table, written in store.index_segment(rows, name, each, ids_per_block).items():
            changed[table] += written
    states = store.scan("items", changed["items"]).select("id", F.lit("unread").alias("state"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"))
    store.publish({**changed, "states": store.write("states", states, f"version={store.version + 1}")})
    return store.read("items")


@pytest.mark.parametrize("ids_per_block", [8, 1_000_000])
def test_segments_that_hold_an_id_are_always_found(spark, tmp_path, ids_per_block):
    store = Store(spark, str(tmp_path))
    rows = filled(spark, store, each=40 if ids_per_block == 8 else 400, ids_per_block=ids_per_block)
    some = rows.where("run_id IN (1, 4) AND seq % 13 = 0").select("id")
    found = store.segments_holding(some.unionByName(some).unionByName(spark.createDataFrame([("no such id",), (None,)], "id STRING")))
    if ids_per_block == 8:
        assert found == [1, 4]
    else:  # every filter is full: false positives, and still no miss
        assert found == [0, 1, 2, 3, 4, 5]
    batch = some.unionByName(spark.createDataFrame([("new",)], "id STRING"))
    new = collect.not_in_history(batch, store.items_in(found), ["id"])
    assert [r["id"] for r in new.collect()] == ["new"]
    assert store.segments_holding(rows.limit(0).select("id")) == []
    # A segment that was written without a filter is always read.
    store.publish({"filters": store.directories["filters"][1:]})
    assert set(store.segments_holding(some)) >= {0, 1, 4}


def test_audit_names_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.audit() == ([], True)
    filled(spark, store)
    assert store.audit() == ([], True)
    whole = spark.createDataFrame(store.scan("items", ["items/run_id=3"]).collect(), store.read("items").schema)
    for rest, change in ((whole.withColumn("heading", F.concat("heading", F.when(F.col("seq") == 7, "!").otherwise(""))), "modified"),
                         (whole.where("seq <> 7"), "deleted")):
        store.write("items", rest, "run_id=3")
        segments, consistent = store.audit()
        assert segments == [3] and consistent == (change == "modified")
        the_id = whole.where("seq = 7").first()["id"]
        assert [tuple(r) for r in collect.changed_items(store, segments).collect()] == [(the_id, change)]
    store.write("items", whole.limit(0), "run_id=3")
    assert store.audit() == ([3], False)
    store.write("items", whole, "run_id=3")
    # A state too many, one too few, and an id off its form.
    states = store.read("states")
    for other in (states.unionByName(states.limit(1).withColumn("id", F.lit("orphan"))), states.where("id <> (SELECT min(id) FROM VALUES ('x') t(id))").limit(239)):
        store.publish({"states": store.write("states", other, f"version={store.version + 1}")})
        assert store.audit() == ([], False)


def test_an_undisturbed_run_neither_shuffles_nor_reads_the_whole_history(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    filled(spark, store)
    link = "https://example.com/a"
    before = store.version
    result = collect.collect_run(store, payloads(spark, ("s", rss(("A", "/a", DAY)))), sources(spark, {"id": "s"}),
                                 references(spark), "2026-02-01 00:00:00")
    assert result.accepted and result.segments_read == [] and store.version == before + 1
    again = collect.collect_run(store, payloads(spark, ("s", rss(("A", "/a", DAY), ("B", "/b", DAY)))), sources(spark, {"id": "s"}),
                                references(spark), "2026-02-01 06:00:00")
    assert again.accepted and again.segments_read == [before] and "1 added" in again.summary
    assert store.items().where(F.col("link") == link).count() == 1
    store.compact()
    assert store.audit() == ([], True) and len(store.segments()) == 1


def test_ids_are_added_up_where_they_lie(spark, tmp_path, monkeypatch):
    """The audit of a whole history exchanges partial sums only, a row per task and category."""
    store = Store(spark, str(tmp_path))
    filled(spark, store)
    plans = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", lambda self: plans.append(
        self._jdf.queryExecution().executedPlan().toString()) or [])
    store.audit()
    [plan] = plans
    assert "Join" not in plan
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "hashpartitioning(run_id" in line, line
