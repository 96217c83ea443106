"""The landing archive, adapters with state of their own, and what guards the store's versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from feedledger import schemas as S
from feedledger.plans.collect import collect_landed, collect_run
from feedledger.plans.queries.runs import NUMBERED
from feedledger.plans.store import Store
from feedledger.sources.adapters import Adapter, AdapterRegistry, Fragment
from feedledger.sources.feeds import parse_feed
from feedledger.sources.landing import Landing
from helpers import payloads, references, rss, sources

DAY = "Sat, 31 Jan 2026 10:00:00 GMT"


# Landing ---------------------------------------------------------------------------------

def at(spark, *rows):
    """Payloads ``(seq, time or None)``."""
    return spark.createDataFrame(list(rows), "seq BIGINT, t STRING").select(
        F.lit("s").alias("source_id"), F.lit("u").alias("url"), F.lit(200).alias("http_status"),
        F.to_timestamp("t").alias("fetched_at"), F.lit("b").alias("body"), "seq")


def seqs(frame):
    return sorted(r["seq"] for r in frame.collect())


def test_only_files_of_the_window_are_opened(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    assert landing.since(None).count() == 0 and landing.since(dt.datetime(2026, 1, 1)).count() == 0
    rows = at(spark, *((d * 24 + h, f"2026-01-{d:02d} {h:02d}:00:00") for d in range(1, 31) for h in (0, 5, 23)), (9999, None))
    landing.land(rows.repartition(4))
    opened = {}
    for start in ("2026-01-30 05:00:00", "2026-01-30 05:00:01", "2026-01-28 00:00:00"):
        moment = dt.datetime.fromisoformat(start)
        found = landing.since(moment)
        want = seqs(rows.where(F.col("fetched_at").isNull() | (F.col("fetched_at") >= F.lit(moment))))
        assert seqs(found) == want
        opened[start] = set(found.inputFiles())
    assert all("fetch_day=2026-01-30" in f or "__HIVE_DEFAULT" in f for f in opened["2026-01-30 05:00:01"])
    # The archive grows by a month of older payloads: not one more file is opened.
    landing.land(at(spark, *((d, f"2025-12-{d:02d} 00:00:00") for d in range(1, 31))))
    for start, files in opened.items():
        assert set(landing.since(dt.datetime.fromisoformat(start)).inputFiles()) == files
    assert len(seqs(landing.since(None))) == 91 + 30
    listed = landing.files(dt.datetime(2026, 1, 30))
    assert "PartitionFilters: [(isnull(fetch_day" in listed._jdf.queryExecution().executedPlan().toString()


def test_what_no_list_names_is_not_read(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    at(spark, (1, "2026-01-01 00:00:00")).withColumn("fetch_day", F.to_date("fetched_at")).write.partitionBy(
        "fetch_day").parquet(f"{tmp_path}/payloads/died")
    landing.land(at(spark, (2, "2026-01-01 00:00:00")))
    landing.land(at(spark))
    assert seqs(landing.since(dt.datetime(2025, 1, 1))) == [2]


def test_a_run_over_the_archive(spark, tmp_path):
    landing, store = Landing(spark, str(tmp_path / "landing")), Store(spark, str(tmp_path / "store"))
    rows, none = sources(spark, {"id": "s"}, {"id": "later", "status": "planned", "initial_sync_from": "2020-01-01"}), references(spark)
    old = payloads(spark, ("s", rss(("Old", "/old", DAY)))).withColumn("fetched_at", F.lit("2025-12-31").cast("timestamp"))
    landing.land(old)
    landing.land(payloads(spark, ("s", rss(("A", "/a", DAY)))))
    # The first sync is approved from 2026 on, whatever the archive holds from before.
    assert "1 added" in collect_landed(store, landing, rows, none, "2026-02-01 00:00:00").summary
    landing.land(payloads(spark, ("s", rss(("B", "/b", "3 Feb 2026 10:00:00 GMT")))).withColumn(
        "fetched_at", F.lit("2026-02-03 12:00:00").cast("timestamp")))
    assert "1 added" in collect_landed(store, landing, rows, none, "2026-02-04 00:00:00").summary
    assert sorted(r["heading"] for r in store.items().collect()) == ["A", "B"]


# Adapters with state ---------------------------------------------------------------------

def numbered(spark, *numbers):
    return payloads(spark, ("s", rss(*((f"N{n}", f"/n/{n}", DAY) for n in numbers))))


def test_adapter_state_lasts_over_accepted_runs_only(spark, tmp_path):
    store, none = Store(spark, str(tmp_path)), references(spark)
    registry = AdapterRegistry([NUMBERED])
    rows = sources(spark, {"id": "s", "adapter": "numbered"}, {"id": "t", "adapter": "numbered"})

    def run(landed, **options):
        return collect_run(store, landed, rows, none, "2026-02-01 00:00:00", registry, **options)

    def marks():
        return {r["source_id"]: r["mark"] for r in store.read("numbered_marks").collect()}

    assert "2 added" in run(numbered(spark, 5, 7)).summary
    assert marks() == {"s": 7}
    rejected = run(numbered(spark, 6, 8, 9), volume_limit=1)
    assert not rejected.accepted and marks() == {"s": 7}
    assert "2 added" in run(numbered(spark, 6, 8, 9)).summary  # 6 is below the mark
    assert marks() == {"s": 9}
    both = numbered(spark, 3).unionByName(payloads(spark, ("t", rss(("T", "/n/1", DAY))), ("s", "broken", 500)))
    assert "1 added" in run(both).summary
    assert marks() == {"s": 9, "t": 1}
    # A session that knows nothing of the adapter leaves its table alone.
    plain = Store(spark, str(tmp_path))
    plain.compact()
    plain.vacuum(keep=1)
    store.refresh()
    assert marks() == {"s": 9, "t": 1}


def test_state_tables_are_checked():
    schema = StructType([StructField("source_id", StringType()), StructField("n", LongType())])
    keep = Fragment("own", schema, lambda entries, previous: previous)
    with pytest.raises(ValueError, match="no source_id"):
        AdapterRegistry([Adapter("a", "feed-entry", parse_feed, fragment=Fragment(
            "own", StructType([schema["n"]]), keep.derive))])
    with pytest.raises(ValueError, match="Two adapters"):
        AdapterRegistry([Adapter(n, "feed-entry", parse_feed, fragment=keep) for n in "ab"])


def test_tables_are_declared_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for name in ("items", "_versions", "../x"):
        with pytest.raises(ValueError):
            store.declare(name, S.CURSOR)
    store.declare("own", S.CURSOR)
    store.declare("own", S.CURSOR)
    assert store.read("own").count() == 0
    with pytest.raises(ValueError, match="another schema"):
        store.declare("own", S.STATE)


# Versions --------------------------------------------------------------------------------

def test_an_absent_version_is_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no version 3"):
        store.refresh(3)
    store.bootstrap()
    for _ in range(3):
        store.publish({})
    store.vacuum(keep=1)
    with pytest.raises(ValueError, match="no version 1"):
        Store(spark, str(tmp_path)).refresh(1)
    assert Store(spark, str(tmp_path)).refresh(4).version == 4


def test_a_version_is_published_once(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.bootstrap()
    two.refresh()
    one.publish({"issues": ["issues/one"]})
    with pytest.raises(ValueError, match="another writer"):
        two.publish({"issues": ["issues/two"]})
    assert Store(spark, str(tmp_path)).directories["issues"] == ["issues/one"]
    # A writer that died has left a folder, but no version.
    (tmp_path / "_versions" / f"version={one.version + 1}" / "_temporary").mkdir(parents=True)
    one.publish({})
    assert Store(spark, str(tmp_path)).version == one.version


def test_vacuum_spares_what_an_open_stream_began_from(spark, tmp_path):
    from feedledger.streaming.micro_batches import _mark, _start_version
    store = Store(spark, str(tmp_path))
    store.bootstrap()
    assert _start_version(spark, str(tmp_path), "d") == (0, 1)
    for _ in range(3):
        store.publish({})
    store.vacuum(keep=1)
    assert _start_version(spark, str(tmp_path), "d") == (0, 1) and Store(spark, str(tmp_path)).refresh(1).version == 1
    _mark(spark, str(tmp_path), "d", 0, 1, True)
    assert "_versions/version=1" in store.vacuum(keep=1)
