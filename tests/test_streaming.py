"""Several micro-batches give what one batch gives."""

from pyspark.sql import functions as F

from feedledger import schemas as S
from feedledger.plans.queries import streams
from feedledger.plans.reading import change_states
from feedledger.plans.store import Store
from feedledger.session import ROWS_A_TASK, evenly_parallel
from feedledger.streaming.micro_batches import (
    collect_stream, file_stream, first_within_overlap, transition_stream,
)
from helpers import items, payloads, references, rss, sources
from test_operators import brute_fold, transitions

DAY = "Sat, 31 Jan 2026 10:00:00 GMT"


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_runs_per_micro_batch(spark, tmp_path):
    folder, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(payloads(spark, ("s", rss(("A", "/a", DAY), ("Old", "/old", None)))), folder)
    land(payloads(spark, ("s", rss(("A again", "/a", DAY), ("B", "/b", DAY), ("New", "/new", None)))), folder)
    stream = file_stream(spark, folder, S.PAYLOAD, files_per_batch=1)
    results = []
    rows, none = sources(spark, {"id": "s"}), references(spark)
    collect_stream(root, stream, rows, none, lambda b: f"2026-02-01 0{b}:00:00", str(tmp_path / "log"),
                   results.append).awaitTermination()
    assert len(results) == 2 and all(r.accepted for r in results)
    store = Store(spark, root)
    assert sorted(r["heading"] for r in store.items().collect() if r["date_basis"] == "published") == ["A", "B"]
    before = store.version
    # Nothing new has landed, so the checkpoint leaves nothing to do.
    collect_stream(root, stream, rows, none, lambda b: "2026-02-02 00:00:00", str(tmp_path / "log"),
                   results.append).awaitTermination()
    assert Store(spark, root).version == before


def test_the_cut_of_a_backlog_decides_nothing(spark, tmp_path):
    one = payloads(spark, ("s", rss(("Jan", "/j", "5 Jan 2026 10:00:00 GMT"), ("U0", "/u0", None))),
                   ("s", rss(("Jan b", "/jb", "6 Jan 2026 10:00:00 GMT"), ("U", "/u", None))),
                   ("s", rss(("New", "/n", DAY))))
    rows, none, seen = sources(spark, {"id": "s"}), references(spark), {}
    for cut in (1, 3):
        folder, root = str(tmp_path / f"landed{cut}"), str(tmp_path / f"store{cut}")
        for i in range(cut):
            land(one if cut == 1 else one.where(F.col("seq") == i), folder)
        args = (root, file_stream(spark, folder, S.PAYLOAD, files_per_batch=1), rows, none)
        collect_stream(*args, lambda b: "2026-02-01 00:00:00", str(tmp_path / f"log{cut}"))
        store = Store(spark, root)
        seen[cut] = (sorted(r["heading"] for r in store.items().collect()), store.read("known_undated").count())
        # What lands after the backlog is no first sync.
        land(payloads(spark, ("s", rss(("U", "/u", None), ("V", "/v", None)))).withColumn("seq", F.lit(9).cast("long")), folder)
        collect_stream(*args, lambda b: "2026-02-02 00:00:00", str(tmp_path / f"log{cut}"))
        seen[cut] += (sorted(r["heading"] for r in store.refresh().items().collect()),)
    assert seen[1] == seen[3] == (["Jan", "Jan b", "New"], 2, ["Jan", "Jan b", "New", "V"])


def test_transitions_in_any_order_of_batches(spark, tmp_path):
    rows = [("a", "unread", "2026-01-01 00:00:00", 1), ("a", "read", "2026-01-05 00:00:00", 2),
            ("b", "read", "2026-01-03 00:00:00", 3), ("b", "ignored", "2026-01-02 00:00:00", 4),
            ("b", "ignored", "2026-01-04 00:00:00", 5), ("c", "read", "2026-01-01 00:00:00", 6),
            ("c", "unread", "2026-01-01 00:00:00", 7)]
    want = brute_fold(rows)
    for name, order in (("up", range(7)), ("down", range(6, -1, -1)), ("mixed", (4, 1, 6, 3, 0, 5, 2))):
        root = str(tmp_path / name)
        store = Store(spark, root)
        store.bootstrap()
        store.publish({"items": store.write("items", items(spark, {"id": "a"}, {"id": "b"}, {"id": "c"}), "run_id=0")})
        for i in order:
            change_states(store, transitions(spark, rows[i]))
        got = {r["id"]: tuple(None if v is None else str(v) for v in (r["state"], r["updated_at"], r["read_at"], r["ignored_at"]))
               for r in store.read("states").collect()}
        assert got == want, name
        assert sorted(r["id"] for r in store.items().collect()) == ["a", "c"]


def test_transitions_over_batches(spark, tmp_path):
    root, folder = str(tmp_path / "store"), str(tmp_path / "moves")
    store = Store(spark, root)
    store.bootstrap()
    store.publish({"items": store.write("items", items(spark, {"id": "a"}, {"id": "b"}, {"id": "c"}), "run_id=0")})
    rows = [("a", "read", "2026-01-01 00:00:00", 1), ("b", "ignored", "2026-01-01 00:00:00", 2),
            ("a", "unread", "2026-01-02 00:00:00", 3), ("b", "read", "2026-01-02 00:00:00", 4),
            ("c", "read", "2026-01-02 00:00:00", 5), ("c", "ignored", "2026-01-02 00:00:00", 6),
            ("c", "unread", "2026-01-02 00:00:00", 7), ("x", "read", "2026-01-02 00:00:00", 8)]
    land(transitions(spark, *rows[:2]), folder)
    land(transitions(spark, *rows[2:]), folder)
    stream = file_stream(spark, folder, S.TRANSITION, files_per_batch=1)
    transition_stream(root, stream, str(tmp_path / "log")).awaitTermination()
    store.refresh()
    got = {r["id"]: tuple(None if v is None else str(v) for v in (r["state"], r["updated_at"], r["read_at"], r["ignored_at"]))
           for r in store.read("states").collect()}
    assert got == brute_fold([r for r in rows if r[0] != "x"])
    assert [r["id"] for r in store.items().collect()] == ["a"]


def test_first_within_overlap_keeps_one_row_per_key(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark.createDataFrame([("k", "2026-01-01 00:00:00"), ("m", "2026-01-01 00:00:00")], "k STRING, t STRING")
         .select("k", F.to_timestamp("t").alias("ts")), folder)
    land(spark.createDataFrame([("k", "2026-01-02 00:00:00")], "k STRING, t STRING")
         .select("k", F.to_timestamp("t").alias("ts")), folder)
    stream = first_within_overlap(file_stream(spark, folder, "k STRING, ts TIMESTAMP", files_per_batch=1), ["k"], "ts")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log"))
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["k"] for r in spark.read.schema("k STRING, ts TIMESTAMP").parquet(out).collect()) == ["k", "m"]


def test_a_file_with_one_row_group_is_dealt_evenly(spark, tmp_path):
    n, folder = 4 * ROWS_A_TASK, str(tmp_path / "one")
    spark.range(n, numPartitions=1).select("id", F.lit("s").alias("source_id"), F.map_from_arrays(
        F.array("id"), F.array("id")).alias("m")).write.parquet(folder)
    rows = evenly_parallel(spark.read.option("maxPartitionBytes", 1 << 16).parquet(folder))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) < 1.2 * n / len(sizes)
    assert evenly_parallel(spark.range(0)).count() == 0


def test_large_batches_land_in_several_files_and_stay_batches(spark, tmp_path):
    for name, n, files in (("few", 30, 1), ("many", 3 * streams.MANY_ROWS, streams.FILES)):
        rows = spark.range(n).withColumn("v", F.lit(1))
        streams._landed(spark, str(tmp_path / name), rows, F.col("id"))
        landed = spark.read.parquet(str(tmp_path / name / "landed")).groupBy(F.input_file_name()).agg(
            F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
        assert len(landed) == 3 * files and sum(r["n"] for r in landed) == n
        assert all(r["low"] * 3 // n == r["high"] * 3 // n for r in landed)
