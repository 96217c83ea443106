"""Read views and exports."""

import pytest
from pyspark.sql import functions as F

from feedledger.plans import reading, summary, views
from feedledger.plans.store import Store
from feedledger.sources.tables import categories, read_items_json, read_states_json
from helpers import NOW, items, references, sources, states


def many(spark, n, **fields):
    return items(spark, *({"id": f"{i:05d}", "seq": i, **fields} for i in range(n)))


def no_states(spark):
    return spark.createDataFrame(
        [], "id STRING, state STRING, updated_at TIMESTAMP, read_at TIMESTAMP, ignored_at TIMESTAMP")


def test_pages_of_fifty(spark):
    rows, none = many(spark, 120), no_states(spark)
    sizes = [views.item_page(rows, none, "web-core", page=p).count() for p in (1, 2, 3, 4)]
    assert sizes == [50, 50, 20, 0]
    counts = views.item_counts(rows, none, "web-core").first()
    assert (counts["all_items"], counts["unread"], counts["read"], counts["all_items_pages"]) == (120, 120, 0, 3)
    assert views.item_counts(rows, none, "devops-cloud").first()["all_items_pages"] == 1
    with pytest.raises(ValueError):
        views.item_page(rows, none, page=0)


def test_state_filter_and_order(spark):
    rows = items(spark, {"id": "a", "date": "2026-01-01"}, {"id": "b", "date": "2026-01-02"}, {"id": "c", "date": "2026-01-02"})
    marks = states(spark, ("b", "read", NOW), ("c", "ignored", NOW))
    page = views.item_page(rows, marks)
    assert [(r["id"], r["state"]) for r in page.collect()] == [("b", "read"), ("c", "unread"), ("a", "unread")]
    assert [r["id"] for r in views.item_page(rows, marks, state="unread").collect()] == ["c", "a"]


@pytest.mark.parametrize("same_day", [True, False])
def test_far_pages_equal_plain_offsets(spark, same_day, monkeypatch):
    rows = items(spark, *({"id": f"{i:04d}", "seq": i * i % 997,
                           "date": "2026-01-05" if same_day else f"2026-01-{1 + i % 9:02d}"} for i in range(400)))
    none = no_states(spark)
    plain = [r["id"] for p in (3, 6, 8, 9) for r in views.item_page(rows, none, page=p).collect()]
    order = (F.desc_nulls_last("date"), "seq", "id")
    assert plain == [r["id"] for n in (100, 250, 350, 400) for r in
                     rows.orderBy(*order).select("id").collect()[n:n + 50]]
    monkeypatch.setattr(views, "NEAR", 10)
    monkeypatch.setattr(views, "PARTS", 7)
    far = [r["id"] for p in (3, 6, 8, 9) for r in views.item_page(rows, none, page=p).collect()]
    assert far == plain and len(far) == 150


def test_undated_rows_are_on_the_last_pages_however_far(spark, monkeypatch):
    rows = items(spark, *({"id": f"{i:04d}", "seq": i // 40, "date": None if i % 2 else "2026-01-05"} for i in range(400)))
    rows = rows.withColumn("at", (F.col("id").cast("int") % 40)).where("id < '0380'")
    none = no_states(spark)
    expected = [f"{i:04d}" for i in (*range(0, 380, 2), *range(1, 380, 2))]
    for near in (1000, 5):
        monkeypatch.setattr(views, "NEAR", near)
        got = [r["id"] for p in range(1, 9) for r in views.item_page(rows, none, page=p).collect()]
        assert got == expected
    last = views.item_page(rows, none, page=5).collect()[-1]
    after = views.items_after(rows, none, last["date"], last["seq"], last["id"], at=last["at"]).collect()
    assert [r["id"] for r in after] == expected[250:300]


def test_keyset_continues_a_page(spark):
    rows, none = many(spark, 120), no_states(spark)
    last = views.item_page(rows, none).collect()[-1]
    after = views.items_after(rows, none, last["date"], last["seq"], last["id"]).collect()
    assert [r["id"] for r in after] == [r["id"] for r in views.item_page(rows, none, page=2).collect()]


def test_sources_views(spark, monkeypatch):
    registry = sources(spark, {"id": "a"}, {"id": "b", "category": "devops-cloud", "status": "planned"})
    status = spark.createDataFrame([("a", "failing", None, None, None, "HTTP 503")],
                                   "source_id STRING, status STRING, last_success_at TIMESTAMP, "
                                   "last_attempt_at TIMESTAMP, failure_class STRING, reason STRING")
    listed = references(spark, (0, "ref", "Ref", "web-core", "https://h.org/", "why", "web-core"))
    monitored, dim = views.monitored_sources(registry, status), categories(spark)
    nested = views.sources_by_category(dim, monitored, listed).collect()
    assert [r["category"] for r in nested][:2] == ["web-core", "ai-engineering"] and len(nested) == 7
    assert nested[0]["coverage"].asDict() == {"active": 0, "failing": 1, "planned": 0, "total": 1}
    assert nested[0]["monitored"][0]["failure_reason"] == "HTTP 503"
    assert [r["id"] for r in nested[0]["reference_only"]] == ["ref"]
    assert nested[1]["monitored"] == [] and nested[1]["coverage"]["total"] == 0
    with monkeypatch.context() as m:
        m.setattr(views, "NESTED", 1)
        more = sources(spark, {"id": "a"}, {"id": "b"}, {"id": "c"})
        parts = views.sources_by_category(dim, views.monitored_sources(more, status), listed).collect()
        assert [(r["part"], [x["id"] for x in r["monitored"]]) for r in parts[:3]] == [(0, ["a"]), (1, ["b"]), (2, ["c"])]
        assert len(parts) == 9
    assert views.sources_listing(dim, monitored, listed).count() == 8
    link = views.deep_link(monitored, dim, "planned").first()
    assert (link["category"], link["source_id"]) == ("devops-cloud", "b")


def run(spark, failed=0, planned=0, reason=None, at="2026-01-31 23:00:00"):
    return spark.range(1).select(
        F.lit(1).cast("long").alias("run_id"), F.lit(at).cast("timestamp").alias("last_run_at"),
        F.struct(*[F.lit(v).cast("long").alias(k) for k, v in dict(
            succeeded=1, failed=failed, planned=planned, added=0, total=9).items()]).alias("coverage"),
        F.when(F.lit(reason is not None), F.struct(F.lit(reason).alias("reason"), F.lit("why").alias("detail"))).alias("rejected"))


@pytest.mark.parametrize("kwargs, expected", [
    (dict(), ("green", "All sources collecting successfully", None)),
    (dict(failed=1, planned=2), ("red", "1 source failing", "bad")),
    (dict(planned=2), ("orange", "2 sources planned", "later")),
    (dict(planned=1, at="2026-01-01 00:00:00"), ("orange", "1 source planned, collection is stale", "later")),
    (dict(at="2026-01-01 00:00:00"), ("orange", "collection is stale", "later")),
    (dict(failed=3, reason="volume-guard"), ("red", "Collection rejected — Change guard: why", None)),
])
def test_alert(spark, kwargs, expected):
    registry = sources(spark, {"id": "bad", "status": "failing"}, {"id": "later", "status": "planned"})
    got = views.alert(views.run_status(run(spark, **kwargs), NOW), registry, categories(spark)).first()
    assert (got["severity"], got["title"], got["source_id"]) == expected


def test_exports_are_stable(spark, tmp_path):
    rows = many(spark, 20)
    for name, df in (("one", rows), ("two", rows.orderBy(F.rand(3)))):
        summary.export_json(df.repartition(3), ["id"], str(tmp_path / name))
    texts = [sorted(f.read_text() for f in (tmp_path / n).glob("part-*")) for n in ("one", "two")]
    assert "".join(texts[0]) and sorted("".join(texts[0]).splitlines()) == sorted("".join(texts[1]).splitlines())
    first = "".join(texts[0]).splitlines()[0]
    assert first.index('"category"') < first.index('"date"') < first.index('"tags"')
    assert summary.content_digest(rows).first() == summary.content_digest(rows.repartition(5)).first()
    assert summary.content_digest(rows).first() != summary.content_digest(rows.limit(19)).first()


def test_json_files(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"id":"a","sourceId":"s","heading":"h","label":"Release","link":"https://h.org/",'
                                         '"date":"2026-01-01","dateBasis":"published","category":"web-core","tags":["t"],"extra":1}]')
    row = read_items_json(spark, str(tmp_path / "items.json")).first()
    assert row["source_id"] == "s" and str(row["date"]) == "2026-01-01"
    (tmp_path / "bad.json").write_text("[{]")
    with pytest.raises(Exception):
        read_items_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "states.json").write_text('{"schemaVersion":1,"items":{"a":{"state":"read","updatedAt":"2026-01-01T00:00:00Z","readAt":"2026-01-01T00:00:00Z"}}}')
    assert read_states_json(spark, str(tmp_path / "states.json")).first()["state"] == "read"
    (tmp_path / "v2.json").write_text('{"schemaVersion":2,"items":{}}')
    with pytest.raises(Exception):
        read_states_json(spark, str(tmp_path / "v2.json")).collect()


def test_setting_the_state_of_one_item(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.bootstrap()
    rows = items(spark, {"key": "a"}, {"key": "b"})
    a, b = sorted(r["id"] for r in rows.collect())
    store.publish({"items": store.write("items", rows, "run_id=0"),
                   "states": store.write("states", states(spark, (a, "unread", NOW), (b, "unread", NOW)), "run_id=0")})
    assert not reading.set_state(store, "nobody", "read", NOW)
    with pytest.raises(ValueError):
        reading.set_state(store, a, "starred", NOW)
    assert reading.set_state(store, a, "read", "2026-02-02 00:00:00")
    assert reading.set_state(store, a, "unread", "2026-02-03 00:00:00")
    got = {r["id"]: r for r in store.read("states").collect()}
    assert got[a]["state"] == "unread" and str(got[a]["read_at"]) == "2026-02-02 00:00:00"
    assert reading.set_state(store, b, "ignored", "2026-02-03 00:00:00")
    assert [r["id"] for r in store.items().collect()] == [a]
    assert not reading.set_state(store, b, "read", "2026-02-04 00:00:00")
    assert reading.may_publish(store.items(), store.read("states"), "2026-02-04 00:00:00")
    assert not reading.may_publish(store.items(), store.read("states"), "2026-02-05 00:00:00")


def test_a_state_change_writes_its_own_rows_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.bootstrap()
    rows = items(spark, *({"key": f"k{i}"} for i in range(2000)))
    store.publish({"items": store.write("items", rows, "run_id=0"), "states": store.write("states", rows.select(
        "id", F.lit("unread").alias("state"), F.lit(NOW).cast("timestamp").alias("updated_at")), "run_id=0")})
    picked = [r["id"] for r in rows.orderBy("id").limit(3).collect()]
    for day, (the_id, state) in enumerate(zip(picked, ("read", "ignored", "read"), strict=True)):
        assert reading.set_state(store, the_id, state, f"2026-02-0{day + 2} 00:00:00")
    assert [store.scan("states", [p]).count() for p in store.directories["states"]] == [2000, 1, 1, 1]
    before = sorted(map(tuple, store.read("states").collect()))
    assert len(before) == 2000 and sum(r[1] == "read" for r in before) == 2
    assert store.read("items").count() == 2000 and store.items().count() == 1999

    store.compact()
    assert sorted(map(tuple, store.read("states").collect())) == before and len(store.directories["states"]) == 1
    older = Store(spark, store.root).refresh(store.version - 1)
    assert sorted(map(tuple, older.read("states").collect())) == before
    gone = store.vacuum(keep=1)
    assert "states/run_id=0" in gone and f"_versions/version={store.version}" not in gone
    again = Store(spark, store.root)
    assert again.version == store.version and sorted(map(tuple, again.read("states").collect())) == before
    assert again.items().count() == 1999 and again.vacuum(keep=1) == []
    assert reading.set_state(again, picked[0], "unread", "2026-02-09 00:00:00")
