"""The gated run end to end."""

import pytest
from pyspark.sql import functions as F

from feedledger import schemas as S
from feedledger.plans.collect import collect_run
from feedledger.plans.store import Store
from feedledger.sources.adapters import AdapterRegistry
from helpers import NOW, items, payloads, references, rss, sources, states

DAY = "Sat, 31 Jan 2026 10:00:00 GMT"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def run(store, spark, landed, registry_rows, **options):
    options.setdefault("now", NOW)
    return collect_run(store, landed, registry_rows, references(spark), **options)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def seed(store, **tables):
    """Publish given tables as if earlier runs had written them."""
    store.bootstrap()
    changed = {}
    for name, rows in tables.items():
        changed[name] = store.write(name, rows, "run_id=0")
    store.publish(changed)


def test_item_reaches_the_table_and_a_rerun_changes_nothing(store, spark):
    landed = payloads(spark, ("s", rss(("One", "/posts/1", DAY), ("Two", "/posts/2", DAY))))
    rows = sources(spark, {"id": "s"})
    first = run(store, spark, landed, rows)
    assert first.summary == "Collection run: 1 succeeded, 0 failed, 0 planned, 2 added"
    assert first.accepted
    before = store.directories["items"]
    table = store.items().orderBy("seq", "at").collect()
    assert [r["link"] for r in table] == ["https://example.com/posts/1", "https://example.com/posts/2"]
    assert [r["state"] for r in store.read("states").collect()] == ["unread", "unread"]

    second = run(store, spark, landed, rows)
    assert "0 added" in second.summary and second.accepted
    assert store.directories["items"] == before


def test_unknown_adapter_stops_before_any_write(store, spark, tmp_path):
    result = run(store, spark, payloads(spark, ("s", "x")), sources(spark, {"id": "s", "adapter": "nope"}))
    assert result.aborted and not result.accepted
    assert not (tmp_path / "store").exists()


def test_failures_stay_with_their_source(store, spark):
    landed = payloads(spark, ("good", rss(("One", "/1", DAY))), ("bad", "", 503), ("worse", "<rss><channel>"),
                      ("same", "", 304))
    result = run(store, spark, landed, sources(
        spark, {"id": "good"}, {"id": "bad"}, {"id": "worse"}, {"id": "later", "status": "planned"},
        {"id": "silent"}, {"id": "same"}))
    assert result.summary.splitlines() == [
        "Collection run: 2 succeeded, 3 failed, 1 planned, 1 added",
        "  FAILED  bad: HTTP 503 for https://example.com/bad/feed",
        '  FAILED  worse: Malformed feed content for "https://example.com/worse/feed"',
        "  FAILED  silent: No payload landed"]
    status = {r["source_id"]: r for r in store.read("source_status").collect()}
    assert status["good"]["status"] == "active" and status["good"]["last_success_at"] is not None
    assert status["bad"]["status"] == "failing"
    assert status["bad"]["failure_class"] == "runtime-failing"
    assert status["later"]["status"] == "planned" and status["later"]["last_attempt_at"] is None
    assert status["same"]["status"] == "active"


def test_volume_guard_rejects_above_and_not_at_the_limit(store, spark):
    landed = payloads(spark, ("s", rss(*[(f"T{i}", f"/{i}", DAY) for i in range(3)])))
    rows = sources(spark, {"id": "s"})
    result = run(store, spark, landed, rows, volume_limit=2)
    assert not result.accepted
    assert result.rejection == {"reason": "volume-guard",
                                "detail": "3 items added, exceeds threshold of 2"}
    assert "REJECTED: volume-guard" in result.summary
    assert ids(store.items()) == [] and store.read("cursors").isEmpty()
    newest = store.read("runs").orderBy(F.desc("run_id")).first()
    assert newest["rejected"]["reason"] == "volume-guard"
    assert run(store, spark, landed, rows, volume_limit=2, allow_large_change=True).accepted
    assert len(ids(store.items())) == 3


def test_exactly_at_the_limit_is_accepted(store, spark):
    landed = payloads(spark, ("s", rss(("A", "/a", DAY), ("B", "/b", DAY))))
    assert run(store, spark, landed, sources(spark, {"id": "s"}), volume_limit=2).accepted


def test_cursor_regression_is_not_waived(store, spark):
    cursors = spark.createDataFrame([("s", "2027-01-01 00:00:00")], "source_id STRING, t STRING").select(
        "source_id", F.to_timestamp("t").alias("last_run_at"),
        F.lit(None).cast("date").alias("last_item_date"), F.lit(None).cast("string").alias("last_item_id"))
    seed(store, cursors=cursors)
    result = run(store, spark, payloads(spark, ("s", rss(("A", "/a", DAY)))), sources(spark, {"id": "s"}),
                 allow_large_change=True)
    assert result.rejection["reason"] == "cursor-regression"
    assert "2027-01-01T00:00:00.000Z" in result.rejection["detail"]


def test_corrupt_earlier_data_is_reported_with_the_id(store, spark):
    twice = items(spark, {"key": "a"}, {"key": "a"})
    the_id = twice.first()["id"]
    seed(store, items=twice, states=states(spark, (the_id, "unread", NOW)))
    result = run(store, spark, payloads(spark, ("s", rss(("A", "/a", DAY)))), sources(spark, {"id": "s"}))
    assert result.rejection["reason"] == "validation-failed"
    assert "news-duplicate-id" in result.rejection["detail"] and the_id in result.rejection["detail"]
    assert len(ids(store.items())) == 2


def test_live_tombstone_scrubs_and_a_dead_one_lets_the_item_back(store, spark):
    link = "https://example.com/a"
    ignored = items(spark, {"key": link}).first()["id"]
    seed(store, states=states(spark, (ignored, "ignored", NOW, None, NOW)))
    landed = payloads(spark, ("s", rss(("A", "/a", DAY))))
    rows = sources(spark, {"id": "s"})
    result = run(store, spark, landed, rows)
    assert result.accepted
    assert "1 re-added ignored item(s) scrubbed" in result.summary
    assert ids(store.items()) == []

    again = payloads(spark, ("s", rss(("A", "/a", "2 Feb 2026 10:00:00 GMT"))))
    later = run(store, spark, again, rows, now="2026-02-03 00:00:00")
    assert later.accepted and "1 tombstone(s) pruned" in later.summary
    assert ids(store.items()) == [ignored]
    assert store.read("states").first()["state"] == "unread"


def test_read_items_expire_and_may_come_back_in_a_later_segment(store, spark):
    old = items(spark, {"key": "https://example.com/a", "date": "2025-11-01"})
    the_id = old.first()["id"]
    seed(store, items=old, states=states(spark, (the_id, "read", NOW, "2025-12-01 00:00:00")))
    landed = payloads(spark, ("s", rss(("A", "/b", DAY))))
    rows = sources(spark, {"id": "s"})
    result = run(store, spark, landed, rows)
    assert "1 read item(s) expired" in result.summary
    assert the_id not in ids(store.items())
    again = payloads(spark, ("s", rss(("A", "/a", DAY))))
    assert run(store, spark, again, rows).accepted
    assert the_id in ids(store.items())
    before = ids(store.items())
    store.compact()
    assert ids(store.items()) == before and store.read("removed").isEmpty()


def test_undated_backlog_is_withheld_and_new_undated_imported_once(store, spark):
    rows = sources(spark, {"id": "s"})
    first = payloads(spark, ("s", rss(("Old", "/old", None))))
    assert "0 added" in run(store, spark, first, rows).summary
    both = payloads(spark, ("s", rss(("Old", "/old", None), ("New", "/new", None))))
    assert "1 added" in run(store, spark, both, rows, now="2026-02-02 00:00:00").summary
    assert "0 added" in run(store, spark, both, rows, now="2026-02-03 00:00:00").summary
    assert store.items().first()["date_basis"] == "discovered"
    assert store.read("known_undated").count() == 2


def test_a_gap_of_ten_days_is_recovered(store, spark):
    rows = sources(spark, {"id": "s", "initial_sync_from": "2026-01-20"})
    run(store, spark, payloads(spark, ("s", rss(("A", "/a", "21 Jan 2026 00:00:00 GMT")))), rows,
        now="2026-01-22 00:00:00")
    gap = payloads(spark, ("s", rss(("B", "/b", "25 Jan 2026 00:00:00 GMT"), ("C", "/c", "20 Jan 2026 00:00:00 GMT"))))
    assert "1 added" in run(store, spark, gap, rows, now="2026-02-01 00:00:00").summary
    cursor = store.read("cursors").first()
    assert str(cursor["last_item_date"]) == "2026-01-25"


def test_most_specific_source_wins_unless_first_seen_is_asked_for(spark, tmp_path):
    body = rss(("Copilot news", "/a", DAY))
    landed = payloads(spark, ("wide", body, 200, "https://example.com/x"),
                      ("narrow", body, 200, "https://example.com/x"))
    rows = sources(spark, {"id": "wide"},
                   {"id": "narrow", "filters": '{"virtualScope":{"titleContains":"copilot"}}'})
    for policy, winner in (("most_specific", "narrow"), ("first_seen", "wide")):
        store = Store(spark, str(tmp_path / policy))
        run(store, spark, landed, rows, dedup_policy=policy)
        assert [r["source_id"] for r in store.items().collect()] == [winner]


def test_lifecycle_documents_over_two_runs(store, spark):
    def doc(**sections):
        return "# Intro\n\n[skip](https://github.com/tc39/skip)\n" + "".join(
            f"\n## {title.replace('_', ' ')}\n\n" + "\n".join(
                f"| [{n}](https://github.com/tc39/{n.lower()}) | x |" for n in names)
            for title, names in sections.items())

    rows = sources(spark, {"id": "p", "adapter": "tc39-proposal-lifecycle", "kind": "github-event"})
    one = payloads(spark, ("p", doc(Stage_3=["Alpha"], Stage_2=["Doomed"], Stage_1=["Jump", "Same"])))
    assert "0 added" in run(store, spark, one, rows).summary  # a first sync only records
    assert store.read("lifecycle_stage").count() == 4
    two = payloads(spark, ("p", doc(Stage_4=["Alpha"], Stage_3=["Jump"], Stage_1=["Same", "Fresh"],
                                    Withdrawn_Proposals=["Doomed"])))
    result = run(store, spark, two, rows, now="2026-02-02 00:00:00")
    assert "4 added" in result.summary
    got = {r["heading"]: r["label"] for r in store.items().collect()}
    assert got == {"Alpha — Stage 4": "Improvement", "Jump — Stage 3": "Improvement",
                   "Fresh — Stage 1": "RFC/Proposal", "Doomed — withdrawn": "Retired"}
    assert "0 added" in run(store, spark, two, rows, now="2026-02-03 00:00:00").summary


def test_pull_requests_count_only_with_an_added_file(store, spark):
    pulls = ('[{"number":10,"title":"Notes","html_url":"https://h.org/o/r/pull/10","created_at":"2026-01-31T23:30:00-05:00"},'
             '{"number":13,"title":"Idea","html_url":"https://h.org/o/r/pull/13","created_at":"2026-01-31T23:30:00-05:00"}]')
    base = "https://api.h.org/repos/o/r/pulls"
    landed = payloads(
        spark, ("p", pulls, 200, base),
        ("p", '[{"filename":"proposals/old.md","status":"modified"}]', 200, f"{base}/10/files"),
        ("p", '[{"filename":"proposals/new.md","status":"added"}]', 200, f"{base}/13/files"))
    rows = sources(spark, {"id": "p", "adapter": "react-native-proposals", "kind": "github-event"})
    assert "1 added" in run(store, spark, landed, rows).summary
    item = store.items().first()
    assert (item["heading"], str(item["date"]), item["label"]) == ("Idea", "2026-01-31", "RFC/Proposal")


def test_duplicate_adapter_names_are_refused():
    from feedledger.sources.adapters import BUILT_IN
    with pytest.raises(ValueError, match="Duplicate adapter"):
        AdapterRegistry([BUILT_IN[0], BUILT_IN[0]])


def test_bootstrap_marks_never_run(store, spark):
    store.bootstrap()
    row = store.read("runs").first()
    assert str(row["last_run_at"]) == S.NEVER_RUN and row["coverage"]["total"] == 0


def test_a_state_off_its_schema_rejects_the_run(store, spark):
    known = items(spark, {"key": "https://example.com/a"})
    the_id = known.first()["id"]
    seed(store, items=known, states=states(spark, (the_id, "starred", NOW)))
    result = run(store, spark, payloads(spark, ("s", rss(("B", "/b", DAY)))), sources(spark, {"id": "s"}))
    assert result.rejection["reason"] == "validation-failed"
    assert '[state-shape] 1 state row(s) have an invalid "state"' in result.rejection["detail"]


def test_an_earlier_row_that_was_edited_or_lost_rejects_the_run(store, spark):
    rows = sources(spark, {"id": "s"})
    assert run(store, spark, payloads(spark, ("s", rss(("A", "/a", DAY), ("B", "/b", DAY)))), rows).accepted
    [segment] = store.directories["items"]
    before = spark.createDataFrame(store.read("items").collect(), store.read("items").schema)
    a = before.where("heading = 'A'").first()["id"]
    later = payloads(spark, ("s", rss(("C", "/c", DAY))))
    for change, rest in (("modified", before.withColumn("heading", F.regexp_replace("heading", "A", "Edited"))),
                         ("deleted", before.where("heading = 'B'"))):
        store.write("items", rest, segment.split("/", 1)[1])
        result = run(store, spark, later, rows)
        assert result.rejection["reason"] == "active-item-mutation"
        assert f'"{a}" was {change}' in result.rejection["detail"]
    store.write("items", before, segment.split("/", 1)[1])
    assert run(store, spark, later, rows).accepted
    store.compact()
    assert run(store, spark, later, rows).accepted


def test_all_issues_and_failures_are_tables_of_the_run(store, spark):
    odd = items(spark, *({"id": f"odd{i}", "seq": i} for i in range(150)))
    seed(store, items=odd, states=odd.select("id", F.lit("unread").alias("state"), F.lit(NOW).cast("timestamp").alias("updated_at")))
    rows = sources(spark, *({"id": f"s{i}"} for i in range(1001)))
    result = run(store, spark, payloads(spark, ("s0", rss(("A", "/a", DAY)))), rows)
    assert result.rejection["reason"] == "validation-failed" and "(150 issues in all)" in result.rejection["detail"]
    assert store.read("issues").agg(F.sum("times")).first()[0] == 150
    assert store.read("failures").count() == 1000 and "1000 failed" in result.summary
    assert store.read("source_status").where("status = 'failing'").count() == 1000


def test_positions_beyond_any_bound_keep_their_order(spark):
    from feedledger.operators.classify import explode_entries
    parsed = spark.range(2).select(
        (F.lit(2**62) + F.col("id")).alias("seq"), F.lit(None).cast("string").alias("error"),
        F.transform(F.sequence(F.lit(0), F.lit(1_048_581)), lambda i: F.struct(i.alias("n"))).alias("entries"))
    got = explode_entries(parsed).agg(F.count("*"), F.count_distinct("seq", "at")).first()
    assert tuple(got) == (2 * 1_048_582,) * 2


def test_a_run_that_dies_before_publishing_leaves_nothing_behind(store, spark, monkeypatch):
    landed = payloads(spark, ("s", rss(("A", "/a", DAY))))
    rows = sources(spark, {"id": "s"})
    store.bootstrap()
    before = (store.version, store.directories)

    def fail(self, changed):
        raise RuntimeError("executor gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "publish", fail)
        with pytest.raises(RuntimeError):
            run(store, spark, landed, rows)
    again = Store(spark, store.root)
    assert (again.version, again.directories) == before and ids(again.items()) == []
    assert run(again, spark, landed, rows).accepted
    assert len(ids(again.items())) == 1
    # Every item has a state, and what was added is all there is.
    assert ids(again.items()) == ids(again.read("states"))
