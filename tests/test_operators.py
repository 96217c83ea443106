"""Operators on small tables, including the shapes that skew or exceed a bound."""

import random

from pyspark.sql import functions as F

from feedledger.operators import checks, dedup, increment, joins, lifecycle, merge
from feedledger.operators.scope import in_source_scope
from feedledger.operators.states import apply_transitions, clean_up, fold_transitions
from feedledger.sources.registry import read_reference_sources, read_sources, registry_issues
from helpers import NOW, column_values, items, references, sources, states


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id STRING, key STRING, spec INT, skip BOOLEAN, seq INT")


def survivors(df):
    kept = dedup.most_specific(df, F.col("key"), F.col("spec"), F.col("source_id"), F.col("seq"), F.col("skip"))
    return sorted((r["key"], r["source_id"], r["seq"]) for r in kept.collect())


def test_most_specific_ties_and_bypass(spark):
    rows = [("b", "k", 1, False, 0), ("a", "k", 1, False, 1), ("a", "k", 1, False, 2), ("z", "k", 2, False, 3),
            ("b", "m", 0, False, 4), ("a", "m", 0, False, 5), ("x", "m", 9, True, 6), ("x", "m", 9, True, 7)]
    expected = [("k", "z", 3), ("m", "a", 5), ("m", "x", 6), ("m", "x", 7)]
    assert survivors(candidates(spark, *rows)) == expected
    random.Random(1).shuffle(rows)
    assert survivors(candidates(spark, *rows)) == expected


def test_merge_existing_wins_and_first_of_batch(spark):
    existing = items(spark, {"key": "a", "heading": "old"})
    batch = items(spark, {"key": "a", "heading": "new"}, {"key": "b", "heading": "one", "seq": 5},
                  {"key": "b", "heading": "two", "seq": 6})
    added = merge.new_items(batch, existing, ["seq"])
    assert [r["heading"] for r in added.collect()] == ["one"]
    assert sorted(r["heading"] for r in merge.merge_items(existing, added).collect()) == ["old", "one"]


def joined_both_ways(spark):
    """Once with broadcasts allowed, once without; yields the join that plans then show."""
    for threshold, plan in (("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            yield plan
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_history_join_is_the_same_on_both_paths(spark):
    batch = spark.range(100).select(F.col("id").cast("string").alias("id"))
    history = spark.range(0, 1000, 3).select(F.col("id").cast("string").alias("id"))
    for plan in joined_both_ways(spark):
        got = joins.not_in_history(batch, history, ["id"])
        assert plan in got._jdf.queryExecution().toString()
        assert sorted(int(r["id"]) for r in got.collect()) == [i for i in range(100) if i % 3]


def test_lookup_join_is_the_same_on_both_paths(spark):
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("s"), F.col("id") % 50)).alias("source_id"), "id")
    lookup = facts.select("source_id").distinct().where("source_id <> 's1'").withColumn("x", F.length("source_id"))
    for plan in joined_both_ways(spark):
        for how in ("inner", "left", "left_anti", "left_semi"):
            got = joins.lookup_join(facts, lookup, ["source_id"], how, ["id"])
            assert plan in got._jdf.queryExecution().toString()
            want = facts.join(lookup, ["source_id"], how)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_window_and_baseline(spark):
    rows = items(spark, {"key": "in", "date": "2026-01-30"}, {"key": "out", "date": "2026-01-29"},
                 {"key": "u", "date": "2026-02-01", "date_basis": "discovered"},
                 {"key": "u", "date": "2026-02-01", "date_basis": "discovered"}).withColumn("pos", F.lit(0))
    for last, imported_n, recorded_n in (("2026-01-31 12:00:00", 2, 1), (None, 2, 1)):
        bounds = spark.createDataFrame([("s", "2026-01-01", last)], "source_id STRING, f STRING, l STRING").select(
            "source_id", F.to_date("f").alias("initial_sync_from"), F.to_timestamp("l").alias("last_run_at"))
        windowed = increment.within_window(rows, bounds, NOW)
        known = spark.createDataFrame([], "source_id STRING, id STRING")
        imported, recorded = increment.split_undated(windowed, known)
        assert imported.count() == imported_n and recorded.count() == recorded_n
        again, none = increment.split_undated(windowed, recorded)
        assert none.isEmpty() and again.where("date_basis = 'discovered'").isEmpty()


def test_cursor_keeps_the_later_date_and_unseen_sources(spark):
    before = spark.createDataFrame(
        [("a", "2026-01-01", "2026-01-20", "x"), ("gone", "2026-01-01", None, None)],
        "source_id STRING, l STRING, d STRING, last_item_id STRING").select(
        "source_id", F.to_timestamp("l").alias("last_run_at"), F.to_date("d").alias("last_item_date"), "last_item_id")
    imported = items(spark, {"key": "1", "source_id": "a", "date": "2026-01-10"}, {"key": "2", "source_id": "b", "date": "2026-01-11"})
    done = spark.createDataFrame([("a",), ("b",)], "source_id STRING")
    got = {r["source_id"]: r for r in increment.advance_cursors(before, imported, done, NOW).collect()}
    assert str(got["a"]["last_item_date"]) == "2026-01-20" and got["a"]["last_item_id"] == "x"
    assert str(got["a"]["last_run_at"]) == NOW and str(got["b"]["last_item_date"]) == "2026-01-11"
    assert str(got["gone"]["last_run_at"]) == "2026-01-01 00:00:00"


def transitions(spark, *rows):
    return spark.createDataFrame(list(rows), "id STRING, state STRING, t STRING, seq BIGINT").select(
        "id", "state", F.to_timestamp("t").alias("ts"), "seq")


def brute_fold(rows):
    out = {}
    for id_, state, t, seq in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        now = out.setdefault(id_, {"state": None, "read": None, "ignored": None, "at": None})
        if now["state"] == "ignored":
            continue
        now.update(state=state, at=t)
        if state in ("read", "ignored"):
            now[state] = t
    return {k: (v["state"], v["at"], v["read"], v["ignored"]) for k, v in out.items()}


def test_transition_fold_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for seq in range(600):
        hot = rng.random() < 0.35
        rows.append(("hot" if hot else f"u{rng.randrange(25)}",
                     rng.choices(["read", "unread", "ignored"], [5, 5, 0 if hot and seq < 400 else 1])[0],
                     f"2026-01-{rng.randrange(1, 29):02d} 00:00:00", seq))
    for _ in joined_both_ways(spark):
        folded = fold_transitions(transitions(spark, *rows), salts=3)
        got = {r["id"]: tuple(None if x is None else str(x) for x in (r["state"], r["updated_at"], r["read_at"], r["ignored_at"]))
               for r in folded.collect()}
        assert got == brute_fold(rows)


def test_transitions_touch_only_active_items(spark):
    active = items(spark, {"id": "a"}, {"id": "b"})
    before = states(spark, ("a", "unread", NOW, "2025-12-01 00:00:00"), ("gone", "ignored", NOW, None, NOW))
    kept, after = apply_transitions(active, before, transitions(
        spark, ("a", "ignored", "2026-02-02 00:00:00", 1), ("gone", "read", "2026-02-02 00:00:00", 2)))
    assert [r["id"] for r in kept.collect()] == ["b"]
    got = {r["id"]: r for r in after.collect()}
    assert got["a"]["state"] == "ignored" and str(got["a"]["read_at"]) == "2025-12-01 00:00:00"
    assert got["gone"]["state"] == "ignored" and got["gone"]["read_at"] is None


def test_cleanup_order_and_orphans(spark):
    rows = items(spark, *({"id": i} for i in ("live", "dead", "old", "fresh", "unread")))
    now = "2026-03-15 00:00:00"
    before = states(
        spark, ("live", "ignored", now, None, "2026-03-14 00:00:00"), ("dead", "ignored", now, None, "2026-03-12 23:00:00"),
        ("old", "read", now, "2026-01-01 00:00:00"), ("fresh", "read", now, "2026-03-01 00:00:00"),
        ("unread", "unread", "2000-01-01 00:00:00"), ("orphan", "read", now, "2026-01-01 00:00:00"))
    out = clean_up(rows, before, now)
    assert sorted(r["id"] for r in out.items.collect()) == ["dead", "fresh", "unread"]
    assert sorted(r["id"] for r in out.states.collect()) == ["fresh", "live", "unread"]
    assert tuple(out.counts().first()) == (1, 1, 2)
    assert sorted(r["id"] for r in out.removed_ids().collect()) == ["live", "old", "orphan"]


def test_issues(spark):
    rows = items(spark, {"key": "a"}, {"key": "a"}, {"key": "a"}, {"id": "short"})
    found = checks.data_issues(rows, states(spark, ("x", "unread", NOW), ("t", "ignored", NOW, None, NOW)), NOW)
    got = sorted((r["check"], r["message"].split('"')[1]) for r in found.collect() for _ in range(r["times"]))
    key = rows.first()["id"]
    assert got == sorted([("news-id-format", "short"), ("news-duplicate-id", key), ("news-duplicate-id", key),
                          ("state-missing-for-item", "short"), *[("state-missing-for-item", key)] * 3,
                          ("state-orphaned-entry", "x")])


def test_append_only_counts_the_order_of_tags(spark):
    before = items(spark, {"id": "a", "tags": ["x", "y"]}, {"id": "b"}, {"id": "c"})
    after = items(spark, {"id": "a", "tags": ["y", "x"]}, {"id": "b"})
    legit = spark.createDataFrame([("c",)], "id STRING")
    changes = checks.append_only_diff(before, after, legit)
    assert [tuple(r) for r in changes.collect()] == [("a", "modified")]
    assert "was modified" in checks.append_only_guard(changes).first()["detail"]
    none = spark.createDataFrame([], "id STRING")
    assert checks.append_only_diff(before, after, none).count() == 2


def test_guards_in_order_of_precedence(spark):
    rows = items(spark, *({"key": str(i)} for i in range(3)))
    issues = spark.createDataFrame([("c", "m2", 1), ("c", "m1", 1)], "check STRING, message STRING, times BIGINT")
    both = checks.validation_guard(issues).unionByName(checks.volume_guard(rows, 2))
    assert checks.first_rejection(both).first()["reason"] == "volume-guard"
    assert checks.volume_guard(rows, 3).isEmpty()
    assert checks.validation_guard(issues).first()["detail"] == "[c] m1\n[c] m2"
    assert "(2 issues in all)" in checks.validation_guard(issues, shown=1).first()["detail"]
    many = issues.withColumn("times", F.lit(2_000_000_000_000))
    detail = checks.validation_guard(many, shown=3).first()["detail"]
    assert detail == "[c] m1\n[c] m1\n[c] m1\n(4000000000000 issues in all)"
    assert checks.first_rejection(checks.validation_guard(issues.limit(0))).isEmpty()


def test_scope(spark):
    def match(heading, link, **scope):
        import json
        text = json.dumps({"virtualScope": scope}) if scope else "{}"
        return column_values(spark, [heading], lambda c: in_source_scope(c, F.lit(link), F.lit(text)))[0]

    link = "https://h.org/tag/workers/x"
    assert match("Anything", link)
    assert match("New COPILOT chat", link, titleContains="copilot")
    assert not match("Actions", link, titleContains="copilot")
    assert not match("Deprecated notice", link, titleExcludes="deprecated")
    assert match("x", link, linkPathPrefix="/tag/workers/") and not match("x", link, linkPathPrefix="/Tag/")
    assert not match("Pages", link, titleContains="workers", linkPathPrefix="/tag/workers/")
    assert match("x", link, titleContains="")


def test_stage_events(spark):
    snapshot = spark.createDataFrame([("s", "a", "4"), ("s", "b", "withdrawn"), ("s", "c", "2"), ("s", "d", "withdrawn")],
                                     "source_id STRING, slug STRING, stage STRING")
    known = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "2")],
                                  "source_id STRING, slug STRING, stage STRING")
    assert sorted((r["slug"], r["event"]) for r in lifecycle.stage_events(snapshot, known).collect()) == [
        ("a", "transition:4"), ("b", "withdrawn"), ("d", "new:withdrawn")]


def test_registry_issues(spark):
    rows = sources(spark, {"id": "ok"}, {"id": "twice"}, {"id": "lost", "declared_in": "devops-cloud"},
                   {"id": "odd", "kind": "pigeon"}, {"id": "bad", "url": "nowhere"})
    listed = references(spark, (9, "twice", "n", "web-core", "https://h.org/", None, "web-core"))
    got = sorted(r["check"] for r in registry_issues(rows, listed).collect())
    assert got == ["source-category", "source-duplicate-id", "source-shape", "source-shape"]


def test_registry_files(spark, tmp_path):
    rows = sources(spark, {"id": "a", "tags": ["t"], "filters": '{"label":"Release"}'})
    rows.write.json(str(tmp_path / "sources"))
    read = read_sources(spark, str(tmp_path / "sources"))
    assert read.select(rows.columns).collect() == rows.collect()
    assert registry_issues(read, references(spark)).isEmpty()
    references(spark, (0, "r", "R", "web-core", "https://h.org/", None, "web-core")).write.json(str(tmp_path / "refs"))
    assert read_reference_sources(spark, str(tmp_path / "refs")).first()["id"] == "r"
