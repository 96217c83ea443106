"""Keyed state of a stream gives what the batch rules give, however the backlog is cut."""

import random

import pytest
from pyspark.sql import functions as F

from feedledger import schemas as S
from feedledger.operators.increment import decide_undated
from feedledger.operators.lifecycle import observed_stages, stage_events, upsert_stages
from feedledger.sources.entries import ENTRIES
from feedledger.streaming import keyed_state as keyed
from feedledger.streaming.micro_batches import file_stream


@pytest.fixture(scope="module")
def session(spark):
    return keyed.keyed_session(spark, 2)


def land(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def cut(rows, n, by="seq"):
    """``n`` parts of rows in the order of ``by``."""
    values = sorted(r[0] for r in rows.select(by).distinct().collect())
    for i in range(n):
        part = values[i * len(values) // n:(i + 1) * len(values) // n]
        yield rows.where(F.col(by).isin(part))


def read(spark, path):
    return spark.read.parquet(path)


# Undated items ---------------------------------------------------------------------------

UNDATED = ("source_id STRING, id STRING, date_basis STRING, is_initial BOOLEAN, pos INT, seq BIGINT, at INT, "
           "heading STRING, tags ARRAY<STRING>, date DATE")


def undated_rows(spark):
    rng, rows = random.Random(2), []
    for seq in range(10):
        for at in range(12):
            source = rng.choice(["hot", "hot", "hot", "first", "x"])
            rows.append((source, f"i{rng.randrange(30)}", rng.choice(["published", "discovered", "discovered"]),
                         source == "first", 1, seq, at, f"{source} {seq} {at}", ["t", None], None))
    rows += [("hot", None, "discovered", False, 1, 3, 90, "no id", [], None), ("x", "i1", "discovered", False, None, 9, None, None, None, None)]
    return spark.createDataFrame(rows, UNDATED)


@pytest.mark.parametrize("cuts", [1, 2, 10])
def test_undated_decisions_are_those_of_the_batch_rule(spark, session, tmp_path, cuts):
    rows = undated_rows(session)
    known = session.createDataFrame([("hot", "i3"), ("x", "i4"), ("hot", "i5")], S.KNOWN_UNDATED)
    want = decide_undated(rows.where("id IS NOT NULL"), known)
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for i, part in enumerate(cut(rows, cuts)):
        land(part, folder)
        stream = file_stream(session, folder, rows.schema, files_per_batch=1)
        if i == 0:  # stopped here and begun again from the checkpoint
            keyed.drain(keyed.undated_decisions(stream, known, buckets=3), out, log)
    keyed.drain(keyed.undated_decisions(stream, known, buckets=3), out, log)
    columns = ["source_id", "id", "seq", "at", "heading", "tags", "imported", "recorded"]

    def plain(frame):
        return sorted(map(str, frame.select(*columns).collect()))

    assert plain(read(spark, out)) == plain(want)
    ids = {(r["source_id"], r["id"]) for r in keyed.known_ids(spark, log).collect()}
    assert ids == {(r["source_id"], r["id"]) for r in want.where("recorded").collect()} | {
        (r["source_id"], r["id"]) for r in known.collect()}


# Lifecycle stages ------------------------------------------------------------------------

def snapshot(source, seq, *listed):
    return source, seq, [(f"name of {slug}", f"u/{slug}", None, [], slug, stage) for slug, stage in listed]


def snapshots(spark):
    rows = [snapshot("p", 0, ("a", "1"), ("b", "2"), ("c", "withdrawn")), snapshot("q", 1, ("a", "0")),
            snapshot("p", 2, ("a", "3"), ("c", "withdrawn"), ("d", "1"), ("d", "2")),
            snapshot("p", 3, ("a", "withdrawn"), ("b", "2"), ("d", "2")), ("q", 4, None),
            snapshot("q", 5, ("a", "0"), (None, "1"), ("n", None)), snapshot("p", 6, ("b", "2"), ("d", "4"), ("a", "withdrawn"))]
    return spark.createDataFrame(rows, f"source_id STRING, seq BIGINT, entries {ENTRIES}")


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_lifecycle_changes_are_those_of_a_batch_run_per_snapshot(spark, session, tmp_path, cuts):
    rows = snapshots(session)
    known = session.createDataFrame([("p", "a", "0"), ("p", "gone", "1"), ("z", "k", "2")], S.LIFECYCLE_STAGE)
    want, stages = [], known
    for seq in range(7):
        entries = rows.where(f"seq = {seq} AND entries IS NOT NULL").select(
            "source_id", "seq", F.posexplode("entries").alias("at", "e")).select(
            "source_id", "seq", "at", F.col("e.slug").alias("slug"), F.col("e.stage").alias("stage")).where(
            "slug IS NOT NULL AND stage IS NOT NULL")
        want += [(r["source_id"], seq, r["slug"], r["event"]) for r in stage_events(entries, stages).collect()]
        stages = session.createDataFrame(upsert_stages(stages, observed_stages(entries)).collect(), S.LIFECYCLE_STAGE)
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in cut(rows, cuts):
        land(part, folder)
    stream = file_stream(session, folder, rows.schema, files_per_batch=1)
    keyed.drain(keyed.lifecycle_changes(stream, known, buckets=3), out, log)
    assert sorted((r["source_id"], r["seq"], r["slug"], r["event"]) for r in read(spark, out).collect()) == sorted(want)
    held = {tuple(r) for r in keyed.lifecycle_stages(spark, log).collect()}
    assert held == {tuple(r) for r in stages.collect()}
    # An older snapshot that lands late changes nothing.
    land(session.createDataFrame([snapshot("p", 5, ("late", "1"))], rows.schema), folder)
    keyed.drain(keyed.lifecycle_changes(stream, known, buckets=3), out, log)
    assert read(spark, out).where("slug = 'late'").count() == 0


# Tombstones ------------------------------------------------------------------------------

EVENT = "id STRING, kind STRING, ts TIMESTAMP, seq BIGINT"


def moments(session, rows):
    frame = session.createDataFrame(rows, "id STRING, kind STRING, t STRING, seq BIGINT")
    return frame.select("id", "kind", F.to_timestamp("t").alias("ts"), "seq")


def outcomes(spark, out):
    rows = read(spark, out).withColumn("t", F.date_format("ts", "dd HH:mm:ss.SSSSSS")).collect()
    return sorted((r["id"], r["t"].replace(".000000", ""), r["seq"] or 0, r["outcome"]) for r in rows)


def test_a_tombstone_ends_at_exactly_its_hour(spark, session, tmp_path):
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = [("a", "published", "2026-01-01 00:00:00", 1), ("a", "ignored", "2026-01-01 01:00:00", 2),
            ("a", "ignored", "2026-01-01 02:00:00", 3), ("a", "published", "2026-01-03 00:59:59.999999", 4),
            ("a", "published", "2026-01-03 01:00:00", 5), ("b", "ignored", "2026-01-01 00:00:00", 6),
            (None, "published", "2026-01-01 00:00:00", 7), ("b", "else", "2026-01-01 00:00:00", 8)]
    known = moments(session, [("old", "", "2026-01-01 00:00:00.0005", 0)]).select("id", F.col("ts").alias("ignored_at"))
    land(moments(session, rows), folder)
    stream = file_stream(session, folder, EVENT, files_per_batch=1)
    land(moments(session, [("z", "published", "2026-01-04 12:59:59.999", 9)]), folder)
    keyed.drain(keyed.tombstone_outcomes(stream, known), out, log)
    # The watermark is a millisecond short of the end of a's tombstone; old's has ended.
    first = [("a", "01 00:00:00", 1, "added"), ("a", "01 01:00:00", 2, "ignored"), ("a", "01 02:00:00", 3, "not-found"),
             ("b", "01 00:00:00", 6, "not-found"), ("old", "03 00:00:00.000500", 0, "pruned")]
    assert outcomes(spark, out) == sorted(first)
    land(moments(session, [("z", "published", "2026-01-04 13:00:00", 10), ("a", "published", "2026-01-01 00:30:00", 11)]), folder)
    keyed.drain(keyed.tombstone_outcomes(stream, known), out, log)
    # a's last event came too late to count.
    assert outcomes(spark, out) == sorted([
        *first, ("a", "03 00:59:59.999999", 4, "scrubbed"), ("a", "03 01:00:00", 0, "pruned"), ("a", "03 01:00:00", 5, "added")])
    assert [tuple(r) for r in keyed.tombstones(spark, log).collect()] == [("a", None)]


@pytest.mark.parametrize("cuts", [1, 2, 10])
def test_the_cut_of_events_decides_nothing(spark, session, tmp_path, cuts):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice(["published", "ignored", "published"]),
             f"2026-01-{1 + h // 24:02d} {h % 24:02d}:{rng.randrange(60):02d}:00", h) for h in range(0, 240, 3)]
    frame = moments(session, rows).withColumn("landing", F.col("seq") + F.when(F.col("seq") % 2 == 0, 30).otherwise(0))
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in cut(frame, cuts, "landing"):
        land(part.drop("landing"), folder)
    keyed.drain(keyed.tombstone_outcomes(file_stream(session, folder, EVENT, files_per_batch=1)), out, log)
    assert outcomes(spark, out) == brute_outcomes(rows)


def brute_outcomes(rows, delay=36, life=48):
    def hours(text):
        day, clock = text[8:].split(" ")
        return int(day) * 24 + int(clock[:2]) + int(clock[3:5]) / 60

    def text(at):
        minutes = round(at * 60)
        return f"{minutes // 1440:02d} {minutes % 1440 // 60:02d}:{minutes % 60:02d}:00"

    end, out, ignored = max(hours(t) for _, _, t, _ in rows) - delay, [], {}
    for id_, kind, t, seq in [*sorted(rows, key=lambda r: (hours(r[2]), r[3])), *[(i, "end", None, 0) for i in "abc"]]:
        at = end if kind == "end" else hours(t)
        if at > end:
            continue
        if ignored.get(id_) is not None and ignored[id_] + life <= at:
            out.append((id_, text(ignored.pop(id_) + life), 0, "pruned"))
        if kind == "ignored":
            live = id_ in ignored and ignored[id_] is None
            out.append((id_, text(at), seq, "ignored" if live else "not-found"))
            if live:
                ignored[id_] = at
        elif kind == "published":
            out.append((id_, text(at), seq, "added" if id_ not in ignored else "repeated" if ignored[id_] is None else "scrubbed"))
            ignored.setdefault(id_, None)
    return sorted(out)


# Calls --------------------------------------------------------------------------------------

def test_state_calls_do_not_grow_with_the_ids_or_slugs_of_a_batch(spark, session, tmp_path):
    """One row of state per source group or part, however many ids and slugs it holds."""
    folder, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = session.createDataFrame([snapshot("p", 0, *[(f"s{i}", "1") for i in range(400)])],
                                   f"source_id STRING, seq BIGINT, entries {ENTRIES}")
    land(rows, folder)
    keyed.drain(keyed.lifecycle_changes(file_stream(session, folder, rows.schema), None, buckets=2), out, log)
    assert keyed.state_table(spark, log, "held").count() == 2
    assert keyed.lifecycle_stages(spark, log).count() == read(spark, out).count() == 400
    folder, out, log = (str(tmp_path / f"ids-{n}") for n in ("in", "out", "log"))
    rows = undated_rows(session).limit(0).unionByName(session.range(2000).select(
        F.lit("p").alias("source_id"), F.col("id").cast("string").alias("id"), F.lit("discovered").alias("date_basis"),
        F.lit(False).alias("is_initial")), allowMissingColumns=True)
    land(rows, folder)
    known = session.createDataFrame([("p", "1"), ("p", "1"), ("p", None)], S.KNOWN_UNDATED)
    keyed.drain(keyed.undated_decisions(file_stream(session, folder, rows.schema), known, buckets=1), out, log)
    assert keyed.state_table(spark, log, "known").count() <= keyed.PARTS
    assert keyed.known_ids(spark, log).count() == 2001 and read(spark, out).count() == 1999
