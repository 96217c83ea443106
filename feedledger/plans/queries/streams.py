"""Operators in streaming form, run over what is available and then stopped."""

import uuid

from pyspark.sql import Window, functions as F

from . import query, table, wall
from .inputs import as_transitions, order_items, order_known, user_day
from .reading import _FOLD
from .runs import order_sources, payload_columns
from ...schemas import REFERENCE_SOURCE, TOMBSTONE_HOURS, WINDOW_HOURS
from ...session import work_folder
from ...sources.sections import parse_stage_document
from ...streaming import keyed_state as keyed
from ...streaming.micro_batches import (
    collect_stream, file_stream, first_within_overlap, transition_stream,
)
from ..store import Store


#: Files that a batch lands in, and rows from which on each of them surely gets some.
FILES = 4
MANY_ROWS = 10_000


def _landed(spark, root, rows, order, batches=3):
    """Rows as a stream of files that landed one after the other, by ``order``: a batch is
    ``FILES`` of them, or one if there are few rows."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((order - low) * batches / max(1, high - low)), F.lit(batches - 1))
    sizes = rows.agg(*[F.count_if(part == i).alias(f"n{i}") for i in range(batches)]).first()
    # Every file of a batch must get rows, as an empty one is not written.
    files = FILES if min(sizes) >= MANY_ROWS else 1
    for i in range(batches):
        batch = rows.where(part == i)
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(f"{root}/landed")
    return file_stream(spark, f"{root}/landed", rows.schema, files_per_batch=files)


@query("SELECT DISTINCT user_id, event_type, FALSE AS repeated FROM events")
def stream_first_seen(spark, folder):
    """Events per user and type in three batches: every key comes through, and no row of it
    follows another within the overlap."""
    root = f"{work_folder(spark)}/first-seen-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    first = first_within_overlap(_landed(spark, root, events, F.unix_micros("ts")), ["user_id", "event_type"], "ts")
    (first.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log")
     .trigger(availableNow=True).start().awaitTermination())
    came = spark.read.schema("ts TIMESTAMP, user_id BIGINT, event_type STRING").parquet(f"{root}/out")
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts"))
    soon = F.col("ts") <= F.col("before") + F.make_dt_interval(hours=F.lit(WINDOW_HOURS))
    return came.withColumn("before", before).groupBy("user_id", "event_type").agg(
        F.coalesce(F.bool_or(soon), F.lit(False)).alias("repeated"))


@query(f"WITH {_FOLD} SELECT id, state, updated_at FROM folded")
def stream_states(spark, folder):
    """Transitions folded into a store batch by batch, cut without regard to their time; every
    user-day is an active item."""
    root = f"{work_folder(spark)}/states-{uuid.uuid4().hex}"
    store = Store(spark, root)
    store.bootstrap()
    events = table(spark, folder, "events")
    items = events.select(user_day().alias("id")).distinct().select(
        "id", *[F.lit(None).cast("string").alias(c) for c in ("source_id", "heading", "label", "link")],
        F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("date_basis"),
        F.lit("all").alias("category"), F.array().cast("array<string>").alias("tags"),
        F.lit(0).cast("long").alias("seq"))
    store.publish({"items": store.write("items", items, "run_id=0")})
    transitions = as_transitions(_landed(spark, root, events, F.pmod(F.xxhash64("event_id"), F.lit(1000))))
    transition_stream(root, transitions, f"{root}/_log").awaitTermination()
    return Store(spark, root).read("states").select("id", "state", wall("updated_at").alias("updated_at"))


@query("""
  SELECT substr(sha256('https://example.com/orders/' || o_orderkey), 1, 16) AS id, o_orderpriority AS source_id,
         CAST(o_orderdate AS DATE) AS date
  FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '2000-01-01'""")
def stream_collect(spark, folder):
    """Gated runs over payloads that land in two files; the second is still first sync."""
    root = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    payloads = payload_columns(_landed(spark, root, table(spark, folder, "orders"), F.col("o_orderkey"), 2))
    none = spark.createDataFrame([], REFERENCE_SOURCE)
    collect_stream(root, payloads, order_sources(spark, folder), none, lambda batch: "2001-08-02 00:00:00",
                   f"{root}/_log", allow_large_change=True).awaitTermination()
    return Store(spark, root).items().select("id", "source_id", "date")


def _land(rows, folder):
    rows.repartition(FILES).write.mode("append").parquet(folder)


def _keyed(spark, name):
    """``(session for keyed state, folder)`` of one run of a query."""
    return (keyed.keyed_session(spark, spark.sparkContext.defaultParallelism),
            f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}")


@query("""
  SELECT o_orderpriority AS source_id, CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority <> '5-LOW' END AS imported
  FROM orders WHERE o_orderstatus = 'P'""")
def stream_known_ids(spark, folder):
    """Orders listed twice, in their own file and the next one, decided by the ids a stream knows.

    Even ones are known from before; the lowest priority is on its first sync. The stream
    is stopped after two of three batches and begun again. Ids come from the state itself,
    decisions from what the stream put out.
    """
    session, root = _keyed(spark, "known-ids")
    rows = order_items(session, folder).withColumns(
        {"is_initial": F.col("source_id") == "5-LOW", "at": F.lit(0)})
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.least(F.floor((F.col("seq") - low) * 3 / max(1, high - low)), F.lit(2))
    known = order_known(session, folder)
    for i in range(3):
        _land(rows.where((part == i) | (part == i - 1)), f"{root}/landed")
        if i:
            stream = file_stream(session, f"{root}/landed", rows.schema, files_per_batch=FILES)
            keyed.drain(keyed.undated_decisions(stream, known), f"{root}/out", f"{root}/log")
    decided = spark.read.schema("source_id STRING, id STRING, imported BOOLEAN, recorded BOOLEAN").parquet(f"{root}/out")
    ids = keyed.known_ids(spark, f"{root}/log")
    return ids.join(decided.where("recorded").drop("recorded"), ["source_id", "id"], "full").select("source_id", "id", "imported")


_SNAPSHOT_STAGE = "CASE WHEN (p_size + k * (p_partkey % 3)) % 5 = 0 THEN 'withdrawn' ELSE CAST((p_size + k * (p_partkey % 3)) % 5 AS VARCHAR) END"
#: Which parts a snapshot lists; the first two of every fifty are always there.
_LISTED = "((p_partkey + k) % 7 <> 0 OR p_partkey % 50 < 2)"


@query(f"""
  WITH s AS (SELECT k, p_partkey, p_name, {_SNAPSHOT_STAGE} AS stage FROM part, range(3) t(k) WHERE {_LISTED}),
  b AS (SELECT s.*, CASE WHEN s.k > 0 THEN old.stage
                         WHEN s.p_partkey % 3 <> 0 THEN CAST(1 + s.p_partkey % 4 AS VARCHAR) END AS before
        FROM s LEFT JOIN s old ON old.p_partkey = s.p_partkey AND old.k = s.k - 1)
  SELECT b.k AS seq, 'part-' || b.p_partkey AS slug, b.p_name AS name,
         CASE WHEN before IS NULL THEN 'new:' || b.stage WHEN b.stage = 'withdrawn' THEN 'withdrawn'
              ELSE 'transition:' || b.stage END AS event, last.stage AS held
  FROM b LEFT JOIN s last ON last.p_partkey = b.p_partkey AND last.k = 2
  WHERE before IS DISTINCT FROM b.stage""")
def stream_lifecycle(spark, folder):
    """Three snapshots of documents of up to fifty parts each, a file each, against the stages that
    a stream holds; ``held`` is what its state has in the end."""
    session, root = _keyed(spark, "lifecycle")
    parts = table(session, folder, "part")
    source = F.concat(F.lit("group-"), F.expr("p_partkey div 50")).alias("source_id")
    stage = F.expr("CASE WHEN (p_size + k * (p_partkey % 3)) % 5 = 0 THEN '## Withdrawn' "
                   "ELSE '## Stage ' || (p_size + k * (p_partkey % 3)) % 5 END")
    line = F.concat(stage, F.lit("\n- ["), "p_name", F.lit("](https://github.com/tc39/part-"), "p_partkey", F.lit(")\n"))
    documents = (parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(_LISTED)
                 .groupBy(source, F.col("k").cast("long").alias("seq"))
                 .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))),
                                               lambda x: x["line"]), "").alias("body")))
    for i in range(3):
        _land(documents.where(F.col("seq") == i), f"{root}/landed")
    landed = file_stream(session, f"{root}/landed", documents.schema, files_per_batch=FILES)
    none = F.lit(None).cast("string")
    snapshots = landed.select("source_id", "seq", parse_stage_document(
        F.col("body"), F.lit("https://example.com/readme"), none, none)["entries"].alias("entries"))
    known = parts.where("p_partkey % 3 <> 0").select(
        source, F.concat(F.lit("part-"), "p_partkey").alias("slug"), (1 + F.col("p_partkey") % 4).cast("string").alias("stage"))
    keyed.drain(keyed.lifecycle_changes(snapshots, known), f"{root}/out", f"{root}/log")
    moved = spark.read.schema("seq BIGINT, slug STRING, name STRING, event STRING").parquet(f"{root}/out")
    held = keyed.lifecycle_stages(spark, f"{root}/log").select("slug", F.col("stage").alias("held"))
    return moved.join(held, "slug", "left")


@query(f"""
  WITH RECURSIVE wm AS (SELECT (max(epoch_ms(ts)) - {WINDOW_HOURS} * 3600000) * 1000 AS us FROM events),
  users AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0),
  e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type = 'error' AS ends,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events, wm WHERE epoch_us(ts) <= wm.us),
  r(user_id, rn, us, event_id, outcome, known, ignored) AS (
    SELECT user_id, 0, NULL::BIGINT, NULL::BIGINT, 'before', bool_or(before),
           max(CASE WHEN before AND user_id % 3 = 0 THEN epoch_us(TIMESTAMP '2023-12-31 12:00:00') END)
    FROM (SELECT user_id, user_id % 2 = 0 OR user_id % 3 = 0 AS before FROM events) GROUP BY user_id
    UNION ALL
    SELECT user_id, rn, us, event_id,
           CASE WHEN ends AND held AND tomb IS NULL THEN 'ignored' WHEN ends THEN 'not-found'
                WHEN NOT held THEN 'added' WHEN tomb IS NULL THEN 'repeated' ELSE 'scrubbed' END,
           held OR NOT ends, CASE WHEN ends AND held AND tomb IS NULL THEN us ELSE tomb END
    FROM (SELECT e.*, r.known AND (r.ignored IS NULL OR r.ignored + {TOMBSTONE_HOURS} * 3600000000 > e.us) AS held,
                 CASE WHEN r.ignored + {TOMBSTONE_HOURS} * 3600000000 > e.us THEN r.ignored END AS tomb
          FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
  SELECT CAST(user_id AS VARCHAR) AS id, make_timestamp(us) AS ts, event_id AS seq, outcome FROM r WHERE rn > 0
  UNION ALL
  SELECT CAST(user_id AS VARCHAR), make_timestamp(ignored + {TOMBSTONE_HOURS} * 3600000000), NULL, 'pruned'
  FROM r, wm WHERE (outcome = 'ignored' OR rn = 0 AND ignored IS NOT NULL)
               AND ignored + {TOMBSTONE_HOURS} * 3600000000 <= wm.us""")
def stream_tombstones(spark, folder):
    """Users as items: an error ignores, anything else publishes; what the watermark has passed.

    Two users of three were known before, every third as a tombstone. Events land in three
    batches by time, each shuffled.
    """
    session, root = _keyed(spark, "tombstones")
    events = table(session, folder, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.expr("IF(event_type = 'error', 'ignored', 'published')").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - low) * 3 / max(1, high - low)), F.lit(2))
    for i in range(3):
        _land(events.where(part == i), f"{root}/landed")
    number = F.col("id").cast("long")
    known = events.select("id").distinct().where((number % 2 == 0) | (number % 3 == 0)).select(
        "id", F.when(number % 3 == 0, F.lit("2023-12-31 12:00:00").cast("timestamp")).alias("ignored_at"))
    stream = file_stream(session, f"{root}/landed", events.schema, files_per_batch=FILES)
    keyed.drain(keyed.tombstone_outcomes(stream, known), f"{root}/out", f"{root}/log")
    out = spark.read.schema("id STRING, ts TIMESTAMP, seq BIGINT, outcome STRING").parquet(f"{root}/out")
    return out.withColumn("ts", wall("ts"))
