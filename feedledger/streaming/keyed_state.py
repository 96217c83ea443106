"""Rules with a memory per key, as keyed state of a stream.

What a batch run looks up in a table (ids decided on, lifecycle stages, tombstones) a stream
keeps in its state store, next to the rows that need it, and writes back with each micro-batch. The
state starts from the tables of the batch form, survives a restart in the checkpoint and can be read
from there as tables again.

State is per source and a bucket of its keys, so a source with a third of all rows is many
keys. How a backlog is cut into batches decides nothing, if files land in the order of ``seq`` (or,
for tombstones, at most the watermark's delay out of the order of time).
"""

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.joins import SALTS
from ..schemas import TOMBSTONE_HOURS, WINDOW_HOURS

#: Parts of a bucket's known ids; a part is read and written whole, with one call for all its ids.
PARTS = 128
#: Groups of sources whose shares of a bucket are one value of state.
CELLS = 256
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own on the same cluster, for streams with keyed state.

    Keyed state needs the RocksDB store. ``partitions`` is how many parts the state has for good:
    a checkpoint keeps the number it was begun with.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", "UTC")
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


def drain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is available to parquet files below ``out`` and end."""
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def state_table(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """A state variable as the last committed batch left it: ``key`` and its values."""
    return (spark.read.format("statestore").option("operatorId", operator)
            .option("stateVarName", variable).load(checkpoint))


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("_bucket")


# Undated items ---------------------------------------------------------------------------

def undated_decisions(items: DataFrame, known: DataFrame | None = None, buckets: int = SALTS) -> DataFrame:
    """Streaming form of ``decide_undated``: rows with ``imported`` and ``recorded``.

    ``items`` is a stream with ``source_id, id, date_basis, is_initial, pos, seq, at`` and any
    other columns. Dated items pass at once, without state. An undated one is decided the first
    time its id comes from its source, recorded and withheld on the first sync, else imported and
    recorded; later rows of that id go. ``known(source_id, id)`` are ids decided before the
    stream began. Of rows in one batch the first by ``pos, seq, at`` counts. Rows without an
    id are left out.
    """
    names = items.columns
    decided = StructType([*items.schema.fields, StructField("imported", BooleanType()),
                          StructField("recorded", BooleanType())])
    order = [names.index(c) for c in ("pos", "seq", "at") if c in names]
    id_at, initial_at = names.index("id"), names.index("is_initial")
    row_type = Row(*decided.fieldNames())

    class Decide(StatefulProcessor):
        def init(self, handle):
            self.known = handle.getMapState("known", "part INT", "ids ARRAY<STRUCT<id: STRING, outcome: STRING>>")

        def handleInputRows(self, key, rows, timerValues):
            parts = {}
            for row in rows:
                *values, _, part = tuple(row)
                first = parts.setdefault(part, {})
                rank = [(values[i] is not None, values[i]) for i in order]
                held = first.get(values[id_at])
                if held is None or rank < held[0]:
                    first[values[id_at]] = (rank, values)
            for part, first in parts.items():
                held = self.known.getValue((part,))
                ids = {} if held is None else {k["id"]: k["outcome"] for k in held[0]}
                new = {id_: values for id_, (_, values) in first.items() if id_ not in ids}
                if not new:
                    continue
                ids.update((id_, "withheld" if values[initial_at] else "imported") for id_, values in new.items())
                self.known.updateValue((part,), (list(ids.items()),))
                for values in new.values():
                    yield row_type(*values, not values[initial_at], True)

        def handleInitialState(self, key, initialState, timerValues):
            self.known.updateValue((initialState["_part"],), ([(id_, "before") for id_ in {k["id"] for k in initialState["ids"]}],))

    place = [_bucket("id", buckets), F.pmod(F.shiftright(F.xxhash64("id"), 20), F.lit(PARTS)).cast("int").alias("_part")]
    keyed = items.where("date_basis = 'discovered' AND id IS NOT NULL").select(*names, *place)
    before = None
    if known is not None:
        before = (known.select("source_id", "id", *place).groupBy("source_id", "_bucket", "_part")
                  .agg(F.collect_list(F.struct("id")).alias("ids")).groupBy("source_id", "_bucket"))
    undated = keyed.groupBy("source_id", "_bucket").transformWithState(
        Decide(), decided, "append", "None", before)
    dated = items.where("date_basis <> 'discovered'").withColumns({"imported": F.lit(True), "recorded": F.lit(False)})
    return dated.unionByName(undated)


def known_ids(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(source_id, id)`` that the stream has decided on, or knew before: the batch form's table."""
    return state_table(spark, checkpoint, "known").select(
        "key.source_id", F.explode("user_map_value.ids.id").alias("id"))


# Lifecycle stages ------------------------------------------------------------------------

def lifecycle_changes(snapshots: DataFrame, known: DataFrame | None = None, buckets: int = SALTS) -> DataFrame:
    """Streaming form of the lifecycle diff: ``source_id, seq, at, slug, name, url, stage, event``.

    ``snapshots`` is a stream of parsed payloads ``source_id, seq, entries``. Every snapshot is
    compared with the one of its source before it, ``known(source_id, slug, stage)`` before the
    first: the same as a batch run per snapshot, whatever the cut. A slug that a snapshot
    no longer has is forgotten and would be new again. Every bucket of a source sees every
    snapshot, if only an empty share, so it knows what has gone. A snapshot that lands after a
    later one of its source is passed over; a failed payload, without entries, is no snapshot.
    """
    schema = "source_id STRING, seq BIGINT, at INT, slug STRING, name STRING, url STRING, stage STRING, event STRING"
    row_type = Row("source_id", "seq", "at", "slug", "name", "url", "stage", "event")

    class Compare(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getValueState("held", (
                "sources ARRAY<STRUCT<source_id: STRING, newest: BIGINT, stages: ARRAY<STRUCT<slug: STRING, stage: STRING>>>>"))

        def handleInputRows(self, key, rows, timerValues):
            value, changed = self.held.get(), False
            held = {} if value is None else {
                k["source_id"]: (k["newest"], {s["slug"]: s["stage"] for s in k["stages"]}) for k in value[0]}
            for snapshot in sorted(rows, key=lambda r: r["seq"]):
                source = snapshot["source_id"]
                newest, before = held.get(source, (None, {}))
                if newest is not None and snapshot["seq"] <= newest:
                    continue
                newest, seen, changed = snapshot["seq"], {}, True
                for entry in snapshot["share"]:
                    slug, stage = entry["slug"], entry["stage"]
                    was = before.get(slug)
                    seen[slug] = stage
                    if was == stage:
                        continue
                    event = ("new:" + stage if was is None else
                             "withdrawn" if stage == "withdrawn" else "transition:" + stage)
                    yield row_type(source, newest, entry["at"], slug, entry["heading"], entry["link"], stage, event)
                held[source] = newest, seen
            if changed:
                self.held.update(([(source, newest, list(stages.items())) for source, (newest, stages) in held.items()],))

        def handleInitialState(self, key, initialState, timerValues):
            held = [(k["source_id"], None, list({s["slug"]: s["stage"] for s in k["stages"]}.items()))
                    for k in initialState["sources"]]
            self.held.update((held,))

    cell = F.pmod(F.xxhash64("source_id"), F.lit(CELLS)).cast("int").alias("_cell")
    placed = F.transform("entries", lambda e, i: F.struct(
        i.alias("at"), e["slug"].alias("slug"), e["stage"].alias("stage"), e["heading"].alias("heading"),
        e["link"].alias("link"), F.pmod(F.xxhash64(e["slug"]), F.lit(buckets)).cast("int").alias("bucket")))
    shares = (snapshots.where("entries IS NOT NULL").select("source_id", F.col("seq").cast("long").alias("seq"), placed.alias("placed"))
              .withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
              .select("source_id", cell, "_bucket", "seq", F.filter("placed", lambda e: (
                  e["bucket"] == F.col("_bucket")) & e["slug"].isNotNull() & e["stage"].isNotNull()).alias("share")))
    before = None
    if known is not None:
        before = (known.select("source_id", "slug", "stage", _bucket("slug", buckets)).groupBy("source_id", "_bucket")
                  .agg(F.collect_list(F.struct("slug", "stage")).alias("stages")).groupBy(cell, "_bucket")
                  .agg(F.collect_list(F.struct("source_id", "stages")).alias("sources")).groupBy("_cell", "_bucket"))
    return shares.groupBy("_cell", "_bucket").transformWithState(Compare(), schema, "append", "None", before)


def lifecycle_stages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(source_id, slug, stage)`` as the next snapshot will find them."""
    return state_table(spark, checkpoint, "held").select(
        F.inline("value.sources")).select("source_id", F.inline("stages").alias("slug", "stage"))


# Tombstones ------------------------------------------------------------------------------

def tombstone_outcomes(events: DataFrame, known: DataFrame | None = None, delay_hours: int = WINDOW_HOURS,
                       life_hours: int = TOMBSTONE_HOURS) -> DataFrame:
    """What becomes of items that are published and ignored, by event time: ``id, ts, seq, outcome``.

    ``events`` is a stream ``id, kind, ts, seq``, ``kind`` ``published`` or ``ignored``;
    ``known(id, ignored_at)`` are items from before the stream, a tombstone where ``ignored_at``
    is set. An event waits until the watermark, ``delay_hours`` behind the newest one, has passed it,
    and then counts in the order of ``(ts, seq)``: batches may bring them in any order
    within the delay, later ones are dropped as late.

    Outcomes: ``added`` (published, unknown), ``repeated`` (active already), ``ignored`` (a tombstone
    from now on), ``not-found`` (ignored, but not active), ``scrubbed`` (published under a live
    tombstone) and ``pruned``, the end of a tombstone exactly ``life_hours`` after its item
    was ignored, without any further event: timers fire as the watermark passes, so the query
    ends by itself. Published at that very moment counts as unknown again.
    """
    schema = "id STRING, ts_us BIGINT, seq BIGINT, outcome STRING"
    row_type, life = Row("id", "ts_us", "seq", "outcome"), life_hours * 3_600_000_000

    class Decide(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            # One value, so a key costs one read and one write; active where known and not ignored.
            self.item = handle.getValueState(
                "item", "known BOOLEAN, ignored_us BIGINT, waiting ARRAY<STRUCT<ts_us: BIGINT, seq: BIGINT, kind: STRING>>")

        def held(self):
            known, ignored, waiting = self.item.get() or (False, None, [])
            return known, ignored, [tuple(w) for w in waiting]

        def wake(self, us):
            # Timers have milliseconds: the first at which the moment has passed.
            self.handle.registerTimer(-(-us // 1000))

        def handleInputRows(self, key, rows, timerValues):
            known, ignored, held = self.held()
            new = [(r["ts_us"], r["seq"], r["kind"]) for r in rows]
            self.item.update((known, ignored, held + new))
            # The first of those that wait has a timer already.
            first = min(n[0] for n in new)
            if not held or first < min(w[0] for w in held):
                self.wake(first)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
            before = known, ignored, held = self.held()
            held = sorted(held)
            due = [w for w in held if w[0] <= passed]
            later = held[len(due):]
            out = []

            def prune(until):
                if known and ignored is not None and ignored + life <= until:
                    out.append(row_type(key[0], ignored + life, None, "pruned"))
                    return False, None
                return known, ignored

            for us, seq, kind in due:
                known, ignored = prune(us)
                if kind == "ignored":
                    outcome = "ignored" if known and ignored is None else "not-found"
                    if outcome == "ignored":
                        ignored = us
                elif not known:
                    known, outcome = True, "added"
                else:
                    outcome = "repeated" if ignored is None else "scrubbed"
                out.append(row_type(key[0], us, seq, outcome))
            known, ignored = prune(passed)
            if ignored is not None and ignored != before[1]:
                self.wake(ignored + life)
            if due and later:
                self.wake(later[0][0])
            if known or later:
                if (known, ignored, later) != before:
                    self.item.update((known, ignored, later))
            elif before[0] or before[2]:
                self.item.clear()
            return iter(out)

        def handleInitialState(self, key, initialState, timerValues):
            self.item.update((True, initialState["ignored_us"], []))
            if initialState["ignored_us"] is not None:
                self.wake(initialState["ignored_us"] + life)

    timed = (events.where("id IS NOT NULL AND kind IN ('published', 'ignored')")
             .select("id", "kind", F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").alias("ts_us"))
             .withWatermark("ts", f"{delay_hours} hours"))
    before = None
    if known is not None:
        before = known.select("id", F.unix_micros("ignored_at").alias("ignored_us")).groupBy("id")
    decided = timed.groupBy("id").transformWithState(Decide(), schema, "append", "EventTime", before)
    return decided.select("id", F.timestamp_micros("ts_us").alias("ts"), "seq", "outcome")


def tombstones(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(id, ignored_at)`` of items known at the watermark; null: active."""
    return state_table(spark, checkpoint, "item").where("value.known").select(
        "key.id", F.timestamp_micros("value.ignored_us").alias("ignored_at"))
