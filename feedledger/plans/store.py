"""Where tables live between runs.

A table is a list of directories of immutable parquet files; a version is one small file
below a folder of its number that names the directories of every table. A run writes its
directories first and the version last, so readers see all of a run or none of it, and a job
that dies half-way leaves only directories nobody refers to. There is one writer at a time.

Items grow by a segment per run and are never rewritten. A segment's digests tell whether it is
still as it was published, its filter which ids it may hold. Items that leave are listed in
``removed``, which is subtracted when items are read. States grow by segments of what changed,
each row over those of the same id in earlier segments; a row without a state takes it away.
``compact`` folds all segments into one, ``vacuum`` deletes what no kept version names.
"""

import re

from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from .. import schemas as S
from ..operators.checks import ID_FORMAT, item_digest

_RUN = StructField("run_id", LongType())
STORED_ITEM = StructType(S.ITEM.fields + [_RUN])
#: A state and the position of its segment.
STORED_STATE = StructType(S.STATE.fields + [_RUN])
REMOVED = StructType([StructField("id", StringType()), _RUN])
#: What an item looked like when it was published, to tell later whether it still does.
PRINT = StructType([StructField("id", StringType()), StructField("digest", LongType()), _RUN])
#: What a segment of items held per category when it was published, whatever the order of its rows:
#: how many, the sum of their ids' hashes and the sum of their digests.
SEGMENT_DIGEST = StructType([_RUN, StructField("category", StringType()), StructField("n", LongType()),
                             StructField("ids", DecimalType(38, 0)), StructField("digest", DecimalType(38, 0))])
#: A segment's Bloom filter: blocks of 256 bits, of which an id sets eight in one.
SEGMENT_FILTER = StructType([_RUN, *[StructField(n, LongType()) for n in ("blocks", "block", "w0", "w1", "w2", "w3")]])
#: Ids per block of 256 bits: about one id in 10^5 that is not there seems to be.
IDS_PER_BLOCK = 8

TABLES = {
    "items": STORED_ITEM, "removed": REMOVED, "states": STORED_STATE, "cursors": S.CURSOR,
    "known_undated": S.KNOWN_UNDATED, "lifecycle_stage": S.LIFECYCLE_STAGE,
    "source_status": S.SOURCE_STATUS, "runs": S.RUN, "prints": PRINT,
    "digests": SEGMENT_DIGEST, "filters": SEGMENT_FILTER,
    # Of the newest run only: every issue found and every source that failed.
    "issues": S.ISSUE, "failures": S.FAILURE,
}
#: Tables whose directories are partitions: ``run_id=<n>``, then these columns.
PARTITIONED = {"items": ["category"]}
#: Streams that began from a version, and whether they have ended.
DRAIN = "drain STRING, began BIGINT, version BIGINT, ended BOOLEAN"
_NAME = re.compile("[a-z][a-z0-9_]*")
_VERSION = "directories MAP<STRING, ARRAY<STRING>>, version BIGINT"


def _wide(number: Column) -> Column:
    return number.cast("decimal(38,0)")


def _id_hash() -> Column:
    return _wide(F.xxhash64("id"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), F.col("id")), blocks.cast("long"))


def _masks(prefix: str) -> list[Column]:
    """Two bits in each of a block's four words, from 48 bits of a hash."""
    bits = "xxhash64(2, id)"
    return [F.expr(" | ".join(f"shiftleft(1L, int(shiftrightunsigned({bits}, {6 * (2 * i + j)}) & 63))" for j in (0, 1)))
            .alias(f"{prefix}{i}") for i in range(4)]


@dataclass
class Store:
    spark: SparkSession
    root: str
    version: int = 0
    directories: dict[str, list[str]] = field(default_factory=dict)
    #: Schemas of the tables known, those that were declared at run time included.
    tables: dict[str, StructType] = field(default_factory=lambda: dict(TABLES))

    def __post_init__(self) -> None:
        self.refresh()

    def _pointer(self) -> str:
        return f"{self.root}/_versions"

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(_VERSION).parquet(self._pointer())

    def _exists(self, version: int) -> bool:
        try:
            return not self._versions().where(F.col("version") == version).isEmpty()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False

    def refresh(self, version: int | None = None) -> "Store":
        """Load the newest version or the given one; an empty root is version 0.

        The number is part of a file's path, so only the file of that version is read. A
        given version that does not exist, or no longer, is an error.
        """
        wanted = version
        try:
            versions = self._versions()
            if version is None:
                version = versions.agg(F.max("version")).first()[0]
            newest = versions.where(F.col("version") == version).first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = None
        if newest is None and wanted:
            raise ValueError(f"The store has no version {wanted}")
        self.version = newest["version"] if newest else 0
        self.directories = dict(newest["directories"]) if newest else {}
        return self

    def declare(self, table: str, schema: StructType) -> None:
        """Add a table to the catalogue; it is empty until a version names directories of it."""
        if table in TABLES or not _NAME.fullmatch(table):
            raise ValueError(f'"{table}" is no name for a further table')
        if self.tables.setdefault(table, schema) != schema:
            raise ValueError(f'Table "{table}" is declared with another schema')

    def bootstrap(self) -> None:
        """Create whatever is missing, empty; a run at the epoch means never run."""
        if self.version:
            return
        zeros = F.struct(*[F.lit(0).cast("long").alias(n) for n in (
            "succeeded", "failed", "planned", "added", "total")])
        never = self.spark.range(1).select(
            F.lit(0).cast("long").alias("run_id"), F.lit(S.NEVER_RUN).cast("timestamp").alias("last_run_at"),
            zeros.alias("coverage"),
            F.lit(None).cast(S.RUN["rejected"].dataType).alias("rejected"))
        self.publish({"runs": self.write("runs", never, "run_id=0")})

    def read(self, table: str) -> DataFrame:
        """A table of this version; of states the newest of each id."""
        paths = self.directories.get(table, [])
        return self._states(paths) if table == "states" else self.scan(table, paths)

    def _states(self, paths: list[str]) -> DataFrame:
        """The first segment is the base: it is read in place, less what later ones hold."""
        base, later = self.scan("states", paths[:1]), self.scan("states", paths[1:])
        if len(paths) > 1:
            row = F.struct(*S.STATE.fieldNames())
            newest = later.groupBy("id").agg(F.max_by(row, "run_id").alias("s")).select("s.*")
            base = base.join(newest, "id", "left_anti").drop("run_id").unionByName(newest)
        return base.where("state IS NOT NULL").select(*S.STATE.fieldNames())

    def write_states(self, changed: DataFrame) -> list[str]:
        """Write a segment of changed states and return the directories of all segments."""
        before = self.directories.get("states", [])
        # Segments are numbered on, as several may be written between two runs.
        number = F.lit(len(before)).cast("long").alias("run_id")
        return self.append("states", changed.drop("run_id").select("*", number), f"version={self.version + 1}")

    def scan(self, table: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.tables[table])
        reader = self.spark.read.schema(self.tables[table])
        if table in PARTITIONED:
            reader = reader.option("basePath", f"{self.root}/{table}")
        return reader.parquet(*[f"{self.root}/{p}" for p in paths])

    # Segments of items ---------------------------------------------------------------------

    def segments(self, table: str = "items") -> list[int]:
        """The runs whose segments make up a table."""
        return [int(d.rsplit("run_id=", 1)[1]) for d in self.directories.get(table, [])]

    def items_in(self, segments: list[int]) -> DataFrame:
        """Active items of some segments, with the run that brought them."""
        paths = [d for d, n in zip(self.directories.get("items", []), self.segments(), strict=True) if n in set(segments)]
        return self._without_removed(self.scan("items", paths))

    def index_segment(self, items: DataFrame, name: str, n: int, ids_per_block: int = IDS_PER_BLOCK) -> dict[str, list[str]]:
        """Write digests and filter of a segment of ``n`` items (``id`` and the compared fields);
        returns the directories of both."""
        run = F.lit(int(name.rsplit("run_id=", 1)[1])).cast("long").alias("run_id")
        per_category = items.groupBy("category").agg(
            F.count("*").alias("n"), F.sum(_id_hash()).alias("ids"), F.sum(_wide(item_digest(items))).alias("digest"))
        blocks = 1
        while blocks * ids_per_block < n:
            blocks *= 2
        words = items.select(F.lit(blocks).cast("long").alias("blocks"), _block(F.lit(blocks)).alias("block"), *_masks("w"))
        filled = words.groupBy("blocks", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
        return {"digests": self.write("digests", per_category.select(run, "*"), name),
                "filters": self.write("filters", filled.select(run, "*"), name)}

    def segments_holding(self, ids: DataFrame) -> list[int]:
        """Segments that may hold one of the ids: all that do, and a few more.

        A segment's filter is a fifth of its ids' size, and of it only the blocks that
        an id falls into are compared. Segments without a filter are always named.
        """
        known = set(self.segments("filters"))
        named = [n for n in self.segments() if n not in known]
        filters = self.read("filters")
        # A power of two per size of a segment, so some tens at most.
        sizes = sorted(r["blocks"] for r in filters.select("blocks").distinct().collect())
        if not sizes:
            return named
        probes = ids.select("id").distinct().select(
            "id", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("blocks")).select(
            "blocks", _block(F.col("blocks")).alias("block"), *_masks("m"))
        hit = F.lit(True)
        for i in range(4):
            hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
        found = filters.join(probes, ["blocks", "block"]).where(hit).select("run_id").distinct().collect()
        return sorted({*named, *(r["run_id"] for r in found)} & set(self.segments()))

    def audit(self) -> tuple[list[int], bool]:
        """``(segments that are not as they were published, whether ids and states agree)``.

        One scan of items and of states, added up where they lie: per segment and category the
        digests of now against those kept, and over all, the hashed ids of items less those
        removed against those of states that are no tombstones. If the sums are equal, so are the
        multisets, but for a chance of 2^-64. Segments without digests are not compared.
        """
        n, zero = F.lit(1).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")
        off = _wide((~F.coalesce(F.col("id").rlike(ID_FORMAT), F.lit(False))).cast("int"))
        items = self.read("items")
        held = items.groupBy("run_id", "category").agg(
            F.sum(n).alias("n"), F.sum(_id_hash()).alias("ids"), F.sum(_wide(item_digest(items))).alias("digest"),
            F.sum(off).alias("off")).withColumn("kept", F.lit(False))
        total = F.lit(-1).cast("long")
        both = held.select(F.explode(F.array(
            F.struct("run_id", "category", "n", "ids", "digest", zero.alias("off"), "kept"),
            F.struct(total.alias("run_id"), F.lit("").alias("category"), "n", "ids", zero.alias("digest"), "off",
                     F.lit(True).alias("kept")))).alias("r")).select("r.*")
        minus = [(-F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "ids", "digest")]
        recorded = self.read("digests").select("run_id", "category", *minus, zero.alias("off"), F.lit(True).alias("kept"))

        def taken(rows: DataFrame) -> DataFrame:
            return rows.select(total.alias("run_id"), F.lit("").alias("category"), (-n).alias("n"),
                               (-_id_hash()).alias("ids"), zero.alias("digest"), zero.alias("off"), F.lit(True).alias("kept"))

        rows = (both.unionByName(recorded).unionByName(taken(self.read("removed")))
                .unionByName(taken(self.read("states").where("state <> 'ignored'"))))
        sums = rows.groupBy("run_id", "category").agg(
            *[F.sum(c).alias(c) for c in ("n", "ids", "digest", "off")], F.max("kept").alias("kept"))
        odd = (sums.groupBy("run_id").agg(F.max("kept").alias("kept"), F.bool_or(
            F.expr("n <> 0 OR ids <> 0 OR digest <> 0 OR off <> 0")).alias("odd")).where("kept AND odd"))
        runs = [r["run_id"] for r in odd.select("run_id").collect()]
        return sorted(r for r in runs if r >= 0), -1 not in runs

    def stored_items(self) -> DataFrame:
        """Active items with the run that brought them."""
        return self._without_removed(self.read("items"))

    def prints(self) -> DataFrame:
        """Digests of active items as they were published."""
        return self._without_removed(self.read("prints"))

    def _without_removed(self, items: DataFrame) -> DataFrame:
        if not self.directories.get("removed"):
            return items
        removed = self.read("removed").groupBy("id").agg(F.max("run_id").alias("_until"))
        gone = (items["id"] == removed["id"]) & (items["run_id"] < removed["_until"])
        return items.join(removed, gone, "left_anti")

    def items(self) -> DataFrame:
        return self.stored_items().drop("run_id")

    def write(self, table: str, rows: DataFrame, directory: str) -> list[str]:
        """Write one immutable directory of a table and return its name as a list.

        Columns the rows do not have are written as NULL.
        """
        path = f"{table}/{directory}"
        columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                   for f in self.tables[table] if table not in PARTITIONED or f.name != "run_id"]
        writer = rows.select(*columns).write.mode("overwrite")
        if table in PARTITIONED:
            writer = writer.partitionBy(*PARTITIONED[table])
        writer.parquet(f"{self.root}/{path}")
        return [path]

    def write_counted(self, table: str, rows: DataFrame, directory: str) -> tuple[list[str], int]:
        """:meth:`write`, and how many rows it wrote, counted by the writing tasks themselves."""
        seen = Observation()
        written = self.write(table, rows.observe(seen, F.count(F.lit(1)).alias("n")), directory)
        return written, seen.get.get("n", 0)

    def append(self, table: str, rows: DataFrame, directory: str) -> list[str]:
        """Write one more directory of a table and return all of them; an empty one is left out
        if there are others."""
        before = self.directories.get(table, [])
        written, n = self.write_counted(table, rows, directory)
        return before + (written if n or not before else [])

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        """Cut a plan at a written table and read it back.

        Staged tables sit in the shared root, so losing an executor costs a task retry
        and not the whole lineage.
        """
        path = f"{self.root}/_staging/version={self.version + 1}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def publish(self, changed: dict[str, list[str]]) -> None:
        """Append the next version: ``changed`` replaces those tables' directories.

        The version must be new: if another writer has published it meanwhile, this is an
        error and that one's work stays.
        """
        directories = {**self.directories, **changed}
        if self._exists(self.version + 1):
            raise ValueError(f"Version {self.version + 1} has been published by another writer")
        row = self.spark.createDataFrame([(directories,)], "directories MAP<STRING, ARRAY<STRING>>")
        # A folder without a row is what a writer that died has left.
        row.coalesce(1).write.mode("overwrite").parquet(f"{self._pointer()}/version={self.version + 1}")
        self.version, self.directories = self.version + 1, directories

    def compact(self) -> None:
        """Fold removals and segments of items and states into one segment each."""
        name = f"run_id={self.version}"
        run = F.lit(self.version).cast("long").alias("run_id")
        prints = self.write("prints", self.prints().select("id", "digest", run), name)
        states = self.write("states", self.read("states"), f"version={self.version + 1}")
        items, n = self.write_counted("items", self.stored_items(), name)
        self.publish({"items": items, "prints": prints, "removed": [], "states": states,
                      **self.index_segment(self.scan("items", items), name, n)})

    def begun_from(self) -> list[int]:
        """Versions that streams began from which have not ended; they will be read again."""
        try:
            drains = self.spark.read.schema(DRAIN).parquet(f"{self.root}/_drains")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        open_ones = drains.groupBy("drain", "began").agg(
            F.max("version").alias("version"), F.max("ended").alias("ended")).where("NOT ended")
        return sorted(r["version"] for r in open_ones.select("version").distinct().collect())

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete versions before the ``keep`` newest, the directories that only they name and
        what runs staged; returns what was deleted. Versions that an unfinished stream began
        from stay. Not while a run is under way."""
        version, used = F.col("version"), self.begun_from()
        kept = self._versions().where((version > self.version - keep) | version.isin(used)).collect()
        named = {d for v in kept for paths in v["directories"].values() for d in paths}
        numbers = {f"_versions/version={v['version']}" for v in kept}
        plain = "file://" + self.root[5:] if self.root.startswith("file:/") and self.root[:7] != "file://" else self.root
        store, root = fs.FileSystem.from_uri(plain)
        gone = []
        # Tables that other sessions declared are known by the directories of the newest version.
        for table in [*{**self.tables, **self.directories}, "_versions", "_staging"]:
            for entry in store.get_file_info(fs.FileSelector(f"{root}/{table}", allow_not_found=True)):
                name = f"{table}/{entry.base_name}"
                if entry.type == fs.FileType.Directory and name not in named | numbers:
                    store.delete_dir(entry.path)
                    gone.append(name)
        return sorted(gone)
