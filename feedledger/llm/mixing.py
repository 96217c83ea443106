"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets an exact quota of blocks (runs of consecutive document copies in the
source's own random order). A binary tree over the output shards splits the quotas: at each
node the left half's blocks are drawn multivariate-hypergeometrically from the node's. A
shard's blocks of a source are then a range of that source's permuted blocks, disjoint from
all others, and are shuffled inside the shard.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .shared import fresh, prepare_workers, row_hash, staged

#: Documents in one unit of the permutation; its row numbers are windowed together.
UNIT = 4096
#: Above so many blocks in all, blocks are made longer: numpy's sampler ends at 10^9.
MOST_BLOCKS = 500_000_000


def weighted_targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total size by weight, none above ``most`` times its size; what a capped
    source leaves is shared by weight among the others until none is above."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in over:
            targets[i] = most * sizes[i]
            total -= targets[i]
            open_.remove(i)
    return targets


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``(shards, sources)`` block counts; columns sum to the quotas, rows differ by one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def draw(colors: np.ndarray, n: int) -> np.ndarray:
        taken, left = np.zeros_like(colors), int(colors.sum())
        for i, c in enumerate(colors):
            left -= int(c)
            taken[i] = rng.hypergeometric(int(c), left, n) if n and c else 0
            n -= int(taken[i])
        return taken

    def split(colors: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = colors
            return
        middle = (first + last) // 2
        total = int(colors.sum())
        # Shards get equal totals: shard i ends at total * (i + 1) // shards of the whole.
        part = _until(whole, middle, shards) - _until(whole, first, shards)
        left = draw(colors, min(part, total))
        split(left, first, middle)
        split(colors - left, middle, last)

    whole = int(sum(quotas))
    split(np.array(quotas, np.int64), 0, shards)
    return out


def _until(total: int, shard: int, shards: int) -> int:
    return total * shard // shards


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words, runs of bytes other than space and 9 to 13, of each text; null has none."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    starts[first] = ~space[first]
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[ends[1:]] - before[ends[:-1]]


def _sized(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(word_counts(b.column(3)), pa.int64())],
            ["doc_id", "source", "row_hash", "size"])


def plan_mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
             source_column: str = "source", weights: tuple[float, ...] = (5, 2, 1),
             most: float = 3.0, shards: int = 16, block: int = 4, seed: int = 20) -> DataFrame:
    """One narrow row per document row: what the mix takes of it and where it goes.

    Columns: ``doc_id, source, row_hash, size, source_size, target, taken, places``, where
    ``places`` is an array of ``(shard, copy)``, one per copy taken. Sources sorted by code
    point, null last, have the weights in turn and share the total size. A source's mix is
    as many whole passes over its documents as fit its target; then, in random order, the
    documents that still fit; then the one document that leaves the least gap, if it helps.

    The order is by hashes of (seed, id, row), so reruns agree. Texts without words have
    size 0 and are never taken; a null text or source is a value like any other; rows that
    repeat exactly are taken each on its own. The driver sees one row per source.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    sized = staged(docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"), row_hash(docs).alias("row_hash"),
        F.col(text_column).cast("string").alias("text")).mapInArrow(
        _sized, "doc_id long, source string, row_hash long, size long"), "mix-sizes")
    sources = sorted(sized.groupBy("source").agg(F.sum("size").alias("words"),
                                                 F.count_if(F.expr("size > 0")).alias("docs")).collect(),
                     key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = weighted_targets([r.words for r in sources],
                               [weights[i % len(weights)] for i in range(len(sources))], most)
    plans = [(i, r.source, r.words, r.docs, t, int(t // r.words) if r.words else 0)
             for i, (r, t) in enumerate(zip(sources, targets, strict=True))]
    known = sized.alias("d").join(_small(spark.createDataFrame(
        [(*p, max(1, p[3] // UNIT)) for p in plans],
        "number long, s string, source_size long, docs long, target double, passes long, "
        "units long"), len(plans)), F.expr("source <=> s")).drop("s")
    placed = staged(_ranked(known, seed), "mix-ranks")
    firsts = {r.number: r for r in placed.where("fits").groupBy("number").agg(
        F.count("*").alias("n"), F.sum("size").alias("words")).collect()}
    gaps = [(i, float(t - k * w - (firsts[i].words if i in firsts else 0)),
             firsts[i].n if i in firsts else 0) for i, _, w, _, t, k in plans]
    gap = _small(spark.createDataFrame(gaps, "number long, gap double, fitting long"), len(gaps))
    fillers = {r.number: r.rank for r in placed.where("NOT fits").join(gap, "number")
               .where("abs(size - gap) < gap").groupBy("number")
               .agg(F.min_by("rank", F.struct(F.abs(F.col("size") - F.col("gap")), "rank"))
                    .alias("rank")).collect()}
    copies = [k * d + gaps[i][2] + (i in fillers) for i, _, _, d, _, k in plans]
    block = max(block, -(-sum(copies) // MOST_BLOCKS))
    quotas = [-(-c // block) for c in copies]
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    last = _small(spark.createDataFrame(
        [(i, fillers.get(i, -1), gaps[i][2], [int(e) for e in ends[:-1, i]]) for i in range(len(plans))],
        "number long, filler long, fitting long, ends array<long>"), len(plans))
    # Copies are numbered without gaps: pass * docs + rank, the filler behind what fits.
    rows = placed.join(last, "number", "left").withColumn(
        "more", F.expr("fits OR rank = filler")).withColumn(
        "copies", F.expr("passes + int(more)")).select(
        "doc_id", "source", "row_hash", "size", "source_size", "target",
        F.expr("copies * size").alias("taken"),
        F.expr(f"""transform(filter(sequence(0L, copies), c -> c < copies), c -> named_struct(
            'shard', size(filter(ends, e -> e <=
                (c * docs + IF(c < passes OR fits, rank, fitting)) div {block})),
            'copy', int(c)))""").alias("places"))
    empty = known.where("size = 0").select(
        "doc_id", "source", "row_hash", "size", "source_size", "target",
        F.lit(0).cast("long").alias("taken"),
        F.array().cast("array<struct<shard:int,copy:int>>").alias("places"))
    return rows.unionByName(empty)


def _small(rows: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of one row per source where its checked size allows that."""
    return F.broadcast(rows) if n <= 10_000 else rows


def _ranked(known: DataFrame, seed: int) -> DataFrame:
    """Documents with words, with their ``rank`` in their source's random order and whether
    they fit whole into what the last pass still takes (``fits``).

    The order is that of hashed units of some UNIT documents, then of rows in a unit, so no
    window grows with a source.
    """
    known = (known.where("size > 0")
             .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "row_hash"))
             .withColumn("unit", F.expr("pmod(shiftright(order, 20), units)")))
    # One row per unit, some thousandth of the documents.
    before = Window.partitionBy("number").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = (known.groupBy("number", "unit").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
              .select("number", "unit",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
                      F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before")))
    within = Window.partitionBy("number", "unit").orderBy("order", "doc_id", "row_hash")
    return (known.withColumn("rank", F.row_number().over(within) - 1)
            .withColumn("upto", F.sum("size").over(
                within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .join(starts, ["number", "unit"])
            .select("doc_id", "source", "row_hash", "size", "number", "source_size", "docs",
                    "target", "passes", (F.col("rank") + F.col("docs_before")).alias("rank"),
                    (F.col("upto") + F.col("words_before")
                     <= F.col("target") - F.col("passes") * F.col("source_size")).alias("fits")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    ``docs``' columns and, named so that they clash with none, ``shard`` and ``shard_order``.
    ``shuffled`` brings the rows into that order. Rows are not cut. Only documents taken at
    least once are joined.
    """
    shard, order, key, row, places, n = fresh(
        docs.columns, "shard", "shard_order", "mix_key", "mix_row", "mix_places", "mix_rows")
    plan = plan_mix(docs, **options).where("size(places) > 0").groupBy(
        F.col("doc_id").alias(key), F.col("row_hash").alias(row)).agg(
        F.flatten(F.collect_list("places")).alias(places), F.count("*").alias(n))
    keyed = docs.withColumn(row, row_hash(docs))
    ident = options.get("id_column", "doc_id")
    both = keyed.join(plan.withColumnRenamed(row, row + "p"),
                      F.col(row).eqNullSafe(F.col(row + "p"))
                      & keyed[f"`{ident}`"].eqNullSafe(F.col(key)))
    # Rows that repeat exactly share their places; one of them stands for all.
    once = both.where(F.col(n) == 1).unionByName(
        both.where(F.col(n) > 1).dropDuplicates([row, key]))
    return once.select(*docs.columns, F.explode(places).alias(places)).select(
        *docs.columns, F.col(f"{places}.shard").alias(shard),
        F.xxhash64(F.lit(options.get("seed", 20)), F.col(places), F.col(f"`{ident}`")).alias(order))


def shuffled(mixed: DataFrame, shards: int = 16) -> DataFrame:
    """Rows of ``mix``, sorted by shard and, in it, by a random order.

    A shard is dealt in stretches of its order, as many as fill the session's shuffle
    partitions, so that no task holds a whole shard.
    """
    shard, order = mixed.columns[-2:]
    (stretch,) = fresh(mixed.columns, "stretch")
    parts = -(-int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    # The order is a hash: its leading 31 bits are even over 0 to 2^31.
    dealt = mixed.withColumn(stretch, F.expr(f"shiftrightunsigned(`{order}`, 33) * {parts} div {1 << 31}"))
    return dealt.repartition(shard, stretch).sortWithinPartitions(shard, order).drop(stretch)
