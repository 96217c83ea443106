"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits meet in a variant that is at most half the radius
from each. The fingerprint is cut into ``blocks``: of a pair within the radius some block
differs in at most ``radius // blocks`` bits, so each block emits all its variants within half
of that, is shuffled on (block, variant), and colliding pairs are checked on all bits. With
one block of 64 bits this is 2081 variants a fingerprint, with two blocks of 32 bits 66.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .runs import runs
from .shared import fresh, prepare_workers, row_hash, staged

BITS = 64
_STEP = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; none without words."""
    parts = (text or "").encode().lower().split()  # of bytes: ASCII letters and spaces alone
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1:] if len(parts) >= words else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())),
                       np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        h = hashes[i:i + _STEP].astype("<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # bytes hold a sum of 255 bits
        ones += bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 without words."""
    return majority(shingle_hashes(text, words))


def variants(bits: int, distance: int) -> np.ndarray:
    """Masks of up to ``distance`` of ``bits`` bits."""
    return np.array([sum(1 << b for b in c) for d in range(distance + 1)
                     for c in combinations(range(bits), d)], np.uint64)


def linked_roots(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the index of the first of its component, links at ``radius`` bits."""
    root, changed = np.arange(len(values)), True
    while changed:
        changed = False
        for i in range(0, len(values), 256):
            near = np.bitwise_count(values[i:i + 256, None] ^ values[None, :]) <= radius
            low = np.where(near, root[None, :], len(values)).min(axis=1)
            if (low < root[i:i + 256]).any():
                root[i:i + 256], changed = low, True
    return root


def _keys(blocks: int, radius: int):
    """Emit ``(key, fp, node)`` for each block's variants."""
    width = BITS // blocks
    masks = variants(width, -(-(radius // blocks) // 2))

    def emit(batches):
        for batch in batches:
            fp, node = (c.to_numpy() for c in batch.columns)
            if not len(fp):
                continue
            parts = []
            for b in range(blocks):
                block = fp.view(np.uint64) >> np.uint64(b * width)
                if blocks > 1:
                    block = block & np.uint64((1 << width) - 1)
                keys = block[:, None] ^ masks[None, :]
                # Blocks' keys are told apart by what is above a block's bits.
                parts.append(keys.ravel() | np.uint64(b << width if blocks > 1 else 0))
            keys = np.concatenate(parts).view(np.int64)
            again = np.tile(np.repeat(np.arange(len(fp)), len(masks)), blocks)
            for i in range(0, len(keys), 200_000):
                at = again[i:i + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:i + 200_000]), pa.array(fp[at]), pa.array(node[at])],
                    ["key", "fp", "node"])
    return emit


def _met(radius: int, compared: int):
    """Links of each run of equal keys, as edges to the first of a component; members of a
    run of over ``compared`` rows as ``(node, null, fp)``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64())])

    def out(a, b, fp):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fp, pa.int64())], schema=schema)

    def meet(batches):
        a, b = [], []
        for (_, fp, node), over in runs(batches, compared):
            if over:
                yield out(node, [None] * len(node), fp)
                continue
            root = linked_roots(fp.view(np.uint64), radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            a += node[moved].tolist()
            b += node[root[moved]].tolist()
            if len(a) > 50_000:
                yield out(a, b, [0] * len(a))
                a, b = [], []
        yield out(a, b, [0] * len(a))
    return meet


def _stars(batches):
    """Edges from each row to the first of its run; a key is a variant of the whole
    fingerprint, which is near 2081 others at most."""
    for (_, _, node), _ in runs(batches, 1 << 13):
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[1:]), pa.array(np.full(len(node) - 1, node[0]))], ["a", "b"])


def fingerprint_links(classes: DataFrame, radius: int, blocks: int, compared: int) -> DataFrame:
    """Links ``(a, b)`` that connect the rows of ``classes(fp, node)`` whose fingerprints, each
    there once, are within ``radius`` bits."""
    def by_key(rows: DataFrame, blocks: int) -> DataFrame:
        return (rows.mapInArrow(_keys(blocks, radius), "key long, fp long, node long")
                .repartition("key").sortWithinPartitions("key", "node"))

    met = staged(by_key(classes.select("fp", "node"), blocks)
                 .mapInArrow(_met(radius, compared), "a long, b long, fp long"), "met")
    crowd = met.where("b IS NULL").select("fp", F.col("a").alias("node")).distinct()
    return met.where("b IS NOT NULL").select("a", "b").unionByName(
        by_key(crowd, 1).mapInArrow(_stars, "a long, b long"))


def simhash_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                       radius: int = 4, words: int = 4, blocks: int = 2,
                       compared: int = 4096) -> DataFrame:
    """``doc_id, row_hash, fp, component_id``, one row per row of ``docs``.

    ``fp`` is the fingerprint as a signed long; ``component_id`` the smallest id reachable by
    links of at most ``radius`` differing bits. No link is missed. Equal fingerprints are
    compared once; collisions are compared inside tasks and leave only edges that connect
    them, never all pairs. Members of collisions of over ``compared`` fingerprints are met
    once more in one block of all bits, where every collision is a link by itself.

    Null and empty texts have fingerprint 0 and are linked like others. Rows without an id
    take no part: their ``component_id`` is null. Rows that share an id count each.
    """
    spark = docs.sparkSession
    prepare_workers(spark)

    def hashed(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_hash", "fp"])

    prints = staged(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"),
        F.col(text_column).cast("string").alias("text")).mapInArrow(
        hashed, "doc_id long, row_hash long, fp long"), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    found = components(fingerprint_links(classes.where("node IS NOT NULL"), radius, blocks, compared))
    known = classes.join(found, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(known, "fp").select(
        "doc_id", "row_hash", "fp",
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Of several rows with that id, one stays (that with the smallest row hash; of rows that
    repeat exactly, any). Rows without an id are all kept. Columns are those of ``docs``.
    """
    return keep_first(docs, staged(simhash_components(docs, id_column=id_column, **options), "components"), id_column)


def keep_first(docs: DataFrame, found: DataFrame, id_column: str) -> DataFrame:
    """Of each component of ``found(doc_id, row_hash, component_id)`` the row of ``docs`` with
    the smallest id, and all rows without an id."""
    key, row, n = fresh(docs.columns, "kept_key", "kept_row", "kept_rows")
    rows = found.where("doc_id = component_id").groupBy("component_id", "row_hash").agg(
        F.count("*").alias("n"))
    kept = rows.groupBy("component_id").agg(F.min(F.struct("row_hash", "n")).alias("k")).select(
        F.col("component_id").alias(key), F.col("k.row_hash").alias(row), F.col("k.n").alias(n))
    keyed = docs.withColumn(row, row_hash(docs)).withColumn(key, docs[f"`{id_column}`"].cast("long"))
    stay = keyed.join(kept, [key, row])
    return (stay.where(F.col(n) == 1).unionByName(
        stay.where(F.col(n) > 1).dropDuplicates([key])).select(*docs.columns)
        .unionByName(docs.where(F.col(f"`{id_column}`").isNull())))
