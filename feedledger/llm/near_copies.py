"""Near copies of texts: SimHash balls and MinHash bands gather candidates, whole texts decide.

Texts are sets of word shingles. Equal sets are one class from the start. Classes whose SimHash
fingerprints meet by ball hashing (:mod:`.simhash`) are joined to clusters. At a similarity of 0.8
fingerprints differ in some 10 bits, so classes are joined, too, if they agree in one of ``BANDS``
bands of ``ROWS`` minima and in enough of their signatures; only a spanning forest of each
band is written, never its pairs. The members of a cluster then meet with their whole texts, dealt in chunks, and each task compares what its
chunks hold: two texts are linked if the Jaccard similarity of their sets is at least
``least``. A task emits a spanning forest of its links, so no table grows with the square of
a group.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .runs import runs
from .shared import prepare_workers, row_hash, staged
from .simhash import fingerprint_links, keep_first, majority, shingle_hashes

#: A pair at similarity s meets with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5
#: Minima of which the rows of a band have a byte, and how many must agree; at 0.8 fewer do
#: with probability 1e-5. Whole signatures have a byte of every minimum.
SIGNED, AGREED = 64, 36
WHOLE_AGREED = 74
#: Rows of one band that are compared by signature; a larger band is one cluster as it is.
COMPARED = 1 << 12
#: Shingles that count as much as a further text when clusters are cut into chunks.
SHINGLES_A_TEXT = 256
_FACTORS, _TERMS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS = (_FACTORS << np.uint64(1) | np.uint64(1))[:, None]
_TERMS = _TERMS[:, None]
_STEP = 1 << 10


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted XXH64 (seed 42) of the different word shingles; none without words."""
    return np.unique(shingle_hashes(text, words))


def minima(of: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(of), _STEP):
        np.minimum(out, (of[i:i + _STEP] * _FACTORS + _TERMS).min(axis=1), out=out)
    return out


def _band_keys(low: np.ndarray) -> bytes:
    row = low.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(row[8 * ROWS * i:8 * ROWS * (i + 1)], i) for i in range(BANDS)],
                    "<u8").tobytes()


def _bands(batches):
    """Emit ``(key, node, sig)`` for each band of a class."""
    for batch in batches:
        node, keys, sig = batch.columns
        if not batch.num_rows:
            continue
        all_keys = np.frombuffer(b"".join(keys.to_pylist()), "<i8")
        short = pa.array([s[:SIGNED] for s in sig.to_pylist()], pa.binary())
        at = np.repeat(np.arange(batch.num_rows), BANDS)
        for i in range(0, len(at), 100_000):
            part = pa.array(at[i:i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(all_keys[i:i + 100_000]), node.take(part), short.take(part)],
                                             ["key", "node", "sig"])


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forest(signs: np.ndarray):
    """``(found, parent)`` positions that span what agrees: a row is compared with the rows
    that nothing has reached yet."""
    left = np.arange(len(signs))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (signs[left] == signs[at]).sum(axis=1) >= AGREED
            found, left = left[near], left[~near]
            if len(found):
                yield found, at
                queue += found.tolist()


def _met(batches):
    """Spanning pairs of each run of equal keys; of a run over ``COMPARED`` rows, which comes
    in parts, every row with the first."""
    open_key, first = None, None
    for (key, node, sig), over in runs(batches, COMPARED):
        if over:
            if first is None or key[0] != open_key:
                open_key, first = key[0], node[0]
            yield _pairs(node, np.full(len(node), first))
            continue
        for found, at in _forest(np.frombuffer(b"".join(sig), np.uint8).reshape(-1, SIGNED)):
            yield _pairs(node[found], np.full(len(found), node[at]))


def _linked(words: int, least: float):
    """Links that join different components among the texts of each tile, at most one fewer
    than texts."""
    def link(batches):
        for (_, root, node, sig, text), _ in runs(batches, 1 << 62):
            signs = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, BANDS * ROWS)
            component = np.unique(root, return_inverse=True)[1]
            if not component.any():
                continue
            sets = [shingles(t, words) for t in text]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
            mine = np.zeros(ids.max() + 1, bool)
            a, b = [], []
            for i in range(len(sets) - 1):
                others = np.flatnonzero(component[i + 1:] != component[i]) + i + 1
                others = others[(signs[others] == signs[i]).sum(axis=1) >= WHOLE_AGREED]
                if not len(others):
                    continue
                own = ids[starts[i]:starts[i] + n[i]]
                mine[own] = True
                both = np.add.reduceat(mine[ids], starts, dtype=np.int64)[others]
                mine[own] = False
                for j in others[both / (n[i] + n[others] - both) >= least].tolist():
                    if component[j] != component[i]:
                        component[component == component[j]] = component[i]
                        a.append(max(node[i], node[j]))
                        b.append(min(node[i], node[j]))
            if a:
                yield _pairs(a, b)
    return link


def near_copy_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                         words: int = 5, least: float = 0.8, crowd: int = 512,
                         radius: int = 4, blocks: int = 2, compared: int = 4096) -> DataFrame:
    """``doc_id, row_hash, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links: pairs of texts whose sets of
    ``words``-word shingles (lower case; a shorter text is one shingle) have a Jaccard
    similarity of ``least`` or more. Every link is checked on the whole texts, so none is
    wrong; one at 0.8 is missed with probability 1e-4, above that with less (the bands are
    laid for 0.8: a lower ``least`` needs more of them). Texts whose fingerprints are within
    ``radius`` bits (:func:`.simhash.simhash_components`, here of ``words`` words) always meet.

    A cluster is cut into chunks of about ``crowd`` texts (a text counts one, and one more for
    every 256 shingles). At first each chunk meets with the cluster's first text, which joins
    a group of near copies. What remains in several components meets chunk by chunk, the
    largest component not with itself; a task holds two chunks. A text is sent once for each
    chunk that it meets, so the cost grows with the square of a cluster only where its texts
    are less alike than ``least``.

    Texts without words are copies of each other. Rows without an id take no part: their
    ``component_id`` is null. Rows that share an id count each in the similarities, but have
    one component. An empty table gives an empty table; a very long text is hashed whole, in
    one task. Other columns, whatever their names, only tell rows apart that share an id.
    """
    spark = docs.sparkSession
    prepare_workers(spark)

    def hashed(batches):
        for b in batches:
            whole, n, fps, keys, sig = [], [], [], [], []
            for text in b.column(2):
                every = shingle_hashes(text.as_py(), words)
                fps.append(majority(every))
                of = np.unique(every)
                low = minima(of)
                whole.append(xxhash.xxh64_intdigest(of.tobytes(), 7))
                n.append(len(of))
                keys.append(_band_keys(low))
                sig.append((low >> np.uint64(20)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(n, pa.int64()),
                 pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "row_hash", "words_hash", "n", "fp", "keys", "sig"])

    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"),
                        F.col(f"`{text_column}`").cast("string").alias("text"))
    prints = staged(texts.mapInArrow(
        hashed, "doc_id long, row_hash long, words_hash long, n long, fp long, keys binary, sig binary"), "shingled")
    # The text with the smallest id stands for its class.
    classes = staged(prints.where("doc_id IS NOT NULL").groupBy("words_hash").agg(
        F.min(F.struct("doc_id", "row_hash", "n", "keys", "sig")).alias("k"))
        .select("words_hash", F.col("k.doc_id").alias("node"), "k.row_hash", "k.n", "k.keys", "k.sig"), "classes")
    met = staged(classes.where("n > 0").select("node", "keys", "sig").mapInArrow(
        _bands, "key long, node long, sig binary")
        .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "a long, b long"), "met")
    # A class has a fingerprint for each way in which its shingles are repeated.
    printed = staged(prints.where("doc_id IS NOT NULL AND n > 0").select("words_hash", "fp").distinct().join(
        classes.select("words_hash", "node"), "words_hash").select("fp", "node"), "printed")
    balls = staged(printed.groupBy("fp").agg(F.min("node").alias("node")), "balls")
    equal = printed.join(balls.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    met = met.unionByName(equal).unionByName(fingerprint_links(balls, radius, blocks, compared))
    members = staged(classes.where("n > 0").join(components(met), "node").select(
        "node", "row_hash", F.col("root").alias("cluster"), "sig", (1 + F.col("n") / SHINGLES_A_TEXT).alias("weight")),
        "members")
    def chunks(weight) -> F.Column:
        return F.ceil(F.coalesce(weight, F.lit(0)) / crowd).cast("long")

    def dealt_to(count: F.Column) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.greatest(count, F.lit(1)))

    def linked(placed: DataFrame, name: str) -> DataFrame:
        """Links of the texts of ``placed(tile, root, node, sig, text)`` that share a tile."""
        return staged(placed.select("tile", "root", "node", "sig", "text")
                      .repartition("tile").sortWithinPartitions("tile", "node")
                      .mapInArrow(_linked(words, least), "a long, b long"), name)

    sized = members.join(members.groupBy("cluster").agg(chunks(F.sum("weight")).alias("chunks")), "cluster")
    # Texts move to their places once; rows that repeat exactly stand for one.
    place = F.struct("cluster", "chunks", "weight", "sig")
    sides = staged(texts.join(sized.select(F.col("node").alias("doc_id"), "row_hash", place.alias("place")),
                              ["doc_id", "row_hash"]).groupBy("doc_id", "row_hash").agg(
        F.first("text").alias("text"), F.first("place").alias("place"))
        .select(F.col("doc_id").alias("node"), "place.*", "text"), "sides")
    own = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(
        F.array(dealt_to(F.col("chunks"))))
    links = linked(sides.withColumn("chunk", F.explode(own)).select(
        F.xxhash64("cluster", "chunk").alias("tile"), F.col("node").alias("root"), "node", "sig", "text"), "linked")
    found = components(links)
    # Clusters of several chunks that are still in several components.
    rooted = sides.where("chunks > 1").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = staged(rooted.groupBy("cluster", "root").agg(F.sum("weight").alias("w")).groupBy("cluster").agg(
        F.max_by("root", "w").alias("major"), chunks(F.max("w")).alias("major_chunks"),
        chunks(F.sum("w") - F.max("w")).alias("minor_chunks"), F.count("*").alias("roots")).where("roots > 1"), "split")
    if not split.isEmpty():
        major = F.col("root") == F.col("major")
        chunk = F.when(major, F.col("minor_chunks") + dealt_to(F.col("major_chunks"))).otherwise(
            dealt_to(F.col("minor_chunks")))
        last = F.when(major, F.col("minor_chunks") - 1).otherwise(F.col("minor_chunks") + F.col("major_chunks") - 1)
        placed = (rooted.join(split, "cluster").withColumn("chunk", chunk)
                  .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))))))
        rest = linked(placed.select(
            F.xxhash64("cluster", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"),
            "root", "node", "sig", "text"), "linked-chunks")
        found = components(links.unionByName(rest))
    known = classes.join(found, "node", "left").select(
        "words_hash", F.coalesce("root", "node").alias("component_id"))
    return prints.join(known, "words_hash", "left").select(
        "doc_id", "row_hash", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    return keep_first(docs, staged(near_copy_components(docs, id_column=id_column, **options), "components"), id_column)
