"""Vectors: which take part, exact top-k by pivot elimination, near-duplicates by p-stable
hashing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .runs import runs
from .shared import prepare_workers, staged


def _whole(vector: str) -> str:
    """SQL: the vector has components, and all are finite numbers."""
    return (f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, "
            "x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column as a matrix; shorter vectors end in zeros."""
    lengths = np.array(column.value_lengths())
    if len(lengths) and (lengths == lengths[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max(initial=0)), kind)
    for row, v in zip(out, column.to_pylist(), strict=True):
        row[:len(v)] = v
    return out


# Exact top-k ------------------------------------------------------------------------------

#: Components beyond this would not sum exactly in doubles; such blocks use Python's integers.
_EXACT = float(1 << 53)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of a sample, so that pivots differ in direction."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample ** 2).sum(1)))]
    apart = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < _EXACT:
        return (x @ q).astype(np.int64)
    whole = [[int(a) for a in row] for row in (q, *x)]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([max(low, min(high, sum(a * b for a, b in zip(whole[0], row, strict=True))))
                     for row in whole[1:]], np.int64)


def span_of(pivots: np.ndarray, wide: int) -> np.ndarray:
    """Orthonormal rows that span the pivots (and more, if the pivots are dependent)."""
    pivots = np.pad(pivots, ((0, 0), (0, wide - pivots.shape[1])))
    norms = np.abs(pivots).max(axis=1, initial=0)
    q, _ = np.linalg.qr((pivots[norms > 0] / norms[norms > 0, None]).T)
    return np.ascontiguousarray(q.T)


def _pivot_row(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    """What the distances to the pivots say of each vector: its coordinates in their span and,
    last, its distance from the span."""
    at = x @ span.T
    rest = np.sqrt(np.maximum(0, (x ** 2).sum(1) - (at ** 2).sum(1)))
    return np.concatenate([at, rest[:, None]], axis=1)


def _nearest(q, q_id, bound, x, x_id, k: int, step: int = 64):
    """The ``k`` best of ``x`` for ``q`` in the order of their upper bounds, and how many were
    evaluated. Evaluation ends when the next bound is below the k-th best score."""
    bound[x_id == q_id] = -np.inf
    best_s, best_i, seen, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    order, size = np.zeros(0, np.int64), step
    while done < len(x):
        if done == len(order):  # sort only as far as evaluation goes
            size = min(len(x), size * 8)
            top = np.argpartition(-bound, size - 1)[:size] if size < len(x) else np.arange(len(x))
            order = top[np.argsort(-bound[top], kind="stable")]
            # What was evaluated before has the highest bounds, up to ties: evaluate anew.
            best_s, best_i, done, seen = best_s[:0], best_i[:0], 0, 0
        part = order[done:done + step]
        done += len(part)
        live = part[bound[part] > -np.inf]
        if not len(live) or len(best_s) >= k and bound[live[0]] < best_s[k - 1]:
            break
        seen += len(live)
        s = np.concatenate([best_s, _scores(q, x[live])])
        at = np.concatenate([best_i, x_id[live]])
        first = np.lexsort((at, ~s))[:k]  # ~s falls as s rises, without overflow
        best_s, best_i = s[first], at[first]
    return best_s, best_i, seen


def top_k(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
          queries: str | None = None, k: int = 10, scale: int = 1024, pivots: int = 48,
          pivot_sample: int = 2048, query_block: int = 2048, vector_block: int = 8192,
          counted: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the exact ``k`` highest integer inner products.

    Components become floor(scale * x). ``queries`` is SQL over ``id`` for the rows that
    search (default: ids divisible by 100); candidates are all rows with another id. Queries
    and vectors are dealt into blocks of a bounded size; each pair of blocks is one group. The
    pivots are chosen from at most ``pivot_sample`` rows. A vector's distances to all of them
    and to the origin fix its coordinates in the pivots' span and its distance from it; these are computed once
    and travel with it. Two vectors are at least as far apart as their coordinates and the
    difference of their distances from the span say, which is the maximum of all lower bounds
    that the pivots give (each single pivot's included); so their inner product is at most that
    of the coordinates and the product of the two distances. Candidates are evaluated
    in the order of this bound until none can enter. ``counted`` adds ``evaluated``, the
    candidates that a query evaluated.

    Rows without an id, null or empty vectors and vectors with null or non-finite components
    take no part. Shorter vectors count as ending in zeros. Ties go to the smaller id; rows
    that share an id are candidates each. Scores beyond a long are clamped to it.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"),
                          F.col(vector_column).cast("array<double>").alias("v")).where(
        "id IS NOT NULL AND " + _whole("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivot_sample).select("v").collect()
    chosen = choose_pivots(np.floor(_matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())))
                                    * scale), pivots)
    span = span_of(chosen, chosen.shape[1])

    def measured(batches):
        for b in batches:
            x = np.floor(_matrix(b.column(1)) * scale)
            if x.shape[1] < span.shape[1]:
                x = np.pad(x, ((0, 0), (0, span.shape[1] - x.shape[1])))
            wide = np.pad(span, ((0, 0), (0, x.shape[1] - span.shape[1])))
            far = _pivot_row(x, wide)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.tobytes() for r in far], pa.binary())], ["id", "x", "far"])

    table = staged(rows.mapInArrow(measured, "id long, x binary, far binary"), "pivot-table")
    asked = table.where(queries or "id % 100 = 0")
    blocks = -(-table.count() // vector_block) or 1
    groups = -(-asked.count() // query_block) or 1

    def dealt(part: DataFrame, own: int, other: int, key: str) -> DataFrame:
        return (part.withColumn("own", F.pmod(F.xxhash64("id", "x"), F.lit(own)))
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
                # Columns of each side's own, so that pruning tells the two sides apart.
                .select(F.expr(key).alias("pair"), *(F.col(c).alias(c) for c in ("id", "x", "far"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q_id, q, q_far = _unpacked(left)
        x_id, x, x_far = _unpacked(right)
        if not len(q) or not len(x):
            q_id, q = q_id[:0], q[:0]
        if q.shape[1] != x.shape[1]:
            q, x = _widened(q, x)
        norms, found = (x ** 2).sum(1), []
        for i in range(0, len(q), 256):
            own = (q[i:i + 256] ** 2).sum(1)
            slack = 1e-7 * (own[:, None] + norms) + 1  # more than rounding can add
            bounds = np.nan_to_num(q_far[i:i + 256] @ x_far.T + slack, nan=np.inf)
            found += [(q_id[i + j], *_nearest(q[i + j], q_id[i + j], bounds[j], x, x_id, k)) for j in range(len(own))]
        return pa.table({
            "query_id": pa.array(np.repeat(q_id, [len(f[1]) for f in found]), pa.int64()),
            "vec_id": pa.array(np.concatenate([f[2] for f in found] or [q_id[:0]]), pa.int64()),
            "score": pa.array(np.concatenate([f[1] for f in found] or [q_id[:0]]), pa.int64()),
            "seen": pa.array(np.repeat([f[3] for f in found], [len(f[1]) for f in found]), pa.int64()),
            "block": pa.array(np.repeat(right.column("pair")[0].as_py() if len(x) else 0, sum(len(f[1]) for f in found)),
                              pa.int64())})

    best = (dealt(asked, groups, blocks, f"own * {blocks} + other").groupBy("pair")
            .cogroup(dealt(table, blocks, groups, f"other * {blocks} + own").groupBy("pair"))
            .applyInArrow(search, "query_id long, vec_id long, score long, seen long, block long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if counted:
        block = Window.partitionBy("query_id", "block").orderBy("rank")
        ranked = ranked.withColumn("part", F.when(F.row_number().over(block) == 1, F.col("seen")).otherwise(0)).withColumn(
            "evaluated", F.sum("part").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score", *(["evaluated"] if counted else []))


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))


def _unpacked(rows: pa.Table):
    ids = rows.column("id").to_numpy()
    x = [np.frombuffer(v) for v in rows.column("x").to_pylist()]
    far = [np.frombuffer(v) for v in rows.column("far").to_pylist()]
    wide, pivots = max(map(len, x), default=0), len(far[0]) if far else 0
    return (ids, np.array([np.pad(v, (0, wide - len(v))) if len(v) < wide else v for v in x]).reshape(len(x), wide),
            np.array(far).reshape(len(far), pivots))


# Near-duplicates --------------------------------------------------------------------------

def _hashes(units: np.ndarray, tables: int, functions: int, width: float, seed: int) -> np.ndarray:
    """``(rows, tables)`` keys: floors of shifted Gaussian projections, mixed to 64 bits."""
    rng = np.random.default_rng([seed, units.shape[1]])
    lines = rng.standard_normal((units.shape[1], tables * functions))
    shifts = rng.uniform(0, width, tables * functions)
    odd = rng.integers(0, 1 << 63, (tables, functions + 1), np.uint64) * np.uint64(2) + np.uint64(1)
    cells = np.floor(np.round((units @ lines + shifts) / width, 9)).astype(np.int64)
    cells = cells.view(np.uint64).reshape(-1, tables, functions)
    keys = (cells * odd[None, :, :functions]).sum(axis=2, dtype=np.uint64) + odd[None, :, functions]
    keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component roots after linking ``a`` and ``b``; ``root`` holds the smallest index."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == root).all():
            return root
        root = new


def near_duplicate_vectors(vectors: DataFrame, *, id_column: str = "vec_id",
                           vector_column: str = "embedding", cosine: float = 0.95,
                           tables: int = 32, functions: int = 6, width: float = 1.0,
                           seed: int = 10, compared: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Normalised vectors are bucketed in ``tables`` tables by ``functions`` quantised Gaussian
    projections each; pairs that share a bucket are checked by their cosine in doubles. With
    the given values a pair at cosine 0.95 is met with probability 0.997, closer ones more
    surely. A pair counts in the first table where it meets, so counts need no pair list;
    tasks emit counts and edges per vector. Equal vectors are one class and compared once.
    Buckets of over ``compared`` vectors are cut into chunks and compared chunk by chunk.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing, as do vectors without an id and vectors of different lengths.
    """
    prepare_workers(vectors.sparkSession)
    element = vectors.schema[vector_column].dataType.elementType.simpleString()
    kind, name = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast(f"array<{name}>").alias("w"))
    rows = rows.withColumn("v", F.expr(
        f"IF(id IS NOT NULL AND {_whole('w')} AND exists(w, x -> x <> 0), w, null)")).drop("w")
    classes = staged(rows.where("v IS NOT NULL").groupBy("v").agg(
        F.min("id").alias("node"), F.count("*").alias("copies")), "vector-classes")
    columns = "key long, number int, node long, copies long, v binary, chunk int, low int, high int"

    def bucketed(batches):
        for b in batches:
            lengths = np.array(b.column(2).value_lengths())
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                part = b.take(pa.array(at))
                x = _matrix(part.column(2))
                keys = _hashes(_units(x), tables, functions, width, seed)
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                zero = pa.array(np.zeros(len(at), np.int32))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[:, t]), pa.array(np.full(len(at), t, np.int32)),
                         part.column(0), part.column(1), raw, zero, zero, zero],
                        [c.split()[0] for c in columns.split(", ")])

    def met(batches):
        for (key, number, node, copies, v, chunk, low, high), over in runs(batches, compared * 4):
            if over and (low == high).all() and not high.any():
                yield _met_rows(node, copies, node, v, key, number, True)
                continue
            for n in {len(r) for r in v} if len({len(r) for r in v}) > 1 else [len(v[0])]:
                at = np.flatnonzero([len(r) == n for r in v])
                got = compare(number[at], node[at], copies[at], v[at], chunk[at], low[at], high[at])
                if got is not None:
                    yield got

    def compare(number, node, copies, v, chunk, low, high):
        units = _units(np.frombuffer(b"".join(v), kind).reshape(len(v), -1).astype(np.float64))
        count, root, table = np.zeros(len(v), np.int64), np.arange(len(v)), int(number[0])
        across, first = low[0] != high[0], chunk == low[0]
        keys = None
        for i in range(0, len(v), 512):
            near = units[i:i + 512] @ units.T >= cosine
            a, b = np.nonzero(near)
            a += i
            some = (first[a] & ~first[b]) if across else a < b
            a, b = a[some], b[some]
            if not len(a):
                continue
            if table:
                if keys is None:
                    keys = _hashes(units, tables, functions, width, seed)[:, :table]
                new = np.concatenate([~(keys[a[j:j + 100_000]] == keys[b[j:j + 100_000]]).any(axis=1)
                                      for j in range(0, len(a), 100_000)])
                a, b = a[new], b[new]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            root = _merge(root, a, b)
        at = np.flatnonzero(count)
        return _met_rows(node[at], count[at], node[root[at]], None, None, None, False) if len(at) else None

    def _met_rows(node, links, root, v, key, number, hot):
        n = len(node)
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()),
             pa.array(list(v) if hot else [None] * n, pa.binary()),
             pa.array(key if hot else np.zeros(n, np.int64), pa.int64()),
             pa.array(number if hot else np.zeros(n, np.int32), pa.int32())],
            ["node", "links", "root", "v", "key", "number"])

    out = "node long, links long, root long, v binary, key long, number int"
    found = staged(classes.select("node", "copies", "v").mapInArrow(bucketed, columns)
                   .repartition("key").sortWithinPartitions("key", "node").mapInArrow(met, out), "met")
    # Crowded buckets: chunks of a bounded size, each pair of chunks a run of its own.
    hot = found.where("v IS NOT NULL")
    parts = hot.groupBy("key").agg(F.ceil(F.count("*") / compared).cast("int").alias("parts"))
    pairs = (hot.join(parts, "key").withColumn("chunk", F.expr("int(pmod(xxhash64(node), parts))"))
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
             .select(F.expr("key bucket"), "number", "node", F.col("links").alias("copies"), "v", "chunk",
                     F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
             .withColumn("low", F.col("low") + 1).withColumn("high", F.col("high") + 1)
             .withColumn("chunk", F.col("chunk") + 1)
             .select(F.xxhash64("bucket", "low", "high").alias("key"), "number", "node", "copies", "v",
                     "chunk", "low", "high"))
    more = pairs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(met, out)
    links = staged(found.where("v IS NULL").unionByName(more).select("node", "links", "root"), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (classes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
             .join(roots, "node", "left")
             .select("v", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"),
                     F.coalesce("root", "node").alias("component_id")))
    return rows.join(known, "v", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.expr("id <=> coalesce(component_id, id)").alias("kept"))
