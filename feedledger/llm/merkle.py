"""Merkle manifest of a table: a digest per row, per tree of rows and for the whole, with proofs.

The nodes of a tree are numbered. On every level each node meets its siblings by an equijoin on
computed indices: the index with its lowest bit flipped in a binary tree, the index with its slot
shifted within the run otherwise. Nodes at slot zero then hold their run's other digests and emit
the parent. Levels are written to the shared folder; the way back down hands each node its
parent's path. Every join key is one node, so no tree is a hot key however large it is.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import staged


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of a row's fields in turn: ``-`` for null, else the number of UTF-8
    bytes, a colon and the value, so that no two different rows give one input."""
    def coded(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(coded, fields)), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), ""), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda digest, x: F.sha2(
        F.concat(_hex(x["before"]), digest, _hex(x["after"])), 256))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``idx``, their place in their ``tree`` by ``order``, and ``n``, its size.

    Ranges of (tree, order) are sorted in their tasks and written; a row's place follows from its
    place in its task and the counts of the tasks before, a row per task and tree. The last key
    tells apart rows that share all others, so that no range is too large however many do.
    """
    keys = ["tree", *order, "tie"]
    sorted_rows = (rows.withColumn("tie", F.monotonically_increasing_id())
                   .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
                   .withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}))
    written = staged(sorted_rows, name)
    counts = written.groupBy("part", "tree").agg(F.min("pos").alias("first"), F.count("*").alias("count"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "tree", "first", F.sum("count").over(tree).alias("n"),
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return (written.join(starts, ["part", "tree"])
            .withColumn("idx", F.col("pos") - F.col("first") + F.col("before"))
            .drop("part", "pos", "first", "before"))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with the digests ``before`` and ``after`` their own in their run.

    To be a sibling goes both ways, so each digest travels to the indices of its siblings and
    meets them there in one equijoin; the result is grouped as it lies.
    """
    columns = nodes.columns
    if arity == 2:
        sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long"))
        shifts = F.array(sibling)
    else:
        shifts = F.expr(f"transform(sequence(1, {arity - 1}), d -> idx - idx % {arity} + (idx % {arity} + d) % {arity})")
    sent = (nodes.select("tree", "n", (F.col("idx") % arity).alias("slot"), F.col("digest").alias("sibling"),
                         F.explode(shifts).alias("idx")).where("idx < n").drop("n"))
    met = nodes.join(sent, ["tree", "idx"], "left").groupBy("tree", "idx").agg(
        *[F.first(c).alias(c) for c in columns if c not in ("tree", "idx")],
        F.sort_array(F.collect_list(F.when(F.col("sibling").isNotNull(), F.struct("slot", "sibling")))).alias("s"))

    def side(test: str) -> Column:
        return F.expr(f"unhex(array_join(transform(filter(s, x -> x.slot {test} idx % {arity}), x -> hex(x.sibling)), ''))")

    return met.select(*columns, side("<").alias("before"), side(">").alias("after"))


def _grown(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """``(levels, tops)`` of all trees: by level the nodes that have a parent, with their
    siblings, and the nodes that have none (``tree, idx, digest`` and what leaves carry)."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, tops, nodes = [], [leaves.where("n = 1")], leaves
    while largest > 1:
        level = staged(_with_siblings(nodes.where("n > 1"), arity), f"{name}-level")
        levels.append(level)
        nodes = level.where(f"idx % {arity} = 0").select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _hex(F.col("after"))), 256)).alias("digest"))
        tops.append(nodes.where("n = 1"))
        largest = -(-largest // arity)
    return levels, tops


_PATH = "array<struct<before: binary, after: binary>>"


def _descended(levels: list[DataFrame], tops: list[DataFrame], arity: int, keep: list[str]) -> DataFrame:
    """The leaves with ``path``, their siblings up to the top and what the tops' paths add.

    ``tops`` are those of each level with ``path`` and the columns ``keep``, which go down.
    """
    above = tops[-1]
    for level, top in zip(reversed(levels), reversed(tops[:-1]), strict=True):
        parents = above.select("tree", F.col("idx").alias("parent"), F.col("path").alias("rest"), *keep)
        own = F.array(F.struct("before", "after")).cast(_PATH)
        # Leaves keep what they carry, so the lowest level has more columns than the others.
        below = (level.withColumn("parent", F.expr(f"idx div {arity}")).join(parents, ["tree", "parent"])
                 .withColumn("path", F.concat(own, F.col("rest"))).drop("parent", "rest", "before", "after"))
        above = below.unionByName(top.select(*below.columns))
    return above


def merkle_manifest(rows: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    tree: str = "lang", order: str = "doc_id", arity: int = 8,
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """``order, tree, leaf, subroot, root, path``, one row per row of ``rows``, and ``carry``.

    A leaf is the digest of ``fields`` (:func:`leaf_digest`). The leaves of one value of ``tree``
    ascend by ``order``; every ``arity`` neighbours, of the last run fewer, become the SHA-256 of
    their hex digests until one is left, the subroot. Subroots, ordered by ``tree`` bytewise with
    null first, become the root in the same way. ``path`` holds for each level up to the root the
    digests before and after the node's own, as bytes: :func:`folded_root` checks a row by it
    without any other. ``carry`` are columns over ``rows`` to take along under other names.

    Null fields, texts of any length and null or repeated ``order`` values are leaves as any
    other: nulls come first, rows with one ``order`` value stand in the order of their digests. A
    tree or table of one row has its leaf as its root. No rows give none. Other columns of
    ``rows`` are not read.
    """
    if arity < 2:
        raise ValueError("A run has two nodes at least")
    carried = {f"carry{i}": c for i, c in enumerate((carry or {}).values())}
    # Written, as dealing them into ranges reads them twice.
    leaves = staged(rows.select(
        # Null first, then bytewise, in one column that is never null.
        F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{order}`").alias("key"),
        F.unhex(leaf_digest(*[F.col(f"`{f}`") for f in fields])).alias("digest"),
        *[c.alias(n) for n, c in carried.items()]), "digests")
    levels, tops = _grown(_numbered(leaves, ["key", "digest"], "leaves"), arity, "tree")
    ends = reduce(DataFrame.unionByName, [
        t.select("tree", "digest", F.lit(i).alias("height")) for i, t in enumerate(tops)])
    trees = _numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "height"),
                      ["name"], "subroots")
    upper, peak = _grown(trees, arity, "root")
    last = [p.select("digest").first() for p in peak[-1:]]
    root = F.lit(last[0].digest if last and last[0] else None).cast("binary")
    peak = [p.withColumn("path", F.array().cast(_PATH)) for p in peak]
    subroots = staged(_descended(upper, peak, arity, []).select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path", "height"), "subroot-paths")
    ended = [t.join(subroots.where(F.col("height") == i).drop("height"), "tree") for i, t in enumerate(tops)]
    found = _descended(levels, ended, arity, ["subroot"])
    return found.select(
        F.col("key").alias(order), F.expr("IF(tree = '', null, substring(tree, 2))").alias("tree"),
        _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(root).alias("root"), "path",
        *[F.col(n).alias(name) for n, name in zip(carried, carry or {}, strict=True)])
