"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

An id is replaced by its rank by corpus frequency and stored in 1 to 4 bytes; a control byte
holds the lengths of four codes. Files hold blocks of documents in ascending id order:

    magic, then per block: counts of documents, control and data bytes; document ids; flags
    of null ids; numbers of token ids; control bytes (each document's padded to whole ones);
    data bytes. The ids in rank order lie in a file of their own.
"""

import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .files import reading, writing
from .shared import new_folder, prepare_workers, staged
from .tokens import default_vocabulary, encoder

MAGIC, HEAD = b"RANKTOK1", "<4sIQQ"
#: Code lengths of the four ids under each control byte, and what is kept of four read bytes.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2)[None, :] & 3).astype(np.uint8) + 1
KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_USED = np.arange(4)[None, :] < np.arange(5)[:, None]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_USED[lengths]]
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = lengths - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(counts: np.ndarray, control: bytes, data: bytes) -> np.ndarray:
    """The ranks of several documents with ``counts`` codes each, by table lookup."""
    groups = -(-counts // 4)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    ends, spare = np.cumsum(groups) * 4, groups * 4 - counts
    there = np.ones(len(lengths), bool)
    for k in (1, 2, 3):
        there[ends[spare >= k] - k] = False
    lengths = lengths[there]
    offsets = np.cumsum(lengths, dtype=np.int64) - lengths
    whole = data + bytes(4)
    words = np.ndarray((len(data) + 1,), "<u4", whole, 0, (1,))
    return words[offsets] & KEPT[lengths]


@lru_cache(maxsize=2)
def _ids_by_rank(path: str) -> np.ndarray:
    with reading(path) as f:
        return np.frombuffer(f.read(), "<u4")


def write_tokens(docs: DataFrame, folder: str | None = None, *, id_column: str = "doc_id",
                 text_column: str = "text", vocabulary: str | None = None, end_id: int = 0,
                 block_docs: int = 512, block_bytes: int = 8 << 20) -> DataFrame:
    """Write the files; the result is their manifest (``part, path, docs, ids, ranks``).

    Texts are encoded once; ids are kept in a table of the shared folder while their
    frequencies are counted over all of it, then dealt by ranges of document id, each range
    one file. Each attempt of a task writes a file of its own; the manifest, a table, names
    those of tasks that ended well. A null or empty text has the end id alone. Documents
    without an id come first; rows that share an id stand next to each other. An empty table
    gives no files.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or new_folder(spark, "token-files")

    def tokenized(batches):
        encode, end = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()
        counts = np.zeros(0, np.int64)
        for b in batches:
            raw = [encode(t.as_py()) + end for t in b.column(1)]
            if not raw:
                continue
            n = np.bincount(np.frombuffer(b"".join(raw), "<u4"))
            counts = np.pad(counts, (0, max(0, len(n) - len(counts))))
            counts[:len(n)] += n
            # Two bytes an id while the vocabulary allows; the width is read off the length.
            narrow = [np.frombuffer(r, "<u4").astype("<u2").tobytes() if len(n) <= 1 << 16 else r for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(narrow, pa.binary()),
                 pa.array([len(r) // 4 for r in raw], pa.int64()),
                 pa.array([None] * len(raw), pa.list_(pa.int64()))], ["doc_id", "ids", "n", "counts"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()),
             pa.array([counts.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids", "n", "counts"])

    table = staged(docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
                   .mapInArrow(tokenized, "doc_id long, ids binary, n long, counts array<long>"), "token-ids")
    # One row per id of the vocabulary reaches the driver.
    seen = (table.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n"))
            .where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).collect())
    by_rank = np.array([r.id for r in sorted(seen, key=lambda r: (-r.n, r.id))], "<u4")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    ranks_path = f"{folder}/ids-by-rank.bin"
    with writing(ranks_path) as f:
        f.write(by_rank.tobytes())
    ids = table.where("ids IS NOT NULL").select("doc_id", "ids", "n")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = np.unique(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1e-3)
                     if parts > 1 else [])
    ranks = spark.sparkContext.broadcast(rank_of)

    def coded(batches):
        for b in batches:
            out = []
            for raw, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                got = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
                out.append(encode_ranks(ranks.value[got]))
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            part = np.searchsorted(cuts, doc, side="right")
            part[np.isnan(doc)] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), b.column(0), b.column(2),
                 pa.array([c for c, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())],
                ["part", "doc_id", "n", "control", "data"])

    def stored(batches):
        name, rows, total, held, size, part = None, 0, 0, [], 0, None

        def block(f):
            docs_, n, control, data = zip(*held, strict=True)
            f.write(struct.pack(HEAD, b"BLCK", len(held), sum(map(len, control)), sum(map(len, data))))
            f.write(np.array([d or 0 for d in docs_], "<i8").tobytes())
            f.write(np.array([d is None for d in docs_], np.uint8).tobytes())
            f.write(np.array(n, "<u8").tobytes())
            f.write(b"".join(control))
            f.write(b"".join(data))
            held.clear()

        stack = None
        for b in batches:
            for p, doc, n, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if stack is None:
                    part, name = p, f"{folder}/part-{p:05d}-{uuid.uuid4().hex}.ranktok"
                    stack = writing(name)
                    f = stack.__enter__()
                    f.write(MAGIC)
                held.append((doc, n, control, data))
                rows, total, size = rows + 1, total + n, size + len(control) + len(data)
                if len(held) >= block_docs or size >= block_bytes:
                    block(f)
                    size = 0
        if stack is not None:
            if held:
                block(f)
            stack.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([rows], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([ranks_path])],
                ["part", "path", "docs", "ids", "ranks"])

    coded_rows = ids.mapInArrow(coded, "part int, doc_id long, n long, control binary, data binary")
    return staged(coded_rows.repartitionById(len(cuts) + 1, "part")
                  .sortWithinPartitions("doc_id", "n", "data")
                  .mapInArrow(stored, "part int, path string, docs long, ids long, ranks string"),
                  "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files, ``ids`` as
    little-endian unsigned 32-bit bytes, ``start`` the number of ids before it."""
    spark: SparkSession = manifest.sparkSession
    prepare_workers(spark)
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "ranks", "part",
                            F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))

    def decoded(batches):
        for b in batches:
            for path, ranks, _, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_rank = _ids_by_rank(ranks)
                with reading(path) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is no token file")
                    while head := f.read(struct.calcsize(HEAD)):
                        _, docs, control, data = struct.unpack(HEAD, head)
                        doc = np.frombuffer(f.read(8 * docs), "<i8")
                        null = np.frombuffer(f.read(docs), np.uint8).astype(bool)
                        n = np.frombuffer(f.read(8 * docs), "<i8")
                        ids = by_rank[decode_ranks(n, f.read(control), f.read(data))]
                        ends = np.cumsum(n)
                        raw = [ids[e - k:e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc, mask=null), pa.array(start + ends - n), pa.array(n),
                             pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        start += int(ends[-1])

    return (files.repartition(max(1, manifest.count()), "part")
            .mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary"))
