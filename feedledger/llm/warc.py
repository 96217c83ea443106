"""WARC in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends in a seek table (a skippable frame
with each frame's compressed and plain size, in the published seekable format), and an index
table maps each record to its bundle, frame and place in the frame.
"""

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .files import reading, writing
from .shared import new_folder, prepare_workers, staged

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                    ("offset", pa.int64()), ("length", pa.int64())])
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None):
    number = record_id[len("<urn:page:"):-1] if record_id else "none"
    return None if number == "none" else int(number)


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, keeper, revisit: bool) -> bytes:
    """One record; a revisit carries the length and digest of its payload but not itself."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
             "Content-Type: text/html;charset=utf-8"]
    if url is not None:
        # A field is one line: what would end it is percent-encoded, reversibly.
        lines.insert(3, "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(keeper)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""])
    return head.encode() + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields, as RECORD names them."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    url, revisit = fields.get("WARC-Target-URI"), fields["WARC-Type"] == "revisit"
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    payload = rest[:int(fields["Content-Length"])]
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": url, "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["WARC-Payload-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": _page_of(fields.get("WARC-Refers-To")) if revisit else None,
            "payload": None if revisit else payload}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, plain size)`` of each frame, from the end of a bundle."""
    end = f.seek(0, 2)
    f.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    f.seek(end - 9 - 8 * n)
    raw, at, out = f.read(8 * n), 0, []
    for compressed, plain in struct.iter_unpack("<II", raw):
        out.append((at, compressed, plain))
        at += compressed
    return out


def write_warc(pages: DataFrame, folder: str | None = None, *, id_column: str = "page_id",
               url_column: str = "url", html_column: str = "html", minimum: int = 0,
               frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Write all pages into bundles, one per task; the result is the index table.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at
    least ``minimum`` bytes, that with the largest page id is the response and the others
    revisit it. Only payloads that occur more than once are looked up, by digest. A frame
    closes at ``frame_bytes``, so a task holds one frame and one record. Each attempt of a
    task writes a bundle of its own; the index names those of tasks that ended well.

    A page without an id revisits one with an id, else it is a response; rows with an equal
    id and payload that share the largest id are responses each. Empty tables give no bundle.
    """
    spark = pages.sparkSession
    prepare_workers(spark)
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"),
                        F.col(url_column).cast("string").alias("url"),
                        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = rows.where(F.octet_length("html") >= minimum).groupBy("digest").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(staged(repeated, "repeated"), "digest", "left")

    def bundled(batches):
        stack, name, sizes, index, frame = None, None, [], [], bytearray()
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)

        def close(f):
            packed = packer.compress(bytes(frame))
            f.write(packed)
            sizes.append((len(packed), len(frame)))
            frame.clear()

        def indexed():
            columns = list(zip(*index, strict=True)) or [[] for _ in _INDEX]
            index.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(columns, _INDEX, strict=True)], schema=_INDEX)

        for b in batches:
            for page, url, html, keeper in zip(*b.columns, strict=True):
                if stack is None:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
                    stack = writing(name)
                    f = stack.__enter__()
                page, keeper, payload = page.as_py(), keeper.as_py(), html.as_py().encode()
                revisit = keeper is not None and keeper != page
                raw = record_bytes(page, url.as_py(), payload, len(payload), base32_sha1(payload), keeper, revisit)
                if frame and len(frame) + len(raw) > frame_bytes:
                    close(f)
                index.append((page, name, len(sizes), len(frame), len(raw)))
                frame += raw
            yield indexed()
        if stack is not None:
            close(f)
            f.write(seek_table(sizes))
            stack.__exit__(None, None, None)

    return staged(marked.select("page_id", "url", "html", "keeper").mapInArrow(bundled, INDEX), "warc-index")


def read_warc(index: DataFrame, *, payloads: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """The records that an index names (RECORD), each frame read once per task.

    An index cut down to some page ids reads only their frames. Without ``payloads`` the
    column ``payload`` is null, after its digest has been checked.
    """
    prepare_workers(index.sparkSession)

    def records(batches):
        opened, table, stack, f, at, plain = None, [], None, None, None, b""
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for _, bundle, frame, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != opened:
                    if stack is not None:
                        stack.__exit__(None, None, None)
                    opened, stack, at = bundle, reading(bundle), None
                    f = stack.__enter__()
                    table = read_seek_table(f)
                if frame != at:
                    start, size, whole = table[frame]
                    f.seek(start)
                    plain, at = unpacker.decompress(f.read(size), max_output_size=whole), frame
                got = parse_record(plain[offset:offset + length])
                if got["payload"] is not None and base32_sha1(got["payload"]) != got["payload_digest"]:
                    raise ValueError(f"payload of page {got['page_id']} in {bundle} is damaged")
                if not payloads:
                    got["payload"] = None
                out.append(got)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                 for n, t in (c.split() for c in RECORD.split(", "))]))
        if stack is not None:
            stack.__exit__(None, None, None)

    # The index is small next to what it names, so the number of tasks goes by the latter.
    size = index.agg(F.sum("length")).first()[0] or 0
    return (index.repartition(1 + size // task_bytes, F.col("bundle"), F.floor(F.col("frame") / 8))
            .sortWithinPartitions("bundle", "frame", "offset").mapInArrow(records, RECORD))
