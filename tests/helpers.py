"""Small tables for tests."""

from pyspark.sql import SparkSession, functions as F

from feedledger import schemas as S
from feedledger.functions.text import item_id

NOW = "2026-02-01 00:00:00"


def one(spark: SparkSession, *columns):
    return spark.range(1).select(*columns).first()


def column_values(spark, values, make, dtype="string"):
    """``make(col)`` for every value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, v {dtype}")
    return [r["out"] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def sources(spark, *rows):
    """Source rows from dicts; unset fields get plain defaults."""
    base = dict(category="web-core", kind="feed", adapter="feed", initial_sync_from="2026-01-01",
                status="active", filters=None, tags=[], prerelease=False)
    out = []
    for pos, row in enumerate(rows):
        r = {**base, **row}
        out.append((pos, r["id"], r.get("name", r["id"]), r["category"], r["kind"],
                    r.get("url", f"https://example.com/{r['id']}/feed"), r["adapter"],
                    r["initial_sync_from"], r["status"], r["filters"],
                    (r["prerelease"], False), r["tags"], r.get("declared_in", r["category"])))
    schema = ("pos INT, id STRING, name STRING, category STRING, kind STRING, url STRING, "
              "adapter STRING, initial_sync_from STRING, status STRING, filters STRING, "
              "release_policy STRUCT<include_prerelease: BOOLEAN, include_draft: BOOLEAN>, "
              "tags ARRAY<STRING>, declared_in STRING")
    return spark.createDataFrame(out, schema).withColumn(
        "initial_sync_from", F.to_date("initial_sync_from"))


def references(spark, *rows):
    return spark.createDataFrame(list(rows), S.REFERENCE_SOURCE)


def payloads(spark, *rows):
    """Payload rows ``(source_id, body)`` or ``(source_id, body, status[, url])``."""
    out = []
    for seq, row in enumerate(rows):
        source, body, status, url = (*row, *(200, None)[len(row) - 2:])
        out.append((source, url or f"https://example.com/{source}/feed", status, NOW, body, seq))
    return spark.createDataFrame(
        out, "source_id STRING, url STRING, http_status INT, fetched_at STRING, body STRING, "
             "seq BIGINT").withColumn("fetched_at", F.to_timestamp("fetched_at"))


def items(spark, *rows):
    """Items from dicts with at least a ``key``; its hash is the id unless ``id`` is set."""
    out = []
    for seq, r in enumerate(rows):
        out.append((r.get("id"), r.get("key", "k"), r.get("source_id", "s"), r.get("heading", "A heading"),
                    r.get("label", "Release"), r.get("link", "https://example.com/x"),
                    r.get("date", "2026-01-31"), r.get("date_basis", "published"),
                    r.get("category", "web-core"), r.get("tags", []), r.get("seq", seq)))
    df = spark.createDataFrame(
        out, "id STRING, key STRING, source_id STRING, heading STRING, label STRING, link STRING, "
             "date STRING, date_basis STRING, category STRING, tags ARRAY<STRING>, seq BIGINT")
    return (df.withColumn("id", F.coalesce("id", item_id(F.col("key")))).drop("key")
            .withColumn("date", F.to_date("date")))


def states(spark, *rows):
    """State rows ``(id, state, updated_at, read_at, ignored_at)`` with text times."""
    df = spark.createDataFrame(
        [tuple((*r, None, None, None, None)[:5]) for r in rows],
        "id STRING, state STRING, updated_at STRING, read_at STRING, ignored_at STRING")
    for name in ("updated_at", "read_at", "ignored_at"):
        df = df.withColumn(name, F.to_timestamp(name))
    return df


def rss(*entries):
    """An RSS document of ``(title, link, pub_date or None)`` entries."""
    body = "".join(
        f"<item><title>{t}</title><link>{k}</link>"
        + (f"<pubDate>{d}</pubDate>" if d else "") + "</item>" for t, k, d in entries)
    return f'<?xml version="1.0"?>\n<rss version="2.0"><channel><title>x</title>{body}</channel></rss>'
