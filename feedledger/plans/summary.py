"""The text a run leaves behind, and canonical exports."""

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def failure_lines(outcomes: DataFrame) -> DataFrame:
    """One line per failed source, in registry order."""
    return (outcomes.where("outcome = 'failed'").orderBy("pos")
            .select("pos", "source_id", F.format_string("  FAILED  %s: %s", "source_id", "reason").alias("line")))


def run_summary(failures: DataFrame, cleanup_counts: DataFrame, run: Row, shown: int = 1000) -> str:
    """Summary of a run with exact counts; all ``failures`` are a table of the run, the text
    for people lists the first ``shown``."""
    c, gone = run["coverage"], cleanup_counts.first()
    lines = [f"Collection run: {c['succeeded']} succeeded, {c['failed']} failed, "
             f"{c['planned']} planned, {c['added']} added"]
    lines += [r["line"] for r in failures.orderBy("pos").take(shown)]
    if c["failed"] > shown:
        lines.append(f"  ({c['failed'] - shown} more in the table of failures)")
    if gone["pruned"] + gone["scrubbed"] + gone["expired"] > 0:
        lines.append(f"Cleanup: {gone['pruned']} tombstone(s) pruned, {gone['scrubbed']} re-added "
                     f"ignored item(s) scrubbed, {gone['expired']} read item(s) expired")
    if run["rejected"]:
        lines.append(f"REJECTED: {run['rejected']['reason']} — {run['rejected']['detail']}")
        lines.append("Items left untouched; only the run status was written.")
    return "\n".join(lines)


def _key_sorted(value: Column, kind: DataType) -> Column:
    """A value with the keys of its structs and maps sorted, at any depth."""
    if isinstance(kind, StructType):
        fields = [_key_sorted(value.getField(f.name), f.dataType).alias(f.name)
                  for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            e["key"].alias("key"), _key_sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _key_sorted(x, kind.elementType))
    return value


def canonical_json(rows: DataFrame) -> Column:
    """A row as JSON with its keys sorted, nested ones as well; equal rows give equal text."""
    return F.to_json(F.struct(*[_key_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                                for f in sorted(rows.schema.fields, key=lambda f: f.name)]))


def export_json(rows: DataFrame, order: list[str], path: str) -> None:
    """Totally ordered JSON lines, one file per range; unchanged data gives equal files."""
    (rows.orderBy(*order).select(canonical_json(rows).alias("value"))
     .write.mode("overwrite").text(path))


def content_digest(rows: DataFrame) -> DataFrame:
    """Row count and an order-independent digest, for a no-difference test."""
    digest = F.xxhash64(canonical_json(rows))
    return rows.agg(F.count("*").alias("n"), F.bit_xor(digest).alias("digest"),
                    F.sum(F.pmod(digest, F.lit(1_000_003))).alias("total"))
