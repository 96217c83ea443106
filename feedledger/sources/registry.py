"""The source registry: loading it and finding what is wrong with it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CATEGORIES, REFERENCE_SOURCE, SOURCE, SOURCE_KINDS, SOURCE_STATUSES
from ..functions.urls import canonical_url
from .adapters import AdapterRegistry


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Monitored sources from JSON lines, one file per category or one for all."""
    return spark.read.schema(SOURCE).option("mode", "FAILFAST").json(path)


def read_reference_sources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REFERENCE_SOURCE).option("mode", "FAILFAST").json(path)


def _issue(name: str, message) -> list:
    return [F.lit(name).alias("check"), message.alias("message")]


def registry_issues(sources: DataFrame, references: DataFrame) -> DataFrame:
    """Row shape, declared category, and ids unique over both registries.

    Positions count per registry; monitored sources come before reference-only ones.
    """
    names = [c for c, _ in CATEGORIES]
    common = ["pos", "id", "category", "declared_in", "bad"]

    def filled(*cols: str):
        bad = F.lit(False)
        for c in cols:
            bad = bad | F.coalesce(F.col(c) == "", F.lit(True))
        return bad

    monitored = sources.withColumn("bad", filled("id", "name", "adapter") | ~F.coalesce(
        F.col("kind").isin(*SOURCE_KINDS) & F.col("status").isin(*SOURCE_STATUSES)
        & F.col("category").isin(*names) & F.col("initial_sync_from").isNotNull()
        & F.col("tags").isNotNull() & canonical_url(F.col("url")).isNotNull()
        & ~F.coalesce(F.col("release_policy.include_draft"), F.lit(False)), F.lit(False)))
    reference = references.withColumn("bad", filled("id", "name") | ~F.coalesce(
        F.col("category").isin(*names) & canonical_url(F.col("url")).isNotNull(), F.lit(False)))
    rows = (monitored.select(*common, F.lit(0).alias("listing"))
            .unionByName(reference.select(*common, F.lit(1).alias("listing")))
            .withColumn("claim", F.struct("listing", "pos", "declared_in")))

    shape = rows.where("bad").select(*_issue("source-shape", F.format_string(
        'Invalid source config in "%s" for id "%s"', F.coalesce("declared_in", F.lit("<unknown>")),
        F.coalesce("id", F.lit("<unknown>")))))
    misplaced = rows.where("NOT bad AND NOT category <=> declared_in").select(*_issue(
        "source-category", F.format_string(
            'Source "%s" declares category "%s" but is listed in the "%s" file',
            "id", "category", F.coalesce("declared_in", F.lit("<unknown>")))))
    claims = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.min("claim").alias("first"))
    # The second claim is the smallest but one; only ids claimed twice are looked up again.
    again = (rows.join(claims.where("n > 1").select("id", "first"), "id")
             .where(F.col("claim") > F.col("first")).groupBy("id", "first").agg(F.min("claim").alias("second")))
    twice = again.select(*_issue("source-duplicate-id", F.format_string(
        'Duplicate source id "%s": declared in both "%s" and "%s"', "id",
        F.coalesce("first.declared_in", F.lit("<unknown>")), F.coalesce("second.declared_in", F.lit("<unknown>")))))
    return shape.unionByName(misplaced).unionByName(twice)


def unsupported_adapters(sources: DataFrame, registry: AdapterRegistry) -> DataFrame:
    """Collectible sources whose adapter nobody registered."""
    known = sources.sparkSession.createDataFrame([(n,) for n in registry], "adapter STRING")
    return (sources.where(F.col("status") != "planned").join(known, "adapter", "left_anti")
            .select(*_issue("source-adapter", F.format_string(
                'Unsupported adapter configuration: "%s" (adapter "%s")', "id", "adapter"))))
