"""Joins shaped by how large their sides really are.

Two situations recur: many facts against a per-source dimension where one source may
own a third of the facts, and a small batch against a table that holds everything. Neither
counts a side beforehand: sides that Catalyst or AQE sees to be small are broadcast, below
the session's threshold in bytes, and the plans stay right where they are not.
"""

from pyspark.sql import DataFrame, functions as F

#: Copies of a lookup side; a hot key is spread over as many tasks if it is not broadcast.
SALTS = 16


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str,
                spread: list[str], salts: int = SALTS) -> DataFrame:
    """Facts against a per-source table, a hot key split over ``salts`` tasks.

    Facts get a salt from a hash of ``spread`` (deterministic, so a retried task agrees
    with itself); every lookup row is repeated once per salt. A small lookup is broadcast
    all the same, and then the facts are not moved.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def not_in_history(batch: DataFrame, history: DataFrame, on: list[str]) -> DataFrame:
    """Batch rows whose key the history does not hold.

    The history is first reduced to the batch's keys: a small batch is broadcast to it, so
    the large table is filtered where it lies; a large one meets it in a shuffle on the key
    that the anti join then uses again. The batch is read twice, so stage it if it is dear.
    """
    met = history.select(*on).join(batch.select(*on), on, "left_semi").distinct()
    return batch.join(met, on, "left_anti")
