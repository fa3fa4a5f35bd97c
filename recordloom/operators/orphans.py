"""References to records that do not exist, kept as signed counts per key.

Every change of a table is a delta: a record that appears counts +1 existence, one that goes -1, a
reference that is made +1, one that is dropped -1. Summing deltas per key and load gives the state;
summing a state with later deltas gives the next state, in any order. Keys with references and no
existence are orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STATE = ("key", "refs", "exists", "removals", "first_load")


def reference_deltas(references: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of references (column ``target_id``); NULL targets count for nothing."""
    return references.where(F.col("target_id").isNotNull()).select(
        F.col("target_id").alias("key"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"),
        F.lit(0).cast("long").alias("removals"), F.lit(None).cast("timestamp_ntz").alias("first_load"),
    )


def existence_deltas(loads: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas of distinct records (columns ``id``, ``first_load``) that appear (+1) or go (-1).

    A record goes with the load it came with, so that the loads that are left still tell the first.
    """
    return loads.where(F.col("id").isNotNull()).select(
        F.col("id").alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exists"),
        F.lit(0).cast("long").alias("removals"), F.col("first_load").cast("timestamp_ntz").alias("first_load"),
    )


def removal_deltas(removed: DataFrame) -> DataFrame:
    """Logged deletions (column ``id``): a load and its removal cancel, and the removal is remembered."""
    return removed.where(F.col("id").isNotNull()).select(
        F.col("id").alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"),
        F.lit(1).cast("long").alias("removals"), F.lit(None).cast("timestamp_ntz").alias("first_load"),
    )


def fold(*deltas: DataFrame) -> DataFrame:
    """The state after all ``deltas``, which may themselves be earlier states: one row per key and load.

    What cancels out is dropped. The sums combine on the map side, so a key that holds a third of all
    rows moves a few rows per task.
    """
    rows = deltas[0].select(*_STATE)
    for d in deltas[1:]:
        rows = rows.unionByName(d.select(*_STATE))
    sums = rows.groupBy("key", "first_load").agg(*[F.sum(c).alias(c) for c in ("refs", "exists", "removals")])
    return sums.where((F.col("refs") != 0) | (F.col("exists") != 0) | (F.col("removals") != 0)).select(*_STATE)


def current(state: DataFrame) -> DataFrame:
    """One row per key: its counts, and the first of the loads that still exist."""
    there = F.when(F.col("exists") > 0, F.col("first_load"))
    return state.groupBy("key").agg(
        F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.sum("removals").alias("removals"), F.min(there).alias("first_load"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence, and whether they were deleted or never there."""
    return current(state).where((F.col("refs") > 0) & (F.col("exists") <= 0)).select(
        "key", "refs", F.when(F.col("removals") > 0, "deleted").otherwise("missing").alias("reason")
    )


def report(references: DataFrame, state: DataFrame, late_exempt: tuple[str, ...] = ()) -> DataFrame:
    """Each reference that leads nowhere, or to a record first loaded after the one that refers.

    ``references``: ref_table, id, field, target_id, first_load (of the referring record). ``late_exempt``
    fields may point ahead. The state comes to one row per key before the join, so a hot target skews
    only the reference side.
    """
    keys = current(state).where(F.col("refs") > 0).select(
        F.col("key").alias("target_id"), F.col("exists") > 0, F.col("removals") > 0, F.col("first_load").alias("target_load")
    ).toDF("target_id", "there", "deleted", "target_load")
    reason = (
        F.when(~F.col("there") & F.col("deleted"), "deleted")
        .when(~F.col("there"), "missing")
        .when(~F.col("field").isin(*late_exempt) & (F.col("target_load") > F.col("first_load")), "late")
    )
    return (
        references.select("ref_table", "id", "field", "target_id", "first_load").join(keys, "target_id")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ref_table", F.date_format("first_load", "yyyy-MM").alias("period"), "id", "field", "target_id", "reason")
    )
