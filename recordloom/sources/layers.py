"""Several stores as one: collisions inside a store and precedence between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each id; equal ones are told apart by their content.

    A task keeps one row an id before anything is shuffled: the planner limits the window's groups there.
    """
    content = F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))])
    each = Window.partitionBy("id").orderBy(*order, content)
    return rows.where(F.col("id").isNotNull()).withColumn("_n", F.row_number().over(each)).where("_n = 1").drop("_n")


def resolve_collisions(rows: DataFrame) -> DataFrame:
    """One row per id: a file in the area kept by people wins, then the live store, then the first load."""
    return _first(rows, F.coalesce(F.col("file_path").contains("/operator/"), F.lit(False)).desc(), F.desc("ref_table"), F.col("loaded_at"))


def layered(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """One row per id from the layer of highest priority; rows of unknown layers come last."""
    ranked = rows.join(layers.select(F.col("name").alias("layer"), "priority"), "layer", "left")
    return _first(ranked, F.desc_nulls_last("priority"), F.col("layer"), F.col("loaded_at")).drop("priority")


def listing(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """(name, path, priority, mode, items): every layer with the number of its distinct records."""
    n = rows.select("layer", "id").where(F.col("id").isNotNull()).distinct().groupBy(F.col("layer").alias("name")).agg(F.count(F.lit(1)).alias("items"))
    return layers.join(n, "name", "left").select(
        "name", "path", "priority", F.when(F.col("writable"), "rw").otherwise("ro").alias("mode"),
        F.coalesce("items", F.lit(0)).alias("items"),
    )
