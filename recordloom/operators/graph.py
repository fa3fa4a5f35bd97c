"""Typed links between records: edges, bounded expansion from seeds, chains and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators import hierarchy
from recordloom.runtime import canonical_id, stored

# The link fields in their default order.
EDGE_TYPES = ("refines", "supports", "depends_on", "conflicts_with", "supersedes", "superseded_by")
MAX_DEPTH, MAX_RESULTS, CHAIN_DEPTH = 3, 50, 3


def edges_view(records: DataFrame, edge_types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """(src, edge_type, edge_pos, arr_pos, dst) of every link; blank and NULL targets are none."""
    none = F.array().cast("array<string>")

    def one(pos: int, name: str):
        values = F.array(name) if name == "superseded_by" else F.coalesce(name, none)
        return F.transform(
            values, lambda x,
            i: F.struct(F.lit(name).alias("edge_type"), F.lit(pos).alias("edge_pos"), i.alias("arr_pos"), canonical_id(x).alias("dst")),
        )

    each = records.select(F.col("id").alias("src"), F.explode(F.concat(*[one(i, t) for i, t in enumerate(edge_types)])).alias("e"))
    return each.select("src", "e.*").where(F.col("dst").isNotNull())


def expand_graph(seeds: DataFrame, edges: DataFrame, depth: int = 1, cap: int = MAX_RESULTS) -> DataFrame:
    """(id, from_id, edge_type, hops, pos): breadth-first outward walk in queue order.

    ``seeds``: id, pos. Each record is reached once, from the first way a queue would take; unknown
    targets are listed too. Results past ``cap`` cannot change earlier ones, so every frontier is cut
    to what is still wanted and stays that small.
    """
    spark = seeds.sparkSession
    visited = seeds.select("id")
    frontier = seeds.select("id", F.col("pos").cast("long").alias("pos"), F.col("id").alias("seed"))
    schema = "id string, from_id string, edge_type string, hops int, pos long"
    out, taken = spark.createDataFrame([], schema), 0
    for hop in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        way = edges.join(frontier.withColumnRenamed("id", "src"), "src").join(visited.withColumnRenamed("id", "dst"), "dst", "left_anti")
        first = way.groupBy("dst").agg(F.min(F.struct("pos", "edge_pos", "arr_pos", "seed", "edge_type")).alias("f"))
        cut = first.orderBy("f.pos", "f.edge_pos", "f.arr_pos", "dst").limit(cap - taken)
        # At most ``cap`` rows: numbering them in one task is bounded.
        step = cut.select(
            F.col("dst").alias("id"), F.col("f.seed").alias("from_id"), F.col("f.edge_type").alias("edge_type"), F.lit(hop).alias("hops"),
            F.row_number().over(Window.orderBy("f.pos", "f.edge_pos", "f.arr_pos", "dst")).cast("long").alias("pos"),
        )
        step = stored(step)
        out = out.unionByName(step.withColumn("pos", F.col("pos") + taken))
        taken += step.count()
        if taken >= cap or step.isEmpty():
            break
        visited = visited.union(step.select("id"))
        frontier = step.select("id", "pos", F.col("from_id").alias("seed"))
    return out


def relation_chain(records: DataFrame, field: str, depth: int = CHAIN_DEPTH) -> DataFrame:
    """(id, target, hops): for every record the known records within ``depth`` links of one type.

    Unknown targets are neither listed nor walked through; the record itself is never listed.
    """
    ids = records.select(F.col("id").alias("dst")).distinct()
    edges = stored(edges_view(records, (field,)).select("src", "dst").distinct().join(ids, "dst", "left_semi").where(F.col("src") != F.col("dst")))
    reach = edges.select(F.col("src").alias("id"), F.col("dst").alias("target"), F.lit(1).alias("hops"))
    step = reach
    for hop in range(2, depth + 1):
        step = step.select("id", F.col("target").alias("src")).join(edges, "src").select(
            "id", F.col("dst").alias("target"), F.lit(hop).alias("hops"),
        ).where(F.col("id") != F.col("target"))
        step = stored(step.distinct())
        reach = reach.unionByName(step)
    return reach.groupBy("id", "target").agg(F.min("hops").alias("hops"))


def _one_each(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, rest): of every record its smallest link, and the links beside it."""
    first = edges.groupBy("src").agg(F.min("dst").alias("dst"))
    return first, edges.join(first, ["src", "dst"], "left_anti")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): every record reachable over any number of links.

    Links of which every record has one at most form trees, whose paths the hierarchy operator gives.
    From there a frontier of newly reached pairs walks the links that are no part of the trees, and
    every pair it finds brings the tree above its end along. Cycles close without repeating.
    """
    links = stored(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    first, rest = _one_each(links)
    solved = stored(hierarchy.resolve_hierarchy(first.select(F.col("src").alias("node"), F.col("dst").alias("parent")), paths=True))
    above = stored(hierarchy.closure(solved).select(F.col("descendant").alias("src"), F.col("ancestor").alias("dst")))
    # What the trees do not carry: second links, and the links of records caught in cycles.
    caught = solved.where(F.col("root") == hierarchy.CYCLE).select(F.col("node").alias("src"))
    rest = stored(rest.unionByName(first.join(caught, "src", "left_semi")).distinct())
    reach = above
    if rest.isEmpty():
        return reach
    up = above.unionByName(above.select(F.col("src"), F.col("src").alias("dst")).distinct()).unionByName(links.select(F.col("dst").alias("src"), "dst").distinct()).distinct()
    up = stored(up)
    # One step: a link beside the trees, then everything above its end.
    step = stored(rest.select("src", F.col("dst").alias("mid")).join(up.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct())
    reach = stored(above.unionByName(step).distinct())
    fresh = reach
    while not fresh.isEmpty():
        further = fresh.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = stored(further.join(reach, ["src", "dst"], "left_anti"))
        reach = reach.unionByName(fresh)
    return reach.where(F.col("src") != F.col("dst"))


def reachable(records: DataFrame, field: str) -> DataFrame:
    """(src, dst): every known record that each record leads to over links of one field."""
    ids = records.select(F.col("id").alias("dst")).distinct()
    return closure(edges_view(records, (field,)).select("src", "dst").join(ids, "dst", "left_semi"))


def lineage(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ancestors, descendants): records replaced by each record, and records that replace it.

    Ancestors follow ``supersedes``, descendants ``superseded_by``, both among known records only.
    """
    return reachable(records, "supersedes").toDF("id", "ancestor"), reachable(records, "superseded_by").toDF("id", "descendant")


def with_lineage(records: DataFrame) -> DataFrame:
    """Records with ancestors, descendants and the chains of refines, supports and depends_on as sorted
    lists in place of the links; empty where there are none."""
    before, after = lineage(records)
    ways = {"ancestors": before.toDF("id", "x"), "descendants": after.toDF("id", "x")}
    ways |= {f: relation_chain(records, f).select("id", F.col("target").alias("x")) for f in ("refines", "supports", "depends_on")}
    out = records.drop("refines", "supports", "depends_on")
    for name, pairs in ways.items():
        out = out.join(
            pairs.groupBy("id").agg(F.sort_array(F.collect_set("x")).alias(name)), "id", "left",
        ).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
