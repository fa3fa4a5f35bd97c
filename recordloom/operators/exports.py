"""The record graph as nodes and edges, and as JSON lines, GraphML and DOT text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions.text import escape_dot, escape_xml
from recordloom.operators.graph import edges_view

TYPES = ("fact", "decision", "procedure")
# How nodes and edges are drawn.
NODE_STYLE = {"fact": ("box", "blue"), "decision": ("diamond", "orange"), "procedure": ("ellipse", "green"), None: ("octagon", "gray")}
EDGE_STYLE = {
    "supersedes": ("red", "dashed", None), "conflicts_with": ("orange", "dotted", None), "refines": ("blue", None, None),
    "supports": ("green", None, None), "depends_on": ("purple", None, None), "anchors_to": ("gray", None, "0.5"),
}


def projected(records: DataFrame, include_superseded: bool = False, types: tuple[str, ...] = TYPES) -> DataFrame:
    states = ("active", "superseded") if include_superseded else ("active",)
    return records.where(F.col("type").isin(*types) & F.col("state").isin(*states))


def nodes(chosen: DataFrame) -> DataFrame:
    """One row per record, and one per distinct anchored file."""
    text = lambda: F.lit(None).cast("string")
    rows = chosen.select(
        F.col("id"), F.lit("memory").alias("node_type"), "type", F.coalesce("title", F.lit("")).alias("title"), R.effective_source_kind().alias("source_kind"), R.witness_of().alias("verified_with"),
        F.coalesce("stale", F.lit(False)).alias("stale"), "state", text().alias("path"),
    )
    files = chosen.select(F.explode("anchors").alias("a")).select(F.col("a.file").alias("path")).where(F.col("path").isNotNull()).distinct()
    return rows.unionByName(files.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("node_type"), text().alias("type"), text().alias("title"),
        text().alias("source_kind"), text().alias("verified_with"), F.lit(None).cast("boolean").alias("stale"), text().alias("state"),
        "path",
    ))


def edges(chosen: DataFrame, include_superseded: bool = False) -> DataFrame:
    """(src, dst, edge_type): links whose target is chosen too, and links to anchored files; each once."""
    kinds = ("refines", "supports", "depends_on", "conflicts_with", *(("supersedes",) if include_superseded else ()))
    links = edges_view(chosen, kinds).join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type")
    files = chosen.select(F.col("id").alias("src"), F.explode("anchors").alias("a")).where(F.col("a.file").isNotNull()).select(
        "src", F.concat(F.lit("file:"), "a.file").alias("dst"), F.lit("anchors_to").alias("edge_type"),
    )
    return links.unionByName(files).distinct()


def jsonl(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, key, line): one JSON object per node, then per edge, keys in a fixed order."""
    memory = F.to_json(F.struct(F.lit("node").alias("kind"), "node_type", "id", "type", "title", "source_kind", "verified_with", "stale", "state"))
    file = F.to_json(F.struct(F.lit("node").alias("kind"), "node_type", "id", "path"))
    a = node_rows.select(F.lit("node").alias("kind"), F.col("id").alias("key"), F.when(F.col("node_type") == "file", file).otherwise(memory).alias("line"))
    b = edge_rows.select(
        F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst", "edge_type").alias("key"),
        F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("edge_type").alias("type"))).alias("line"),
    )
    return a.unionByName(b)


def graphml(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, key, line): the GraphML element of each node and edge; ``document`` adds the frame."""
    datum = lambda key, value: F.concat(F.lit(f'<data key="{key}">'), escape_xml(value), F.lit("</data>"))
    memory = F.concat(*[datum(k, v) for k, v in (("node_type", F.lit("memory")), ("memory_type", F.col("type")), ("title", F.col("title")), ("source_kind", F.col("source_kind")), ("verified_with", F.col("verified_with")), ("stale", F.col("stale").cast("string")), ("state", F.col("state")))])
    file = F.concat(datum("node_type", F.lit("file")), datum("path", F.col("path")))
    inner = F.when(F.col("node_type") == "file", file).otherwise(memory)
    a = node_rows.select(
        F.lit("node").alias("kind"), F.col("id").alias("key"),
        F.concat(F.lit('<node id="'), escape_xml(F.col("id")), F.lit('">'), inner, F.lit("</node>")).alias("line"),
    )
    # Ids come from content, so they need no global numbering.
    key = F.concat_ws("|", "src", "dst", "edge_type")
    b = edge_rows.select(
        F.lit("edge").alias("kind"), key.alias("key"),
        F.concat(
            F.lit('<edge id="e'), F.substring(F.sha1(key), 1, 16), F.lit('" source="'), escape_xml(F.col("src")), F.lit('" target="'),
            escape_xml(F.col("dst")), F.lit('">'), datum("edge_type", F.col("edge_type")), F.lit("</edge>"),
        ).alias("line"),
    )
    return a.unionByName(b)


def _attributes(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f'{k}="'), escape_dot(v), F.lit('"'))) for k, v in pairs])), ", ")


def dot(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, key, line): the DOT statement of each node and edge; ``document`` adds the frame."""
    style = lambda i: R.lookup(F.coalesce("type", F.lit("")), {k or "": v[i] for k, v in NODE_STYLE.items()})
    memory = F.col("node_type") == "memory"
    looks = F.when(
        memory,
        F.concat(F.lit("rounded"), F.when(F.col("stale"), ",dashed").otherwise(""), F.when(F.col("state") == "superseded", ",filled").otherwise("")),
    )
    fill = F.when(memory & (F.col("state") == "superseded"), "lightgray")
    attrs = _attributes([
        ("label", F.when(memory, F.col("title")).otherwise(F.col("path"))), ("shape", style(0)), ("color", style(1)), ("style", looks),
        ("fillcolor", fill),
    ])
    a = node_rows.select(
        F.lit("node").alias("kind"), F.col("id").alias("key"),
        F.concat(F.lit('"'), escape_dot(F.col("id")), F.lit('" ['), attrs, F.lit("];")).alias("line"),
    )
    pick = lambda i: R.lookup(F.col("edge_type"), {k: v[i] for k, v in EDGE_STYLE.items() if v[i]})
    attrs = _attributes([("label", F.col("edge_type")), ("color", pick(0)), ("style", pick(1)), ("penwidth", pick(2))])
    b = edge_rows.select(
        F.lit("edge").alias("kind"), F.concat_ws("|", "src", "dst", "edge_type").alias("key"),
        F.concat(F.lit('"'), escape_dot(F.col("src")), F.lit('" -> "'), escape_dot(F.col("dst")), F.lit('" ['), attrs, F.lit("];")).alias("line"),
    )
    return a.unionByName(b)


def document(lines: DataFrame, form: str) -> DataFrame:
    """(part, value): the lines in order under a frame; write it sorted by part, or as a directory of parts."""
    head, foot = {
        "jsonl": ([], []),
        "graphml": (
            ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">'],
            ["</graph>", "</graphml>"],
        ),
        "dot": (["digraph records {", "rankdir=LR;"], ["}"]),
    }[form]
    spark = lines.sparkSession
    frame = lambda part, text: spark.createDataFrame([(part, "", t) for t in text], "part int, key string, value string")
    body = lines.select(F.when(F.col("kind") == "node", 1).otherwise(2).alias("part"), "key", F.col("line").alias("value"))
    return frame(0, head).unionByName(body).unionByName(frame(3, foot)).orderBy("part", "key")
