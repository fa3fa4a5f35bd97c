"""Parent links to full hierarchies of unknown depth.

The forest is cut into fragments by ranges of the node key (time-ordered keys keep most chains inside
one fragment). Each fragment follows its chains to the node where they leave it; the nodes that other
fragments point at form a smaller quotient forest, solved the same way, and its answers are expanded
back into the fragments. Chains that never leave a fragment, or never end in a quotient, are cycles.
Quotients are cut along their links - every node goes with the nearest head above it, heads being drawn
by a coin - so that a quotient has about half the nodes or less, whatever the keys are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import stored

CYCLE = "cycle"
#: Rows of one fragment: what a single task holds in memory at once.
FRAGMENT_ROWS = 20_000
#: In a cut along links one node in so many is a head, looked for 2 ** ``HEAD_JOINS`` links up.
HEADS, HEAD_JOINS = 4, 3

_NODES = "node string, parent string, length long, weight long, base_root string, base_depth long, base_cycle boolean, seg array<string>"
_FRAGMENTS = _NODES + ", part int, exit string, dist long, root string, depth long, cyclic boolean, sub long, path array<string>"
_SOLVED = "node string, root string, depth long, cyclic boolean, total long, path array<string>"


def _chains(pdf: pd.DataFrame, paths: bool) -> dict[str, np.ndarray]:
    """Follow every parent chain inside one fragment; all arrays are aligned with ``pdf``."""
    n = len(pdf)
    node = pdf["node"].to_numpy(object)
    parent = pdf["parent"].to_numpy(object)
    up = pd.Index(node).get_indexer(pd.Index(parent, dtype=object))
    has = pdf["parent"].notna().to_numpy()
    up = np.where(has, up, -1)
    self_ = np.arange(n)
    length = pdf["length"].to_numpy(np.int64)
    jump = np.where(up >= 0, up, self_)
    dist = np.where(up >= 0, length, 0)
    hops = (up >= 0).astype(np.int64)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        dist = dist + dist[jump]
        hops = hops + hops[jump]
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    cyclic = up[jump] >= 0
    leaves = ~cyclic & (up[jump] < 0) & has[jump]
    dist = np.where(leaves, dist + length[jump], dist)
    out = {
        "up": up,
        "cyclic": cyclic | pdf["base_cycle"].to_numpy(bool)[jump] & ~leaves,
        "exit": np.where(leaves, parent[jump], None),
        "dist": np.where(cyclic, 0, dist),
        "hops": np.where(cyclic, -1, hops),
        "root": np.where(leaves | cyclic, None, pdf["base_root"].to_numpy(object)[jump]),
        "depth": np.where(leaves | cyclic, 0, dist + pdf["base_depth"].to_numpy(np.int64)[jump]),
    }
    if paths:
        seg = pdf["seg"].to_numpy(object)
        full: list = [None] * n
        for v in np.argsort(out["hops"], kind="stable"):
            if not cyclic[v]:
                # A node entered from elsewhere that is caught in a cycle of its fragment has no segment.
                full[v] = (full[up[v]] if up[v] >= 0 else []) + ([] if seg[v] is None else list(seg[v]))
        out["path"] = np.array(full + [None], object)[:-1]
    else:
        out["path"] = np.full(n, None, object)
    return out


def _subtree(weight: np.ndarray, up: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """Sum of weights at and below each node, deepest level first."""
    total = weight.astype(np.int64).copy()
    inner = np.flatnonzero((up >= 0) & (hops > 0))
    order = inner[np.argsort(-hops[inner], kind="stable")]
    cuts = np.flatnonzero(np.diff(hops[order])) + 1 if len(order) else []
    for level in np.split(order, cuts) if len(order) else []:
        np.add.at(total, up[level], total[level])
    return total


def _contract(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        got = _chains(pdf, paths)
        yield pdf.assign(
            part=TaskContext.get().partitionId(),
            sub=_subtree(pdf["weight"].to_numpy(), got["up"], got["hops"]),
            **{k: got[k] for k in ("exit", "dist", "root", "depth", "cyclic", "path")},
        )

    return run


def _expand(paths: bool):
    def run(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c.split()[0]: [] for c in _SOLVED.split(", ")})
        got = _chains(pdf, paths)
        above = outer[outer["kind"] == "exit"].set_index("node")
        inflow = outer[outer["kind"] == "entry"].set_index("node")["total"]
        extra = inflow.reindex(pdf["node"]).fillna(0).to_numpy(np.int64)
        total = _subtree(pdf["weight"].to_numpy() + extra, got["up"], got["hops"])
        k = above.index.get_indexer(pd.Index(got["exit"], dtype=object))
        out = k >= 0
        pick = lambda c, fill: np.where(out, above[c].to_numpy(object)[np.maximum(k, 0)], fill) if len(above) else fill
        cyclic = got["cyclic"] | pick("cyclic", np.full(len(pdf), False)).astype(bool)
        depth = np.where(out, got["dist"] + pick("depth", np.zeros(len(pdf))).astype(np.int64), got["depth"])
        path = got["path"]
        if paths and len(above):
            high = above["path"].to_numpy(object)
            path = [None if c else (list(high[j]) if o else []) + list(p) for c, o, j, p in zip(cyclic, out, k, path, strict=True)]
        return pd.DataFrame({"node": pdf["node"], "root": pick("root", got["root"]), "depth": depth, "cyclic": cyclic, "total": total, "path": path})

    return run


def _whole(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        pdf = pd.concat(rows, ignore_index=True)
        got = _chains(pdf, paths)
        yield pd.DataFrame({
            "node": pdf["node"], "root": got["root"], "depth": got["depth"], "cyclic": got["cyclic"],
            "total": _subtree(pdf["weight"].to_numpy(), got["up"], got["hops"]), "path": got["path"],
        })

    return run


def _headed(nodes: DataFrame, level: int) -> DataFrame:
    """Add ``head``: the nearest head at or above each node, or as far up as the joins reach.

    Joins meet a node key that is unique on the right, so a hot parent only makes the left side skewed,
    which adaptive execution splits.
    """
    coin = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(HEADS)) == 0
    state = stored(nodes.select("node", F.when(coin | F.col("parent").isNull(), F.col("node")).otherwise(F.col("parent")).alias("head")))
    for _ in range(HEAD_JOINS):
        above = state.select(F.col("node").alias("head"), F.col("head").alias("further"))
        state = stored(state.join(above, "head", "left").select("node", F.coalesce("further", "head").alias("head")))
    return nodes.join(state, "node")


def _solve(nodes: DataFrame, n: int, fragment_rows: int, paths: bool, level: int = 0, sizes: list[int] | None = None) -> DataFrame:
    if sizes is not None:
        sizes.append(n)
    if n <= fragment_rows:
        return nodes.repartition(1).mapInPandas(_whole(paths), _SOLVED)
    parts = math.ceil(n / fragment_rows)
    # The nodes of a hot head spread over as many fragments as they fill.
    cut = nodes.repartitionByRange(parts, "node") if level == 0 else _headed(nodes, level).repartitionByRange(parts, "head", "node").drop("head")
    frag = stored(cut.mapInPandas(_contract(paths), _FRAGMENTS))
    tops = frag.where(F.col("exit").isNotNull())
    # The chain's last node inside the fragment is the one whose own parent is the exit.
    inflow = tops.where(F.col("parent") == F.col("exit")).groupBy(F.col("exit").alias("node")).agg(F.sum("sub").alias("inflow"))
    quotient = stored(
        frag.drop("weight").join(inflow, "node").select(
            "node", F.col("exit").alias("parent"), F.col("dist").alias("length"), F.col("inflow").alias("weight"),
            F.col("root").alias("base_root"), F.col("depth").alias("base_depth"), F.col("cyclic").alias("base_cycle"),
            F.col("path").alias("seg"), "part",
        )
    )
    solved = stored(_solve(quotient.drop("part"), quotient.count(), fragment_rows, paths, level + 1, sizes))
    # Fragments ask once per distinct exit, however many of their nodes leave through it.
    asked = tops.select("part", F.col("exit").alias("node")).distinct()
    outer = (
        asked.join(solved, "node").withColumn("kind", F.lit("exit"))
        .unionByName(quotient.select("node", "part").join(solved, "node").withColumn("kind", F.lit("entry")))
    )
    inner = frag.select(*[c.split()[0] for c in _NODES.split(", ")], "part")
    return inner.groupBy("part").cogroup(outer.withColumnRenamed("part", "of").select("*", F.col("of").alias("to")).groupBy("to")).applyInPandas(_expand(paths), _SOLVED)


def resolve_hierarchy(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS, paths: bool = False, sizes: list[int] | None = None) -> DataFrame:
    """Root, depth, number of descendants and (with ``paths``) full path of every linked node.

    ``links`` has ``node`` and ``parent`` (strings; other columns are ignored). Rows with a NULL node or
    parent are no links; repeated links count once; of several parents the smallest key is used and the
    others stand alone. A node
    whose way up never ends gets root ``cycle``, depth and descendants -1 and a NULL path. A node that is
    only a parent is a root. No links give no rows. ``sizes``, if given, gets the nodes of each level.
    """
    one = links.select(F.col("node").cast("string"), F.col("parent").cast("string")).where(F.col("node").isNotNull() & F.col("parent").isNotNull())
    both = one.unionByName(one.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    nodes = stored(
        both.groupBy("node").agg(F.min("parent").alias("parent")).select(
            "node", "parent", F.lit(1).cast("long").alias("length"), F.lit(1).cast("long").alias("weight"), F.col("node").alias("base_root"),
            F.lit(0).cast("long").alias("base_depth"), F.lit(False).alias("base_cycle"),
            (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("seg"),
        )
    )
    got = _solve(nodes, nodes.count(), fragment_rows, paths, sizes=sizes)
    bad = F.col("cyclic")
    return got.select(
        "node", F.when(bad, F.lit(CYCLE)).otherwise(F.col("root")).alias("root"), F.when(bad, F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        F.when(bad, F.lit(-1)).otherwise(F.col("total") - 1).cast("int").alias("descendants"), F.when(~bad, F.col("path")).alias("path"),
    )


def closure(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs from paths; members of cycles have none."""
    up = resolved.where(F.col("path").isNotNull()).select("node", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return up.where(F.col("pos") < F.col("n") - 1).select("ancestor", F.col("node").alias("descendant"), (F.col("n") - 1 - F.col("pos")).alias("distance"))
