"""All similar pairs between set-valued records, exactly, by pigeonhole partitioning.

Two sets of lengths a <= b that reach the threshold differ in at most H(a, b) tokens. The universe is
split by hashing into segments whose number depends on a. If every segment i has a budget e_i of -1
(unused), 0 (must match) or 1 (one deletion apart) and the e_i + 1 sum to more than H, one segment of a
similar pair stays within its budget. Every set is held under its whole segments and their one-deletion
forms; as the longer side it asks, choosing the budgets that avoid frequent tokens. A segment without
tokens looks the same in every set, so its key is asked only where nothing else is left, and held only
if some set asks for it. Candidates are verified on their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import stored

#: Tokens in more than this share of all token occurrences are known to be frequent when segments are
#: chosen; there are at most 1 / HOT_SHARE of them, so the list the tasks get is bounded.
HOT_SHARE = 1 / 5000
#: Cost of a key without tokens, in units of the most that other keys can cost.
_LAST_RESORT = 1000.0
LEFT, RIGHT, BOTH = 1, 2, 3


def most_differing(a: int, b: int, threshold: float) -> int:
    """Largest symmetric difference of sets of these lengths at or above the threshold."""
    return a + b - 2 * math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def segments(a: int, threshold: float) -> int:
    """Number of segments for pairs whose shorter set has length ``a``: one more than deletions need."""
    longest = int(a / threshold + 1e-9)
    return max(most_differing(a, b, threshold) for b in range(a, longest + 1)) // 2 + 2


def cheapest(whole: np.ndarray, single: np.ndarray, need: int) -> np.ndarray:
    """e_i per set and segment (sets x segments) with sum(e_i + 1) >= need at least cost."""
    n, m = whole.shape
    cost = np.full((need + 1, n), np.inf)
    cost[0] = 0.0
    picks, comes = [], []
    for i in range(m):
        after, pick, come = cost.copy(), np.full((need + 1, n), -1, np.int8), np.tile(np.arange(need + 1)[:, None], (1, n))
        for got in range(need + 1):
            for e, price in ((0, whole[:, i]), (1, single[:, i])):
                k = min(need, got + e + 1)
                better = cost[got] + price < after[k]
                after[k] = np.where(better, cost[got] + price, after[k])
                pick[k][better], come[k][better] = e, got
        cost = after
        picks.append(pick)
        comes.append(come)
    out, at, every = np.empty((n, m), np.int8), np.full(n, need), np.arange(n)
    for i in reversed(range(m)):
        out[:, i] = picks[i][at, every]
        at = comes[i][at, every]
    return out


def budgets(whole: list[float], single: list[float], need: int) -> list[int]:
    """``cheapest`` for one set."""
    return cheapest(np.array([whole]), np.array([single]), need)[0].tolist()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Parts:
    """Sets of one length, cut into the segments of layout ``a``."""

    def __init__(self, hashes: np.ndarray, a: int, m: int):
        n, b = hashes.shape
        self.of = (hashes % np.uint64(m)).astype(np.int64)
        self.sums, self.count = np.zeros((n, m), np.uint64), np.zeros((n, m), np.int64)
        every = np.arange(n)
        for j in range(b):
            self.sums[every, self.of[:, j]] += hashes[:, j]
            self.count[every, self.of[:, j]] += 1
        self.seeds = _mix((np.uint64(a) << np.uint64(20)) + (np.arange(m, dtype=np.uint64) << np.uint64(1)) + np.uint64(1))
        self.every, self.hashes = every, hashes

    def whole(self, i: int) -> np.ndarray:
        return self.sums[:, i] ^ self.seeds[i]

    def without(self, j: int) -> np.ndarray:
        """The segment of token ``j`` without it."""
        return (self.sums[self.every, self.of[:, j]] - self.hashes[:, j]) ^ self.seeds[self.of[:, j]]


def _by_length(pdf: pd.DataFrame, hashes: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(places, hashes, tokens) of the sets of each length."""
    lengths = pdf["tokens"].map(len).to_numpy()
    for b in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == b)
        tokens = [pdf["tokens"].iloc[k] for k in at]
        for ts in tokens:
            for t in ts:
                if t not in hashes:
                    hashes[t] = xxhash.xxh64_intdigest(t)
        yield at, np.array([[hashes[t] for t in ts] for ts in tokens], np.uint64), tokens


def _rows(pdf: pd.DataFrame, at: np.ndarray, hashes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Key rows of ``found``: (which of the sets, key, whether the key has no tokens)."""
    bits = np.bitwise_or.reduce(np.uint64(1) << (hashes >> np.uint64(58)), 1)
    which, keys, bare = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({
        "key": _mix(keys).view(np.int64), "sid": pdf["sid"].to_numpy(np.int64)[at][which], "sides": pdf["sides"].to_numpy(np.int32)[at][which],
        "size": np.int32(hashes.shape[1]), "bits": bits.view(np.int64)[which], "bare": bare,
    })


_KEYS = "key long, sid long, sides int, size int, bits long, bare boolean"


def _held(threshold: float):
    """Every set under its whole segments and under each with one token less."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        with np.errstate(over="ignore"):
            for pdf in batches:
                for at, hashes, _ in _by_length(pdf, known):
                    b = hashes.shape[1]
                    m = segments(b, threshold)
                    p = _Parts(hashes, b, m)
                    found = [(p.every, p.whole(i), p.count[:, i] == 0) for i in range(m)]
                    found += [(p.every, p.without(j) ^ np.uint64(1), p.count[p.every, p.of[:, j]] == 1) for j in range(b)]
                    yield _rows(pdf, at, hashes, found)

    return run


def _asked(threshold: float, frequent: dict[str, int], total: int):
    """The keys under which a set looks for shorter or equally long ones."""
    rare, most = max(1.0, total * HOT_SHARE / 4), float(total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        with np.errstate(over="ignore"):
            for pdf in batches:
                for at, hashes, tokens in _by_length(pdf, known):
                    b = hashes.shape[1]
                    often = np.array([[float(frequent.get(t, rare)) for t in ts] for ts in tokens])
                    found = []
                    for a in range(max(1, math.ceil(threshold * b - 1e-9)), b + 1):
                        m = segments(a, threshold)
                        p = _Parts(hashes, a, m)
                        # Costs: how many sets a key may meet, bounded by its rarest token.
                        low, next_ = np.full((2, len(at), m), np.inf)
                        for j in range(b):
                            here = p.of[:, j]
                            f, was = often[:, j], low[p.every, here]
                            next_[p.every, here] = np.minimum(next_[p.every, here], np.maximum(f, was))
                            low[p.every, here] = np.minimum(was, f)
                        bare, one = p.count == 0, p.count == 1
                        whole = np.where(bare, _LAST_RESORT * most, low)
                        single = np.where(
                            bare, 2 * _LAST_RESORT * most,
                            np.where(one, _LAST_RESORT * most, 0.0) + np.where(bare, 0.0, low * (p.count + 1)) + np.where(p.count > 1, next_, 0.0),
                        )
                        plan = cheapest(whole, single, most_differing(a, b, threshold) + 1)
                        for i in range(m):
                            for k, key in ((np.flatnonzero(plan[:, i] >= 0), p.whole(i)), (np.flatnonzero(plan[:, i] == 1), p.whole(i) ^ np.uint64(1))):
                                found.append((k, key[k], bare[k, i]))
                        for j in range(b):
                            here = p.of[:, j]
                            k = np.flatnonzero(plan[p.every, here] == 1)
                            found.append((k, p.without(j)[k], one[k, here[k]]))
                    yield _rows(pdf, at, hashes, found)

    return run


def distinct_sets(records: DataFrame, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, sets): each record (id, side) with the number of its token set; each set once.

    ``records``: id, side, tokens. Tokens lose case and surrounding blanks; NULL and blank ones, repeats
    and rows without id do not count; several rows of one id and side are united. Records with fewer
    than ``min_size`` tokens take no part. ``sides`` of a set says which of two tables, ``left`` and
    ``right``, hold it; with any other side all sets are of one table.
    """
    clean = F.transform("tokens", lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    # Almost all rows of an id are equal, so whole arrays are united, not exploded.
    one = records.where(F.col("id").isNotNull()).select(
        "id", "side", F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))).alias("tokens"),
    )
    one = one.where(F.col("tokens").isNotNull()).groupBy("id", "side").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"))
    rows = stored(one.where(F.size("tokens") >= min_size))
    side = F.when(F.col("side") == "left", LEFT).when(F.col("side") == "right", RIGHT).otherwise(BOTH)
    sets = stored(rows.groupBy("tokens").agg(F.bit_or(side).cast("int").alias("sides")).select(F.monotonically_increasing_id().alias("sid"), "tokens", "sides"))
    return rows.join(sets, "tokens").select("id", "side", "sid"), sets


def _across(a: Column, b: Column) -> Column:
    """Whether a pair can have one end in each table (sets of one table are in both)."""
    return a.bitwiseOR(b) == BOTH


def similar_sets(sets: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(sid_a, sid_b, overlap): all pairs of distinct sets with |shared| / |union| >= threshold.

    Of sets of two tables only pairs between the tables are looked for. No sets give no pairs.
    """
    counts = stored(sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = {r.t: r.n for r in counts.where(F.col("n") > total * HOT_SHARE).toLocalIterator()}
    source = sets.select("sid", "tokens", "sides")
    ask = stored(source.mapInPandas(_asked(threshold, frequent, total), _KEYS))
    # One key per length and segment at most.
    bare = stored(ask.where("bare").select("key", F.lit(True).alias("wanted")).distinct())
    hold = source.mapInPandas(_held(threshold), _KEYS).join(bare, "key", "left").where(~F.col("bare") | F.col("wanted"))
    hold = hold.select(
        "key", F.col("sid").alias("held"), F.col("sides").alias("held_sides"), F.col("size").alias("held_size"),
        F.col("bits").alias("held_bits"),
    )
    n = F.col("size") + F.col("held_size")
    apart = n - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * n - 1e-9)
    order = (F.col("held_size") < F.col("size")) | ((F.col("held_size") == F.col("size")) & (F.col("held") < F.col("sid")))
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("held_bits"))) <= apart
    pairs = ask.drop("bare").join(hold, "key").where(order & near & _across(F.col("sides"), F.col("held_sides"))).select(F.col("sid").alias("sid_a"), F.col("held").alias("sid_b"))
    pairs = stored(pairs.distinct())
    tokens = sets.select("sid", "tokens")
    full = pairs.join(tokens.toDF("sid_a", "x"), "sid_a").join(tokens.toDF("sid_b", "y"), "sid_b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return full.select("sid_a", "sid_b", shared.alias("shared"), union.alias("either")).where(F.col("shared") >= threshold * F.col("either") - 1e-9).select(
        "sid_a", "sid_b", (F.col("shared") / F.col("either")).alias("overlap")
    )


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a < id_b): all pairs of different records whose sets are equal or linked.

    As many rows as pairs, which is what a list of pairs asks for; members and links give the same in
    one row per record and one per pair of sets.
    """
    who = members.select("id", "sid").distinct()
    same = who.join(who.toDF("other", "sid"), "sid").where(F.col("id") < F.col("other")).select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    across = links.join(who.toDF("x", "sid_a"), "sid_a").join(who.toDF("y", "sid_b"), "sid_b").where(F.col("x") != F.col("y"))
    return same.unionByName(across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))).distinct()


def between(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_left, id_right): all pairs of a left and a right record whose sets are equal or linked."""
    left, right = (members.where(F.col("side") == s).select(F.col("id").alias(f"id_{s}"), "sid") for s in ("left", "right"))
    both = links.select("sid_a", "sid_b").unionByName(links.select(F.col("sid_b").alias("sid_a"), F.col("sid_a").alias("sid_b")))
    across = left.withColumnRenamed("sid", "sid_a").join(both, "sid_a").join(right.withColumnRenamed("sid", "sid_b"), "sid_b").select("id_left", "id_right")
    return left.join(right, "sid").select("id_left", "id_right").unionByName(across).distinct()
