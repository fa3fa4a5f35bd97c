"""Mixing sources to target weights of the total size in tokens.

The tokens of every source are packed end to end into blocks of fixed length. Each output shard gives
every source the whole slots its weight amounts to and draws the few that are left (multinomial, by the
fractions); the slots of a source are numbered through, and a pseudorandom permutation per source and
pass over it says which block a number takes. Slots and blocks then meet in one join on (source, block).

Error bound: with S sources, M shards of n slots, at most S slots a shard are drawn, so the share of a
source has a standard deviation of at most sqrt(S / 4M) / n. ``block_size`` makes at least
``LEAST_SLOTS`` slots where the corpus allows: 0.15 points for 9 sources, less the larger the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.runtime import stored

#: Tokens of a block: as many as leave ``LEAST_SLOTS`` blocks, between these two.
LEAST_BLOCK, BLOCK_TOKENS = 32, 2048
LEAST_SLOTS = 4096
SHARD_SLOTS = 256
#: Rows that one task of a running total adds up.
CHUNK_ROWS = 100_000
TOKENIZER = "byte_bpe_50k.tiktoken"


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary."""
    try:
        import public_tokenizers

        return public_tokenizers.path(TOKENIZER)
    except ImportError:
        return f"/opt/tokenizers/{TOKENIZER}"


#: Fixed value: how byte-level BPE cuts text into pieces before merging.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def token_counter(path: str):
    """A pandas UDF that counts a text's tokens; the vocabulary is loaded once per Python worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        encoding = tiktoken.Encoding("mixing", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count


def source_key(c: Column) -> Column:
    """Spellings of a source that differ in case or surrounding blanks are one."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def sized(documents: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents of the target sources."""
    wanted = targets.select(source_key(F.col("source")).alias("source")).distinct()
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").join(wanted, "source", "left_semi")
    return stored(rows.select("doc_id", "source", token_counter(tokenizer)("text").alias("tokens")))


def running_total(rows: DataFrame, key: str, order: str, value: str, chunk: Column) -> DataFrame:
    """Add ``before``: the sum of ``value`` over earlier rows of the same ``key``.

    Totals go in two levels, so that a key with any share of the rows is spread over its chunks.
    ``chunk`` numbers runs of bounded size that follow the order chunk, ``order``.
    """
    cut = rows.withColumn("_chunk", chunk)
    inner = cut.withColumn("_inner", F.sum(value).over(Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    sums = cut.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    outer = sums.withColumn("_outer", F.sum("_sum").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    both = inner.join(outer, [key, "_chunk"])
    return both.withColumn("before", F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0))).drop("_chunk", "_inner", "_outer")


def block_size(sizes: DataFrame) -> int:
    """Tokens of a block for a corpus of these sizes."""
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    return int(min(BLOCK_TOKENS, max(LEAST_BLOCK, total // LEAST_SLOTS)))


def supply(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per target source: tokens, capacity, target_tokens, blocks and whether the weight is in reach.

    Rows of ``targets`` that spell the same source add their weights and keep the larger repeat limit;
    a NULL weight counts as 0 and a NULL limit as 1. A source without documents has no tokens.
    """
    want = targets.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    each = want.where(F.col("source").isNotNull()).join(have, "source", "left").withColumns({
        "tokens": F.coalesce("tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0)),
    })
    # One row per source of the target table.
    total = each.agg(F.sum("tokens")).first()[0] or 0
    return each.select(
        "source", "weight", "max_repeats", "documents", "tokens", (F.col("tokens") * F.col("max_repeats")).alias("capacity"), (F.col("weight") * F.lit(total)).alias("target_tokens"),
        F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
    ).withColumn("reachable", F.col("capacity") >= F.col("target_tokens"))


def packed(sizes: DataFrame, block_tokens: int = BLOCK_TOKENS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(source, block, doc_id, from_token, to_token): the part of each document in each block."""
    rows = sizes.where(F.col("tokens") > 0)
    chunks = int(rows.count() // chunk_rows) + 1
    placed = running_total(rows, "source", "doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    first, last = F.floor(F.col("before") / block_tokens), F.floor((F.col("before") + F.col("tokens") - 1) / block_tokens)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.col("block") * block_tokens - F.col("before")
    return cut.select(
        "source", "block", "doc_id", F.greatest(start, F.lit(0)).alias("from_token"),
        F.least(start + block_tokens, F.col("tokens")).alias("to_token"),
    )


def _permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(size), evaluated at ``index``: Feistel network with cycle walking."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(rounds):
                f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def mixture(
    sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(slots, supplies): slots has (shard, slot, source, pass_no, block), one row per block of the mixture.

    The mixture has as many slots as the target sources have full blocks, each counted once. A source
    that runs out - every block used ``max_repeats`` times - leaves its further slots empty; ``report``
    shows the share it reached. No tokens give no slots.
    """
    import xxhash

    supplies = stored(supply(sizes, targets, block_tokens))
    # One row per source of the target table, the fixed list of what to mix.
    plan = [r.asDict() for r in supplies.orderBy("source").toLocalIterator()]
    weights = np.array([p["weight"] for p in plan], float)
    total_slots = sum(p["tokens"] for p in plan) // block_tokens
    spark = sizes.sparkSession
    schema = "shard long, source string, slot0 int, k int, blocks long, max_repeats int"
    usable = weights.sum() > 0 and total_slots > 0
    share = weights / weights.sum() if usable else weights

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shard in pdf["id"]:
                n = int(min(shard_slots, total_slots - shard * shard_slots))
                at = 0
                sure = np.floor(share * n + 1e-9)
                left, rest = int(n - sure.sum()), np.maximum(share * n - sure, 0)
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(left, rest / rest.sum()) if left else np.zeros(len(share))
                for p, k in zip(plan, sure + drawn, strict=True):
                    rows.append((shard, p["source"], at, int(k), p["blocks"], p["max_repeats"]))
                    at += int(k)
            yield pd.DataFrame(rows, columns=["shard", "source", "slot0", "k", "blocks", "max_repeats"])

    shards = spark.range(-(-total_slots // shard_slots)) if usable else spark.range(0)
    drawn = stored(shards.mapInPandas(draw, schema))
    counted = running_total(drawn, "source", "shard", "k", F.floor(F.col("shard") / CHUNK_ROWS))
    slots = counted.where(F.col("k") > 0).select("shard", "source", "slot0", "blocks", "max_repeats", "before", F.posexplode(F.sequence(F.lit(1), "k")).alias("j", "_")).select(
        "shard", (F.col("slot0") + F.col("j")).alias("slot"), "source", (F.col("before") + F.col("j")).alias("number"), "blocks", "max_repeats"
    )
    filled = slots.where(F.col("number") < F.col("blocks") * F.col("max_repeats")).withColumn("pass_no", F.floor(F.col("number") / F.col("blocks")))

    @F.pandas_udf("long")
    def block(source: pd.Series, pass_no: pd.Series, number: pd.Series, blocks: pd.Series) -> pd.Series:
        keys = {s: xxhash.xxh64_intdigest(s, seed) for s in source.unique()}
        key = source.map(keys).to_numpy(np.uint64) ^ (pass_no.to_numpy(np.uint64) << np.uint64(40))
        size = blocks.to_numpy(np.int64)
        return pd.Series(_permute(number.to_numpy(np.int64) % size, size, key))

    return filled.select("shard", "slot", "source", "pass_no", block("source", "pass_no", "number", "blocks").alias("block")), supplies


def assembled(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """Slots joined with the parts of documents their blocks hold, in the order of the mixture."""
    return slots.join(pieces, ["source", "block"]).select("shard", "slot", "source", "pass_no", "block", "doc_id", "from_token", "to_token")


def _shares(used: DataFrame, supplies: DataFrame) -> DataFrame:
    each = supplies.join(used, "source", "left").withColumns({"drawn_tokens": F.coalesce("drawn_tokens", F.lit(0)), "passes": F.coalesce("passes", F.lit(0))})
    # One row per source of the target table.
    sums = each.agg(F.sum("drawn_tokens").alias("drawn"), F.sum("tokens").alias("asked")).first()
    part = lambda of: F.when(F.lit(of or 0) > 0, F.col("drawn_tokens") / F.lit(max(of or 0, 1))).otherwise(0.0)
    return each.withColumns({"share": part(sums.drawn), "share_of_asked": part(sums.asked)})


def report(slots: DataFrame, supplies: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per source: what was aimed at, what its slots hold, and that as a share of the mixture and of the size asked for.

    The two shares differ where a source ran out: its empty slots make the mixture smaller.
    """
    size = F.least(F.lit(block_tokens), F.col("tokens") - F.col("block") * block_tokens)
    used = slots.join(supplies.select("source", "tokens"), "source").groupBy("source").agg(
        F.sum(size).alias("drawn_tokens"), (F.max("pass_no") + 1).alias("passes"),
    )
    return _shares(used, supplies)


def reached(mix: DataFrame, supplies: DataFrame) -> DataFrame:
    """``report`` of an assembled mixture, counted from the tokens that are in it."""
    return _shares(
        mix.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("drawn_tokens"), (F.max("pass_no") + 1).alias("passes")),
        supplies,
    )
