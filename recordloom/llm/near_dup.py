"""Near-duplicate texts by min-max hashing.

A text is a bag of words, each repeat an element of its own. One evaluation of a permutation gives two
signature values, its minimum and its maximum over the elements, so 192 values cost 96 evaluations;
five consecutive values make a band. Texts that share a band and whose one-bit sketches are close are
candidates, and candidates are verified exactly on their words. ``exact=True`` takes the candidates from
a prefix filter instead, which misses nothing and costs more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import stored

#: 32 bands of 5 values find a pair at similarity 0.70 with probability 0.997, at 0.75 with 0.9998.
BANDS, BAND_VALUES = 32, 5
SKETCH_WORDS = 3
#: Bits of a sketch that agree for a pair at the threshold, less 3.7 standard deviations.
_SLACK = 3.7
#: Texts of one band that are compared in one group; larger bands are compared block by block.
BAND_ROWS = 512
#: One text in so many is counted to tell which bands are large; moves work, never a pair.
COUNTED = 16

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case."""
    return _WORD.findall(text.lower())


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(lists: list[list[str]], evaluations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts x 2*evaluations) signature values and a 128-bit key of each bag."""
    known: dict[str, int] = {}
    base, repeat, sizes = [], [], []
    for ws in lists:
        seen: Counter[str] = Counter()
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            base.append(h)
            repeat.append(seen[w])
            seen[w] += 1
        sizes.append(len(ws))
    with np.errstate(over="ignore"):
        x = _scramble(np.array(base, np.uint64) + np.array(repeat, np.uint64) * _MIX)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, evaluations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, evaluations, dtype=np.uint64)
        out = np.empty((len(lists), 2 * evaluations), np.uint64)
        for k in range(evaluations):
            h = x * a[k] + b[k]
            h ^= h >> np.uint64(32)
            h *= _MIX
            out[:, 2 * k] = np.minimum.reduceat(h, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(h, starts)
        key = np.stack([np.add.reduceat(x, starts), np.add.reduceat(_scramble(x ^ _MIX), starts)], 1)
    return out, key


def _fingerprint(min_words: int, bands: int, values: int, seed: int):
    evaluations = (max(bands * values, 64 * SKETCH_WORDS) + 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [words(t) if isinstance(t, str) else [] for t in pdf["text"]]
            keep = [i for i, ws in enumerate(lists) if len(ws) >= max(1, min_words)]
            out = pd.DataFrame({
                "id": pdf["id"], "at": pdf["at"], "h": pdf["h"], "n": [len(ws) for ws in lists], "bag_a": np.int64(0), "bag_b": np.int64(0),
                "sketch": None, "bands": None,
            })
            if keep:
                sig, key = _signatures([lists[i] for i in keep], evaluations, seed)
                with np.errstate(over="ignore"):
                    # The order of a band's values matters, its number is part of the key.
                    power = _scramble(np.arange(1, bands * values + 1, dtype=np.uint64) * _MIX) | np.uint64(1)
                    band = _scramble((_scramble(sig[:, : bands * values]) * power).reshape(len(keep), bands, values).sum(2))
                    bit = _scramble(sig[:, : 64 * SKETCH_WORDS] + _MIX) >> np.uint64(63)
                    sketch = (bit.reshape(len(keep), SKETCH_WORDS, 64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)
                for name, found in (
                    ("bag_a", key[:, 0].view(np.int64)), ("bag_b", key[:, 1].view(np.int64)), ("sketch", list(sketch.view(np.int64))),
                    ("bands", list(band.view(np.int64))),
                ):
                    column = out[name].to_numpy(copy=True)
                    column[keep] = found if name.startswith("bag") else pd.Series(found, dtype=object)
                    out[name] = column
            yield out

    return run


def text_key() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(texts: DataFrame, min_words: int = 20, bands: int = BANDS, values: int = BAND_VALUES, seed: int = 7) -> DataFrame:
    """(id, at, h, n, bag_a, bag_b, sketch, bands) of each text; without sketch and bands if it is short."""
    return texts.select("id", "at", text_key().alias("h"), "text").mapInPandas(
        _fingerprint(min_words, bands, values, seed),
        "id string, at timestamp_ntz, h long, n int, bag_a long, bag_b long, sketch array<long>, bands array<long>",
    )


def _agreeing_bits(threshold: float, bits: int) -> int:
    p = (1 + threshold) / 2
    return int(bits * p - _SLACK * (bits * p * (1 - p)) ** 0.5)


def classes(texts: DataFrame, min_words: int = 20, bands: int = BANDS, values: int = BAND_VALUES) -> tuple[DataFrame, DataFrame]:
    """(members, reps): each record with the representative of its exact copies, and one row per class.

    ``texts``: id, at, text. Rows of one id are one record, whose earliest row counts (a row without time
    before all others; of equal times the one of the smallest text key); rows without id and records of
    under ``min_words`` words (NULL and empty texts among them) take no part.
    """
    prints = stored(fingerprints(texts.where(F.col("id").isNotNull()), min_words, bands, values).withColumn("row", F.monotonically_increasing_id()))
    first = F.min_by(F.struct("row", "h", "n", "bag_a", "bag_b"), F.struct("at", "h", "row"))
    rows = prints.select("id", "at", "h", "n", "row", "bag_a", "bag_b").groupBy("id").agg(first.alias("r")).select("id", "r.*").where(F.col("n") >= max(1, min_words))
    best = rows.groupBy("bag_a", "bag_b").agg(F.min_by(F.struct("id", "row"), "id").alias("r")).select(
        "bag_a", "bag_b", F.col("r.id").alias("rep"), F.col("r.row").alias("row"),
    )
    best = stored(best)
    members = stored(rows.select("id", "bag_a", "bag_b").join(best.drop("row"), ["bag_a", "bag_b"]).select("id", "rep"))
    # The long rows stay where they are: what is dropped is named, not what is kept.
    whole = prints.where(F.col("n") >= max(1, min_words))
    copies = stored(whole.select("row").join(best.select("row"), "row", "left_anti"))
    return members, whole.select("row", F.col("id").alias("rep"), "h", "n", "sketch", "bands").join(copies, "row", "left_anti")


def large_bands(reps: DataFrame) -> DataFrame:
    """(band, blocks): the bands of more than about ``BAND_ROWS`` classes, by the classes counted."""
    some = reps.where(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0).select(F.explode("bands").alias("band"))
    counted = some.groupBy("band").agg((F.count(F.lit(1)) * COUNTED).alias("n"))
    return counted.where(F.col("n") > BAND_ROWS).select("band", F.ceil(F.col("n") / BAND_ROWS).cast("int").alias("blocks"))


def in_blocks(keyed: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of large bands: a row meets every block of its band in a group of its own.

    A band of any share of the rows becomes blocks x (blocks + 1) / 2 groups of two blocks each.
    """
    hot = keyed.join(large, "band").withColumn("block", F.pmod(F.xxhash64("row", "band"), "blocks").cast("int"))
    left = hot.select("band", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), "row", "s")
    right = hot.select(
        "band", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("row").alias("row_b"),
        F.col("s").alias("s_b"),
    )
    return left, right


def banded(reps: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(row_a < row_b) of classes that share a band and whose sketches agree as at the threshold.

    The first sketch word travels with the band key, so that chance collisions end inside the join; the
    full sketch is compared once per pair that is left.
    """
    keyed = reps.select(F.explode("bands").alias("band"), "row", F.element_at("sketch", 1).alias("s"))
    large = stored(large_bands(reps))
    far = 64 - _agreeing_bits(threshold, 64)
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= far
    # The planner makes one exchange of these rows and reads it for both sides.
    small = keyed.join(large, "band", "left_anti")
    a, b = small.alias("a"), small.alias("b")
    met = a.join(b, F.col("a.band") == F.col("b.band")).where((F.col("a.row") < F.col("b.row")) & near(F.col("a.s"), F.col("b.s"))).select(
        F.col("a.row").alias("row_a"), F.col("b.row").alias("row_b"),
    )
    left, right = in_blocks(keyed, large)
    hot = left.join(right, ["band", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("row") < F.col("row_b"))) & near(F.col("s"), F.col("s_b")))
    hot = hot.select(F.least("row", "row_b").alias("row_a"), F.greatest("row", "row_b").alias("row_b"))
    pairs = stored(met.unionByName(hot).distinct())
    sketch = reps.select("row", "sketch")
    both = pairs.join(sketch.toDF("row_a", "x"), "row_a").join(sketch.toDF("row_b", "y"), "row_b")
    differ = F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    return both.where(differ <= 64 * SKETCH_WORDS - _agreeing_bits(threshold, 64 * SKETCH_WORDS)).select("row_a", "row_b")


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bags = [Counter(words(t)) for t in pdf["text"]]
        yield pdf[["row", "n"]].assign(e=[[f"{w} {k}" for w, m in bag.items() for k in range(m)] for bag in bags])


def prefixed(reps: DataFrame, texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(row_a < row_b) of all classes that may reach the threshold: none that does is missing.

    Elements are ordered from rare to frequent. Of n elements the first n - ceil(threshold * n) + 1 hold
    one in common with every text at the threshold, so a join on these and the lengths finds all.
    """
    text = texts.select(F.col("id").alias("rep"), text_key().alias("h"), "text").dropDuplicates(["rep", "h"])
    each = stored(reps.select("row", "rep", "h", "n").join(text, ["rep", "h"]).mapInPandas(_elements, "row long, n int, e array<string>")).select("row", "n", F.explode("e").alias("e"))
    counts = each.groupBy("e").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(counts, "e").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("r"))
    first = F.slice("r", 1, (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int"))
    key = stored(ranked.select("row", "n", F.explode(first).alias("r")).select("row", "n", "r.e"))
    pairs = key.join(key.toDF("row_b", "n_b", "e"), "e").where((F.col("row") < F.col("row_b")) & (F.least("n", "n_b") >= F.lit(threshold) * F.greatest("n", "n_b") - 1e-9))
    return pairs.select(F.col("row").alias("row_a"), "row_b").distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        bags: dict[str, Counter] = {}

        def bag(text: str, bags=bags) -> Counter:
            if text not in bags:
                bags[text] = Counter(words(text))
            return bags[text]

        share = []
        for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True):
            a, b = bag(x), bag(y)
            common = (a & b).total()
            share.append(common / (a.total() + b.total() - common))
        yield pdf[["id_a", "id_b"]].assign(similarity=share)


def similar_classes(
    texts: DataFrame, threshold: float = 0.7, min_words: int = 20, bands: int = BANDS, values: int = BAND_VALUES, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of exact copies and every verified link (id_a < id_b) between two classes.

    Similarity is the number of shared words over the union, repeats counted. With ``exact`` no link is
    missing; otherwise each is found with the probability its similarity gives (see ``BANDS``).
    """
    members, reps = classes(texts, min_words, bands, values)
    pairs = stored(prefixed(reps, texts, threshold) if exact else banded(reps, threshold))
    name = reps.select("row", "rep", "h")
    named = stored(pairs.join(name.toDF("row_a", "id_a", "h_a"), "row_a").join(name.toDF("row_b", "id_b", "h_b"), "row_b").select("id_a", "h_a", "id_b", "h_b"))
    wanted = named.select(F.col("id_a").alias("id"), F.col("h_a").alias("h")).union(named.select("id_b", "h_b")).distinct()
    text = stored(texts.select("id", text_key().alias("h"), "text").join(wanted, ["id", "h"], "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    both = named.join(text.toDF("id_a", "text_a"), "id_a").join(text.toDF("id_b", "text_b"), "id_b").select("id_a", "id_b", "text_a", "text_b")
    checked = both.mapInPandas(_verify, "id_a string, id_b string, similarity double").where(F.col("similarity") >= threshold)
    return members, checked.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a < id_b): all pairs of records, copies of one class among them.

    As many rows as pairs, which is what a list of pairs asks for; ``groups`` gives one row a record.
    """
    same = members.join(members.toDF("other", "rep"), "rep").where(F.col("id") < F.col("other")).select(F.col("id").alias("id_a"), F.col("other").alias("id_b"))
    across = (
        links.join(members.toDF("x", "rep_a"), F.col("id_a") == F.col("rep_a")).join(members.toDF("y", "rep_b"), F.col("id_b") == F.col("rep_b"))
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return same.unionByName(across)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, links): connected groups of similar records, named by their smallest id.

    Alternating stars on the links between classes: every node hands its larger (then its smaller or
    equal) neighbours to the smallest one it knows, until nothing moves; each round pre-aggregates.
    """
    edges = stored(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct())
    count = edges.select("a").union(edges.select("b")).groupBy("a").count().toDF("rep", "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = low.groupBy("a").agg(F.min("b").alias("m"))
        next_ = low.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).union(small.select("a", F.col("m").alias("b")))
        edges = stored(next_.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = edges.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    got = members.join(root, "rep", "left").join(count, "rep", "left").select(
        "id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"),
    )
    return got
