"""Evaluation passages inside training text, found through an FM-index per shard.

A shard is a bounded run of documents. Its words become one sequence with a separator after every
document; the sequence is suffix-sorted, and its Burrows-Wheeler transform is kept as a wavelet matrix.
Indexes are built once, where the documents lie, and stored, a row per shard; they do not depend on what
is searched. Test phrases are searched backwards, one rank pair per word; occurrences are located by
walking to the next sampled suffix position, and overlapping occurrences merge into the spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.runtime import stored

#: Words of one shard; a longer document is cut into pieces that overlap by ``OVERLAP`` words, the
#: longest phrase that can be searched.
SHARD_WORDS = 1_000_000
OVERLAP = 64
#: One in so many suffix positions is kept.
SAMPLE = 16
#: Words of test items on the driver and in the tasks at once; more are searched in further blocks.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        pad = (-len(bits)) % 64 + 64
        return cls(np.packbits(np.concatenate([bits, np.zeros(pad, bool)]), bitorder="little").view(np.uint64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: rank of any symbol in as many steps as symbols have bits."""

    def __init__(self, levels: list[Bits], zeros: list[int]):
        self.levels, self.zeros, self.depth = levels, zeros, len(levels)

    @classmethod
    def of(cls, sequence: np.ndarray, largest: int) -> Wavelet:
        levels, zeros, seq = [], [], sequence.astype(np.uint32)
        for level in reversed(range(max(1, int(largest).bit_length()))):
            bit = (seq >> np.uint32(level)) & np.uint32(1) == 1
            levels.append(Bits.of(bit))
            zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(levels, zeros)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places ``i``."""
        out, at = np.zeros(len(i), np.int64), i.astype(np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            out = (out << 1) | one
            at = np.where(one, zeros + ones, at - ones)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``i`` symbols."""
        start = np.zeros(len(i), np.int64)
        end = i.astype(np.int64)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            s, e = bits.rank(start), bits.rank(end)
            start = np.where(one, zeros + s, start - s)
            end = np.where(one, zeros + e, end - e)
        return end - start


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only still tied suffixes are sorted again."""
    n = len(sequence)
    bits = max(1, int(sequence.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([sequence.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    # A suffix's rank is the place of the first of its ties, so ranks of settled suffixes never change.
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    reach = width
    while True:
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            return order
        at = order[tied]
        beyond = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        group = rank[at]
        resort = np.lexsort((beyond, group))
        at, beyond, group = at[resort], beyond[resort], group[resort]
        order[tied] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
        new[tied] = fresh
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = head
        reach *= 2


class FMIndex:
    """Counts and locates phrases in one sequence of small integers; 0 is the separator."""

    def __init__(self, n: int, below: np.ndarray, tree: Wavelet, kept: Bits, samples: np.ndarray):
        self.n, self.below, self.tree, self.kept, self.samples = n, below, tree, kept, samples
        self.largest = len(below) - 2

    @classmethod
    def of(cls, sequence: np.ndarray, sample: int = SAMPLE) -> FMIndex:
        largest = int(sequence.max(initial=0))
        order = suffix_array(sequence)
        last = sequence[order - 1]
        below = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=largest + 1))])
        # Document starts are kept too: no walk crosses a separator, the only symbol whose order the
        # wrap-around of the whole sequence disturbs.
        kept = (order % sample == 0) | (last == 0)
        return cls(len(sequence), below, Wavelet.of(last, largest), Bits.of(kept), order[kept])

    def arrays(self) -> dict[str, bytes | int]:
        """What is stored of it."""
        bits = b"".join(level.words.tobytes() for level in self.tree.levels)
        return {
            "n": self.n, "below": self.below.astype(np.int32).tobytes(), "zeros": np.array(self.tree.zeros, np.int32).tobytes(),
            "bits": bits, "kept": self.kept.words.tobytes(), "samples": self.samples.astype(np.int32).tobytes(),
        }

    @classmethod
    def load(cls, row: dict) -> FMIndex:
        zeros = np.frombuffer(row["zeros"], np.int32).tolist()
        levels = np.frombuffer(row["bits"], np.uint64).reshape(len(zeros), -1)
        tree = Wavelet([Bits(words) for words in levels], zeros)
        return cls(
            int(row["n"]), np.frombuffer(row["below"], np.int32).astype(np.int64), tree, Bits(np.frombuffer(row["kept"], np.uint64)),
            np.frombuffer(row["samples"], np.int32).astype(np.int64),
        )

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last row of each phrase (rows of equal length; 0 stands for no symbol)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero(((phrases > 0) & (phrases <= self.largest)).all(1)) if len(phrases) else np.array([], np.int64)
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for k in reversed(range(phrases.shape[1])):
            c = phrases[live, k]
            a, b = self.tree.rank(c, lo[live]), self.tree.rank(c, hi[live])
            lo[live], hi[live] = self.below[c] + a, self.below[c] + b
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start of the suffix in each row."""
        rows = rows.astype(np.int64)
        out = np.full(len(rows), -1, np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            hit = self.kept.get(rows[live])
            done = live[hit]
            out[done] = self.samples[self.kept.rank(rows[done])] + steps
            live = live[~hit]
            c = self.tree.get(rows[live])
            rows[live] = self.below[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


def _phrases(items: pd.DataFrame, length: int) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distinct phrases, item and phrase of each window)."""
    codes: dict[str, int] = {}
    windows, of_item = [], []
    for item, text in zip(items["item_id"], items["text"], strict=True):
        ws = [codes.setdefault(w, len(codes) + 1) for w in _WORD.findall((text or "").lower())]
        for i in range(len(ws) - length + 1):
            windows.append(ws[i : i + length])
            of_item.append(item)
    if not windows:
        return codes, np.zeros((0, length), np.int64), np.array([], np.int64), np.array([], np.int64)
    distinct, which = np.unique(np.array(windows, np.int64), axis=0, return_inverse=True)
    return codes, distinct, np.array(of_item, np.int64), which.reshape(-1)


_INDEX = "docs binary, rows binary, offsets binary, starts binary, words string, n long, below binary, zeros binary, bits binary, kept binary, samples binary"


def _build(shard_words: int, overlap: int):
    def shard(pieces: list[tuple[int, int, int]], lists: list[list[int]], known: dict[str, int]) -> pd.DataFrame:
        starts = np.cumsum([0, *[len(x) + 1 for x in lists]])
        sequence = np.fromiter((c for x in lists for c in (*x, 0)), np.int64, starts[-1])
        docs, rows, offsets = (np.array(x, np.int64).tobytes() for x in zip(*pieces, strict=True))
        return pd.DataFrame([{
            "docs": docs, "rows": rows, "offsets": offsets, "starts": starts.astype(np.int64).tobytes(), "words": "\n".join(known),
        } | FMIndex.of(sequence).arrays()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, pieces, lists, held = {}, [], [], 0
        for pdf in batches:
            for doc, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                ws = _WORD.findall(text.lower()) if isinstance(text, str) else []
                for at in range(0, max(1, len(ws) - overlap), shard_words) if ws else ():
                    piece = ws[at : at + shard_words + overlap]
                    if held and held + len(piece) > shard_words:
                        yield shard(pieces, lists, known)
                        known, pieces, lists, held = {}, [], [], 0
                    pieces.append((doc, row, at))
                    lists.append([known.setdefault(w, len(known) + 1) for w in piece])
                    held += len(piece)
        if held:
            yield shard(pieces, lists, known)

    return run


def shard_indexes(documents: DataFrame, shard_words: int = SHARD_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """One row per shard with its FM-index, stored once: any number of searches reads it.

    ``documents``: doc_id, text. NULL and empty texts have no words; a repeated doc_id keeps each row.
    """
    numbered = documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return stored(numbered.mapInPandas(_build(shard_words, overlap), _INDEX))


def _search(items: pd.DataFrame, length: int):
    codes, phrases, of_item, which = _phrases(items, length)
    by_phrase = np.argsort(which, kind="stable")
    first = np.searchsorted(which[by_phrase], np.arange(len(phrases) + 1))

    def shard(row: dict) -> pd.DataFrame:
        index = FMIndex.load(row)
        docs, numbers, offsets, starts = (np.frombuffer(row[c], np.int64) for c in ("docs", "rows", "offsets", "starts"))
        known = {w: k for k, w in enumerate(row["words"].split("\n"), 1)}
        # Words of the phrases in the codes of the shard; 0 where it has no such word.
        here = np.array([0, *[known.get(w, 0) for w in codes]], np.int64)
        lo, hi = index.search(here[phrases])
        hits = np.flatnonzero(hi > lo)
        counts = (hi - lo)[hits]
        at = np.repeat(lo[hits] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum())
        position = index.locate(at)
        phrase = np.repeat(hits, counts)
        # One occurrence of a phrase speaks for every item that holds it.
        n_items = first[phrase + 1] - first[phrase]
        item = of_item[by_phrase[np.repeat(
            first[phrase] - np.concatenate([[0], np.cumsum(n_items)[:-1]]).astype(np.int64), n_items,
        ) + np.arange(n_items.sum())]]
        position = np.repeat(position, n_items)
        piece = np.searchsorted(starts, position, side="right") - 1
        got = pd.DataFrame({"piece": piece, "item_id": item, "start": position - starts[piece]}).drop_duplicates().sort_values(["piece", "item_id", "start"])
        same = (got["piece"].diff() == 0) & (got["item_id"].diff() == 0) & (got["start"].diff() <= length)
        spans = got.assign(span=(~same).cumsum()).groupby("span").agg(
            piece=("piece", "first"), item_id=("item_id", "first"), start=("start", "min"), end=("start", "max"),
        )
        p = spans["piece"].to_numpy(np.int64)
        return pd.DataFrame({
            "doc_id": docs[p], "row": numbers[p], "item_id": spans["item_id"].to_numpy(np.int64),
            "start_word": spans["start"].to_numpy(np.int64) + offsets[p], "end_word": spans["end"].to_numpy(np.int64) + offsets[p] + length,
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                got = shard(row)
                if len(got):
                    yield got

    return run


def leaked_spans(
    documents: DataFrame, items: DataFrame, length: int = 13, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, indexes: DataFrame | None = None
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word): maximal spans of documents made of item phrases.

    ``documents``: doc_id, text. ``items``: item_id, text. A phrase is ``length`` consecutive words
    (runs of letters and digits, without case), at most ``OVERLAP``. NULL, empty and shorter texts hold
    none; a repeated doc_id or item_id counts each of its rows. Items are searched in blocks of about
    ``block_words`` words, one at a time, in the stored indexes of all shards (``indexes``, else built
    here once); documents are read where they lie, without a shuffle.
    """
    if not 0 < length <= OVERLAP:
        raise ValueError(f"phrases have 1 to {OVERLAP} words, not {length}")
    spark = documents.sparkSession
    size = F.coalesce(F.floor(F.length("text") / 2) + 1, F.lit(1))
    blocks = int((items.agg(F.sum(size)).first()[0] or 0) // block_words) + 1
    indexes = shard_indexes(documents, shard_words) if indexes is None else indexes
    schema = "doc_id long, row long, item_id long, start_word long, end_word long"
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").toPandas()
        hits = indexes.mapInPandas(_search(part, length), schema)
        # With several blocks each is searched before the next is fetched.
        found = found.unionByName(stored(hits) if blocks > 1 else hits)
    # Pieces of a long document overlap: what they found twice or in two halves is one span.
    here = Window.partitionBy("row", "item_id").orderBy("start_word", "end_word")
    upto = F.max("end_word").over(here.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("fresh", (upto.isNull() | (F.col("start_word") > upto)).cast("int")).withColumn("span", F.sum("fresh").over(here))
    spans = cut.groupBy("row", "item_id", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"),
    )
    return spans.select("doc_id", "item_id", F.col("start_word").cast("int"), F.col("end_word").cast("int"))


def leaked(documents: DataFrame, items: DataFrame, length: int = 13, **more) -> DataFrame:
    """(doc_id, item_id) of every document that holds a phrase of an item."""
    return leaked_spans(documents, items, length, **more).select("doc_id", "item_id").distinct()


def item_report(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Each item with the number of documents it leaked into and whether it leaked at all."""
    hit = spans.select("doc_id", "item_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "split").join(hit, "item_id", "left").select(
        "item_id", "split", F.coalesce("documents", F.lit(0)).alias("documents"), F.col("documents").isNotNull().alias("leaked"),
    )
