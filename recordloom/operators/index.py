"""A stored inverted index with positions: searches read only the postings of their terms.

Postings lie sorted by term, so that a term or a prefix reaches the scan as a filter on few row groups.
Terms are Porter stems unless ``stem=False``. Scores are those of ``search.matches`` on the same snapshot.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.utils import AnalysisException

from recordloom.functions import porter
from recordloom.operators.search import B, K1, STAGES, WEIGHTS, query_phrases, tokenized
from recordloom.runtime import stored

FIELDS = ("title", "tags", "body")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    records: int
    mean_length: float
    fingerprint: int
    stemmed: bool
    version: str | None = None


def _row_key() -> Column:
    return F.xxhash64("id", "type", "title", F.array_join("tags", "\x00"), "body").cast("decimal(38,0)")


def fingerprint(records: DataFrame) -> int:
    """One number for the searched content of a snapshot, whatever its order."""
    return _number(records.agg(F.sum(_row_key())).first()[0])


def _number(total) -> int:
    return int((total or 0) % (1 << 62))


def _stemmed(tokens: Column) -> Column:
    """Arrays of tokens as stems; every worker stems a word once."""

    @F.pandas_udf(ArrayType(StringType()))
    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for words in batches:
            for w in set().union(*words) - known.keys():
                known[w] = porter.stem(w)
            yield words.map(lambda ws: [known[w] for w in ws])

    return stems(tokens)


def build(records: DataFrame, path: str, files: int | None = None, stem: bool = True, version: str | None = None) -> Index:
    """Index ``records`` (id, type, title, tags, body) under ``path``, replacing what is there.

    The records are read once: their tokens are stored, and postings and figures of the whole follow
    from these. ``version`` names the snapshot for ``open_or_build``.
    """
    fields = [f"_t_{f}" for f in FIELDS]
    t = tokenized(records.select("id", "type", "title", "tags", "body")).select("id", "type", F.col("_length").alias("length"), _row_key().alias("content"), *fields)
    t = stored(t)
    seen = t.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean_length"), F.sum("content").alias("content")).first()
    words = t.withColumns({f: _stemmed(F.col(f)) for f in fields}) if stem else t
    each = words.select("id", "type", "length", F.explode(F.concat(*[_places(f) for f in FIELDS])).alias("p")).select("id", "type", "length", "p.*")
    lists = [F.sort_array(F.collect_list(F.when(F.col("field") == k, F.col("at")))).alias(f"in_{f}") for k, f in enumerate(FIELDS)]
    rows = each.groupBy("term", "id", "type", "length").agg(*lists)
    spread = rows.repartitionByRange(files, "term", "id") if files else rows.repartitionByRange("term", "id")
    spread.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    # An empty index has no file that could tell its columns.
    facts = [(seen.records, seen.mean_length, _number(seen.content), stem, version, spread.schema.json())]
    kinds = "records long, mean_length double, fingerprint long, stemmed boolean, version string, columns string"
    records.sparkSession.createDataFrame(facts, kinds).write.mode("overwrite").parquet(f"{path}/stats")
    return load(records.sparkSession, path)


def _places(field: str) -> Column:
    k = FIELDS.index(field)
    return F.transform(f"_t_{field}", lambda w, i: F.struct(w.alias("term"), F.lit(k).alias("field"), i.alias("at")))


def load(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first()
    columns = StructType.fromJson(json.loads(s.columns))
    return Index(spark.read.schema(columns).parquet(f"{path}/postings"), s.records, s.mean_length, s.fingerprint, s.stemmed, s.version)


def open_or_build(records: DataFrame, path: str, stem: bool = True, version: str | None = None) -> Index:
    """The index under ``path`` if it was built from this content in this form, else a new one.

    With ``version`` (of a table, a commit, a date of load) the snapshots are told apart by it and the
    records are not read at all; without it by what they hold, which takes a pass over them.
    """
    try:
        index = load(records.sparkSession, path)
        same = index.version == version if version is not None else index.fingerprint == fingerprint(records)
        if index.stemmed == stem and same:
            return index
    except (AnalysisException, AttributeError):
        pass
    return build(records, path, stem=stem, version=version)


def _hits(name: str, field: str, length: int) -> Column:
    """Places where the tokens of a phrase follow each other in ``field``."""
    first = F.col(f"{name}_0_{field}")
    rest = [F.col(f"{name}_{j}_{field}") for j in range(1, length)]

    def follows(p: Column) -> Column:
        out = F.lit(True)
        for j, places in enumerate(rest, 1):
            out = out & F.array_contains(places, p + j)
        return out

    return F.size(F.filter(first, follows)) if rest else F.size(first)


def matches(index: Index, query: str, types: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, stage: str | None = None) -> DataFrame:
    """(id, type, bm25) of the records the query matches, by the first stage that matches any."""
    terms, cut = query_phrases(query, index.stemmed)
    phrases = {f"x{i}": (t, False) for i, t in enumerate(terms)} | {f"p{i}": (t, True) for i, t in enumerate(cut)}
    wanted = [F.col("term").startswith(t[-1]) if prefix else F.col("term") == t[-1] for t, prefix in phrases.values() if t]
    wanted += [F.col("term") == w for t, _ in phrases.values() for w in t[:-1]]
    if not wanted:
        return index.postings.select("id", "type", F.lit(0.0).alias("bm25")).limit(0)
    any_ = wanted[0]
    for w in wanted[1:]:
        any_ = any_ | w
    lists = []
    for name, (t, prefix) in phrases.items():
        for j, w in enumerate(t):
            here = F.col("term").startswith(w) if prefix and j == len(t) - 1 else F.col("term") == w
            lists += [F.flatten(F.collect_list(F.when(here, F.col(f"in_{f}")))).alias(f"{name}_{j}_{f}") for f in FIELDS]
    found = index.postings.where(any_).groupBy("id", "type", "length").agg(*lists)
    weight = lambda n, t: sum((F.lit(w) * _hits(n, f, len(t)) for f, w in zip(FIELDS, weights, strict=True)), F.lit(0.0)) if t else F.lit(0.0)
    scored = found.select("id", "type", "length", *[weight(n, t).alias(n) for n, (t, _) in phrases.items()])
    kept = F.col("type").isin(types) if types else F.lit(True)
    tests = {}
    for name in STAGES:
        cols = [F.col(f"{'p' if 'prefix' in name else 'x'}{i}") > 0 for i in range(len(terms))]
        tests[name] = cols[0]
        for c in cols[1:]:
            tests[name] = tests[name] & c if name.startswith("and") else tests[name] | c
    stats = scored.agg(*[F.count_if(F.col(n) > 0).alias(f"df_{n}") for n in phrases], *[F.count_if(tests[s] & kept).alias(f"in_{s}") for s in STAGES]).first()
    stage = stage or next((s for s in STAGES if (len(terms) > 1 or s.startswith("and")) and stats[f"in_{s}"]), "and")
    kind, score = ("p" if "prefix" in stage else "x"), F.lit(0.0)
    for i in range(len(terms)):
        f, n = F.col(f"{kind}{i}"), stats[f"df_{kind}{i}"]
        idf = F.greatest(F.ln((F.lit(float(index.records)) - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(float(index.mean_length))))
    return scored.where(tests[stage] & kept).select("id", "type", F.round(score, 6).alias("bm25"))
