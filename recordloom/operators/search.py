"""Ranked full-text search over records: BM25 with column weights, fallback stages and re-ranking.

Words are compared by their Porter stems, as with tokenize='porter unicode61'; ``stem=False`` compares
them as written. The text itself is not stemmed: the few words of the
vocabulary that stem like a query word (``word_forms``) are looked for. One pass over the corpus gives every record its weighted term hits for the exact and the prefix form
of each query term; corpus size and mean length are observed on the way, and only records with a hit
are kept. The first stage that matches anything ranks. Nothing but matching records is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from recordloom.functions import porter
from recordloom.functions.records import Settings, days_between
from recordloom.functions.text import ACCENTED, PLAIN, prefix_stem, tokens
from recordloom.runtime import stored

#: Effective column weights: title, tags, body. The documented preset is (10, 5, 1).
WEIGHTS = (5.0, 1.0, 1.0)
K1, B = 1.2, 0.75
#: Query vectors compared in one pass over the stored ones.
QUERY_BLOCK = 64
STAGES = ("and", "and_prefix", "or", "or_prefix")


def query_terms(query: str) -> list[list[str]]:
    """Terms split at white space; each is the list of tokens that must stand next to each other."""
    import re

    plain = query.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return [[w for w in re.split(r"[\W_]+", t) if w] for t in plain.split()]


def tokenized(records: DataFrame) -> DataFrame:
    """Records with token arrays per field and the total length."""
    df = records.withColumns({"_t_title": tokens(F.col("title")), "_t_tags": tokens(F.array_join("tags", " ")), "_t_body": tokens(F.col("body"))})
    return df.withColumn("_length", F.size("_t_title") + F.size("_t_tags") + F.size("_t_body"))


def word_forms(records: DataFrame, words: list[tuple[str, bool]]) -> dict[tuple[str, bool], tuple[list[str], list[str]]]:
    """Per query word (stem, prefix): other tokens that count for it, and tokens that only look like it.

    A token counts if its stem is the word or, with ``prefix``, starts with it. Stemming changes endings
    only, so both lists hold one stem under different endings, however large the vocabulary is; tokens
    of a prefix whose stem goes on after it are in neither.
    """
    alike = lambda t: _any([t.startswith(w[:1]) & (F.lit(len(w) < 2) | F.substring(t, 2, 1).isin(w[1:2], "y")) for w, _ in words])
    df = tokenized(records)
    every = F.array_distinct(F.filter(F.concat("_t_title", "_t_tags", "_t_body"), alike))
    vocabulary = stemmed_vocabulary(df.select(F.explode(every).alias("term")))
    raw = lambda w, p: F.col("term").startswith(w) if p else F.col("term") == w
    own = lambda w, p: F.col("stem").startswith(w) if p else F.col("stem") == w
    found = vocabulary.where(_any([raw(*w) != own(*w) for w in words])).collect()
    fits = lambda text, w, p: text.startswith(w) if p else text == w
    return {w: (
        sorted(r.term for r in found if fits(r.stem, *w) and not fits(r.term, *w)),
        sorted(r.term for r in found if fits(r.term, *w) and not fits(r.stem, *w)),
    ) for w in words}


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def hits(field: Column, phrase: list[str], prefix: bool, forms: dict | None = None) -> Column:
    """Places in ``field`` where the phrase stands; with ``prefix`` its last token may go on."""
    if not phrase:
        return F.lit(0)

    def same(token: Column, word: str, prefix: bool = False) -> Column:
        more, less = (forms or {}).get((word, prefix), ([], []))
        out = token.startswith(word) if prefix else token == word
        out = out & ~token.isin(less) if less else out
        return out | token.isin(more) if more else out

    last = lambda w: same(w, phrase[-1], prefix)
    if len(phrase) == 1:
        return F.size(F.filter(field, last))
    n = len(phrase)
    at = F.when(F.size(field) >= n, F.sequence(F.lit(1), F.size(field) - n + 1)).otherwise(F.array().cast("array<int>"))

    def fits(i: Column) -> Column:
        out = last(F.element_at(field, i + n - 1))
        for j, w in enumerate(phrase[:-1]):
            out = out & same(F.element_at(field, i + j), w)
        return out

    return F.size(F.filter(at, fits))


def weighted(phrase: list[str], prefix: bool, weights: tuple[float, ...], forms: dict | None = None) -> Column:
    fields = ("_t_title", "_t_tags", "_t_body")
    return sum(
        (F.lit(w) * hits(F.col(f), phrase, prefix, forms) for f, w in zip(fields[1:], weights[1:], strict=True)),
        F.lit(weights[0]) * hits(F.col(fields[0]), phrase, prefix, forms),
    )


def query_phrases(query: str, stem: bool = True) -> tuple[list[list[str]], list[list[str]]]:
    """The tokens of each term for the exact and for the prefix stages, stemmed if asked."""
    terms = query_terms(query)
    cut = [(query_terms(prefix_stem(t)) or [[]])[0] for t in query.split()]
    if not stem:
        return terms, cut
    return [[porter.stem(w) for w in t] for t in terms], [[porter.stem(w) for w in t] for t in cut]


def matches(
    records: DataFrame, query: str, types: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, stage: str | None = None,
    stem: bool = True,
) -> DataFrame:
    """(all record columns, bm25) of the records the query matches; higher is better.

    ``records``: the searched snapshot; statistics are over all of it, whatever ``types`` says. Without
    ``stage`` the first stage with a match is taken. A query without terms matches nothing.
    """
    if not any(query_terms(query)):
        return records.limit(0).withColumn("bm25", F.lit(0.0))
    df, found, names = _hit_counts(records, query, types, weights, stem)
    # One pass over the corpus: its size and mean length are observed while the records with any hit,
    # which are all that can match or count towards a document frequency, are stored.
    corpus = Observation()
    any_hit = F.greatest(*[F.col(c) for c in names]) > 0
    seen = df.observe(corpus, F.count(F.lit(1)).alias("n"), F.avg("_length").alias("mean"))
    df = stored(seen.where(any_hit).select(*records.columns, "_length", *names))
    stats = df.agg(*_frequencies(found, names)).first().asDict() | corpus.get
    return _scored(df, stats, found, names, stage).select(*records.columns, "bm25")


def matches_by(records: DataFrame, by: str, query: str, types: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, stem: bool = True) -> DataFrame:
    """``matches`` of every value of ``by`` (no NULLs) as a corpus of its own, in the same passes.

    The driver and the plan see one row of figures per value: layers of a store, not keys of records.
    """
    if not any(query_terms(query)):
        return records.limit(0).withColumn("bm25", F.lit(0.0))
    df, found, names = _hit_counts(records, query, types, weights, stem)
    sizes = {r[by]: r.asDict() for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("_length").alias("mean")).collect()}
    df = stored(df.where(F.greatest(*[F.col(c) for c in names]) > 0).select(*records.columns, "_length", *names))
    parts = [_scored(
        df.where(F.col(by) == r[by]), r.asDict() | sizes[r[by]], found, names, None,
    ) for r in df.groupBy(by).agg(*_frequencies(found, names)).collect()]
    out = df.limit(0).withColumn("bm25", F.lit(0.0))
    for part in parts:
        out = out.unionByName(part)
    return out.select(*records.columns, "bm25")


def _hit_counts(
    records: DataFrame, query: str, types: list[str] | None, weights: tuple[float, ...], stem: bool,
) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Records with the weighted hits of each term, the test of each stage, and the hit columns."""
    terms, cut = query_phrases(query, stem)
    words = {(w, False) for t in terms + [c[:-1] for c in cut] for w in t} | {(t[-1], True) for t in cut if t}
    forms = word_forms(records, sorted(words)) if stem else {}
    df = tokenized(records)
    df = df.withColumns({f"_x{i}": weighted(t, False, weights, forms) for i, t in enumerate(terms)} | {f"_p{i}": weighted(t, True, weights, forms) for i, t in enumerate(cut)})
    wanted = F.col("type").isin(types) if types else F.lit(True)
    found = {}
    for name in STAGES:
        cols = [F.col(f"_{'p' if 'prefix' in name else 'x'}{i}") > 0 for i in range(len(terms))]
        test = cols[0]
        for c in cols[1:]:
            test = test & c if name.startswith("and") else test | c
        found[name] = test & wanted
    return df, found, [f"_{k}{i}" for k in "xp" for i in range(len(terms))]


def _frequencies(found: dict[str, Column], names: list[str]) -> list[Column]:
    return [F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in names] + [F.count_if(found[s]).alias(f"in_{s}") for s in STAGES]


def _scored(df: DataFrame, stats: dict, found: dict[str, Column], names: list[str], stage: str | None) -> DataFrame:
    """Records of ``stage``, or of the first stage with a match, with their bm25."""
    terms = len(names) // 2
    order = [s for s in STAGES if terms > 1 or s.startswith("and")]
    stage = stage or next((s for s in order if stats[f"in_{s}"]), "and")
    kind = "p" if "prefix" in stage else "x"
    score = F.lit(0.0)
    for i in range(terms):
        f, n = F.col(f"_{kind}{i}"), stats[f"df__{kind}{i}"]
        idf = F.greatest(F.ln((F.lit(float(stats["n"])) - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_length") / F.lit(float(stats["mean"] or 1.0))))
    return df.where(found[stage]).withColumn("bm25", F.round(score, 6))


def phrase_bonus(query: str) -> Column:
    words = query.lower().split()
    if len(words) < 2:
        return F.lit(0)
    phrase = " ".join(words)
    inside = lambda c: F.coalesce(F.lower(c).contains(phrase), F.lit(False))
    return F.when(inside(F.col("title")), 5).when(inside(F.array_join("tags", " ")), 4).when(inside(F.col("body")), 3).otherwise(0)


def recency(now: Column) -> Column:
    return F.lit(1.0) / (1 + F.greatest(days_between(now, F.col("created")), F.lit(0.0)))


def search(
    records: DataFrame, query: str, now: Column, limit: int = 10, types: list[str] | None = None, settings: Settings = Settings(),
    weights: tuple[float, ...] = WEIGHTS, stem: bool = True,
) -> DataFrame:
    """The best ``limit`` records: 2 x limit by BM25, re-ranked by relevance, phrase and recency.

    Adds bm25, score and rank. Ties go to the smaller id.
    """
    first = matches(records, query, types, weights, stem=stem).orderBy(F.desc("bm25"), "id").limit(2 * limit)
    raw = stored(first.withColumns({"raw": F.col("bm25") + phrase_bonus(query), "recency": recency(now)}))
    # At most 2 x limit rows from here on.
    top = raw.agg(F.max("raw")).first()[0] or 0.0
    scored = raw.withColumn(
        "score",
        F.round(F.col("raw") / F.lit(float(top) if top > 0 else 1.0) * settings.relevance + F.col("recency") * settings.recency, 6),
    )
    ranked = scored.orderBy(F.desc("score"), "id").limit(limit)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).drop("raw", "recency")


def search_layers(layers: list[tuple[str, DataFrame]], query: str, now: Column, limit: int = 10, **more) -> DataFrame:
    """Per-layer results in layer order, the first layer winning on equal ids; scores are not compared."""
    each = None
    for place, (name, records) in enumerate(layers):
        got = records.withColumns({"from_layer": F.lit(name), "place": F.lit(place)})
        each = got if each is None else each.unionByName(got)
    return search_places(each, query, now, limit, **more)


def search_places(
    records: DataFrame, query: str, now: Column, limit: int = 10, types: list[str] | None = None, settings: Settings = Settings(),
    weights: tuple[float, ...] = WEIGHTS, stem: bool = True,
) -> DataFrame:
    """``search`` in every layer at once, each ranked by its own figures; cut only after all layers.

    ``records``: from_layer and place, which orders the layers and is not NULL, besides the columns of
    a search. A record found in several layers comes from the first of them.
    """
    of = lambda *order: Window.partitionBy("place").orderBy(*order)
    first = matches_by(records, "place", query, types, weights, stem)
    first = first.withColumn("_n", F.row_number().over(of(F.desc("bm25"), "id"))).where(F.col("_n") <= 2 * limit).drop("_n")
    raw = first.withColumns({"raw": F.col("bm25") + phrase_bonus(query), "recency": recency(now)})
    # At most 2 x limit rows of each layer from here on.
    raw = raw.withColumn("top", F.max("raw").over(Window.partitionBy("place")))
    scored = raw.withColumn(
        "score",
        F.round(F.col("raw") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0) * settings.relevance + F.col("recency") * settings.recency, 6),
    )
    ranked = scored.withColumn("rank", F.row_number().over(of(F.desc("score"), "id"))).where(F.col("rank") <= limit)
    one = ranked.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place", "rank"))).where("n = 1")
    return one.drop("n", "raw", "recency", "top").orderBy("place", "rank").limit(limit)


def postings(records: DataFrame, stem: bool = False) -> DataFrame:
    """(term, id, field, tf): the inverted index, optionally stemmed through its vocabulary."""
    df = tokenized(records).select(
        "id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t_{f}").alias("t")) for f in ("title", "tags", "body")])).alias("f"),
    )
    flat = df.select("id", "f.field", F.explode("f.t").alias("term")).groupBy("term", "id", "field").agg(F.count(F.lit(1)).alias("tf"))
    if not stem:
        return flat
    return flat.join(stemmed_vocabulary(flat.select("term")), "term").groupBy(F.col("stem").alias("term"), "id", "field").agg(F.sum("tf").alias("tf"))


def stemmed_vocabulary(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term: Python sees the vocabulary once, not the text."""
    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(porter.stem)

    return terms.select("term").where(F.col("term").isNotNull()).distinct().withColumn("stem", stems("term"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length; vectors of different length raise an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def cosine_rerank(candidates: DataFrame, vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Candidates (column id) ordered by the cosine of their vector (id, embedding) with the query's."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return candidates.join(vectors, "id").withColumn("similarity", F.round(cosine(F.col("embedding"), asked), 6)).orderBy(F.desc("similarity"), "id").limit(limit)


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, similarity) of every stated query (query_id, query) and every vector (id, embedding).

    Queries go to the vectors in blocks of ``QUERY_BLOCK``, one pass over the vectors each, as constants
    of the plan; neither side is shuffled.
    """
    order = queries.orderBy("query_id")
    out, block = None, []

    def scored(block: list) -> DataFrame:
        asked = F.array(*[F.struct(F.lit(r.query_id).alias("query_id"), F.array(*[F.lit(float(x)) for x in r.query]).alias("query")) for r in block])
        each = vectors.select("id", "embedding", F.explode(asked).alias("q"))
        return each.select("q.query_id", "id", F.round(cosine(F.col("embedding"), F.col("q.query")), 6).alias("similarity"))

    for row in order.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = scored(block) if out is None else out.unionByName(scored(block)), []
    if block:
        out = scored(block) if out is None else out.unionByName(scored(block))
    if out is not None:
        return out
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, similarity double")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, similarity, rank): the ``limit`` nearest vectors of each query, ties by the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return similarities(vectors, queries).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def embed(records: DataFrame, provider, column: str = "body") -> DataFrame:
    """Add ``embedding`` from ``provider(list of texts) -> list of vectors``, called once per Arrow batch."""
    @F.pandas_udf("array<double>")
    def call(texts: pd.Series) -> pd.Series:
        return pd.Series(list(provider(texts.fillna("").tolist())))

    return records.withColumn("embedding", call(column))
