"""Reading level of each document's prose, calibrated on passages of known level.

Words are ranked by how often they occur in all prose. A document's coverage rank is the size of the
smallest such vocabulary that covers a fixed share of its words; together with the length of its
sentences it is compared with the levels' own values, all in SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import stored

#: Share of a document's words that its vocabulary must cover.
COVERED = 0.75
#: Words whose ranks travel to the tasks; rarer words find their rank by a shuffled join.
COMMON_WORDS = 20_000


def prose(text: Column) -> Column:
    """``text`` without header block, code, tables, headings, addresses and line marks."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\u00a0", " ")
    t = F.regexp_replace(t, r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")
    t = F.regexp_replace(t, r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\z)", "\n")
    t = F.regexp_replace(t, r"(?m)^(?:[ \t]*#{1,6}[ \t].*|[ \t]*\|.*|(?: {4}|\t).*|[ \t]*[-=]{3,}[ \t]*)$", "")
    # A line that leads with an address is a reference; elsewhere only the address goes.
    t = F.regexp_replace(t, r"(?m)^\W*(?:\w+[ \t]+)?https?://.*$", "")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, r"\b(e\.g|i\.e|etc|sec|approx|vs|cf|no|fig)\.", "$1")
    t = F.regexp_replace(
        t,
        r"(?m)^[ \t]*(?:>[ \t]?)*(?:[-*+][ \t]+|\d+[.)][ \t]+|(?:\d{4}-\d\d-\d\d[ \t]+)?\d\d:\d\d(?:[ \t]+-)?[ \t]+|\*{0,2}[A-Za-z]+\*{0,2}:\*{0,2}[ \t]+)?",
        "",
    )
    return F.regexp_replace(t, "`[^`\n]*`", " code ")


def measured(texts: DataFrame) -> DataFrame:
    """(id, sentence, w): words of a sentence, and the words.

    The length is the mean of the middle half of the sentences: passages of another kind that were
    pasted into a text do not move it, and it tells texts apart that share a median.
    """
    clean = texts.select("id", prose(F.coalesce("text", F.lit(""))).alias("t"))
    parts = clean.select(
        "id", F.filter(F.split("t", r"[.!?]+[\"')\]*]*(?:\s+|$)|\n[ \t]*\n"), lambda s: s.rlike(r"[\p{L}\p{N}]")).alias("s"),
        F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"),
    )
    sizes = parts.select("id", "w", F.array_sort(F.transform("s", lambda s: F.size(F.split(F.trim(s), r"\s+")))).alias("n"))
    quarter = F.floor(F.size("n") / 4).cast("int")
    middle = F.slice("n", quarter + 1, F.size("n") - 2 * quarter)
    mean = F.when(F.size("n") > 0, F.aggregate(middle, F.lit(0), lambda x, y: x + y) / F.size(middle))
    return sizes.select("id", F.coalesce(mean, F.lit(0.0)).alias("sentence"), "w")


def ranked(words: DataFrame) -> DataFrame:
    """(word, rank) of every word in ``w``: by descending frequency, words of one frequency together.

    Frequencies are counted per word, then per frequency: the second level has one row per distinct
    count, at most the square root of twice the words, and is all that is ordered.
    """
    from pyspark.sql import Window

    freq = stored(words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f")))
    per = freq.groupBy("f").agg(F.count(F.lit(1)).alias("words"))
    upto = per.select("f", F.sum("words").over(Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, 0)).alias("rank"))
    return freq.join(upto, "f").select("word", "rank")


def profiles(measures: DataFrame, ranks: DataFrame, covered: float = COVERED) -> DataFrame:
    """(id, length, rank): logarithms of the sentence length and of the coverage rank.

    The coverage rank is the rank of the word at the covered share of a document's words in rank order.
    At most ``COMMON_WORDS`` words have the ranks that are broadcast; rarer words meet theirs in a
    shuffled join, and each document's ranks are collected before they are shuffled.
    """
    words = measures.select("id", F.explode("w").alias("word"))
    known = words.join(F.broadcast(ranks.where(F.col("rank") <= COMMON_WORDS)), "word", "left")
    rare = ranks.where(F.col("rank") > COMMON_WORDS)
    # A word the ranking has not seen comes after all it has.
    last = F.lit(ranks.count() + 1)
    if rare.isEmpty():
        placed = known.select("id", F.coalesce("rank", last).alias("rank"))
    else:
        found = known.where(F.col("rank").isNull()).select("id", "word").join(rare, "word", "left")
        placed = known.where(F.col("rank").isNotNull()).select("id", "rank").unionByName(found.select("id", F.coalesce("rank", last).alias("rank")))
    per = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.col("rank").cast("int"))).alias("r"))
    reached = per.select("id", F.element_at("r", F.ceil(F.size("r") * covered).cast("int")).alias("at"))
    both = measures.select("id", "sentence").join(reached, "id", "left")
    return both.select("id", F.log1p("sentence").alias("length"), F.log1p(F.coalesce("at", F.lit(0))).alias("rank"))


def levels(documents: DataFrame, samples: DataFrame, covered: float = COVERED) -> DataFrame:
    """(id, level, distance): the level whose samples each document's prose is closest to.

    ``documents``: id, text. ``samples``: text, level (a fixed, small table). Distance is measured in
    standard deviations within the samples' levels; ties go to the easier level. A document without
    prose has the easiest level. NULL texts count as empty; a repeated id counts once (any of its rows).
    """
    read = stored(measured(documents))
    ranks = stored(ranked(read))
    seen = profiles(read, ranks, covered)
    marked = samples.where(F.col("level").isNotNull()).select(F.monotonically_increasing_id().alias("id"), "text", "level")
    marked = stored(marked)
    known = profiles(measured(marked.select("id", "text")), ranks, covered).join(marked.select("id", "level"), "id")
    centre = known.groupBy("level").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("length", "rank")], *[F.var_pop(c).alias(f"{c}_var") for c in ("length", "rank")],
    )
    spread = centre.agg(*[F.sqrt(F.greatest(F.avg(f"{c}_var"), F.lit(1e-6))).alias(f"{c}_sd") for c in ("length", "rank")])
    # One row per level, a handful: the levels' values become constants of the plan.
    sd = spread.first()
    board = [(r.level, r.length_mean, r.rank_mean) for r in centre.orderBy("level").toLocalIterator()]
    if not board:
        return seen.select("id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("distance"))
    far = lambda x, y: F.sqrt(F.pow((F.col("length") - x) / sd.length_sd, 2) + F.pow((F.col("rank") - y) / sd.rank_sd, 2))
    best = F.array_min(F.array(*[F.struct(far(x, y).alias("distance"), F.lit(level).alias("level")) for level, x, y in board]))
    judged = seen.select("id", "length", best.alias("b"), F.lit(board[0][0]).alias("easiest"))
    return judged.select(
        "id", F.when(F.col("length") <= 0, F.col("easiest")).otherwise(F.col("b.level")).cast("int").alias("level"),
        F.col("b.distance").alias("distance"),
    )
