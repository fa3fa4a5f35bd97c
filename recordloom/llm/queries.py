"""Registered queries of the training-text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import leakage, mixing, near_dup, reading_level, set_join
from recordloom.runtime import both_records, canonical_id, stored, table


def _tag_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = both_records(spark, sf_dir, "id", "tags").select(canonical_id("id").alias("id"), F.lit("all").alias("side"), F.col("tags").alias("tokens"))
    members, sets = set_join.distinct_sets(rows, 4)
    return stored(members), sets


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, sets = _tag_sets(spark, sf_dir)
    return set_join.expand(members, stored(set_join.similar_sets(sets, 0.6)))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with its class of equal tag sets, the class's size and its number of links."""
    members, sets = _tag_sets(spark, sf_dir)
    links = stored(set_join.similar_sets(sets, 0.6))
    ends = links.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("sid").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return members.join(sizes, "sid").join(ends, "sid", "left").select("id", "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"))


def p3_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a live and an archived record with similar tags, the join between two tables."""
    rows = both_records(spark, sf_dir, "id", "tags").select(
        canonical_id("id").alias("id"), F.when(F.col("ref_table") == "memory_records", "left").otherwise("right").alias("side"),
        F.col("tags").alias("tokens"),
    )
    members, sets = set_join.distinct_sets(rows, 4)
    members = stored(members)
    return set_join.between(members, stored(set_join.similar_sets(sets, 0.6)))


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = both_records(spark, sf_dir, "id", "title", "body", "loaded_at")
    return rows.select(canonical_id("id").alias("id"), F.col("loaded_at").alias("at"), F.concat_ws("\n", "title", "body").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_dup.similar_classes(_record_texts(spark, sf_dir), 0.7, 20)
    return near_dup.expand(members, stored(links))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group of near duplicates and the number of links of its class."""
    members, links = near_dup.similar_classes(_record_texts(spark, sf_dir), 0.7, 20)
    return near_dup.groups(members, links)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans to remove from each document, per item."""
    return leakage.leaked_spans(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leakage.item_report(items, leakage.leaked_spans(_documents(spark, sf_dir), items))


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.sized(table(spark, sf_dir, "documents", "doc_id", "source", "text"), targets, mixing.default_tokenizer()), targets


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes, targets = _sizes(spark, sf_dir)
    block = mixing.block_size(sizes)
    slots, supplies = mixing.mixture(sizes, targets, block)
    return mixing.assembled(slots, mixing.packed(sizes, block)), supplies


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stayed below their weight in the mixture, as even all their repeats had to."""
    # A source out of reach ends below its weight however the draw falls; the sizes tell it from one
    # that the draw alone left a little short.
    return mixing.reached(*_mixed(spark, sf_dir)).where((F.col("drawn_tokens") < F.col("target_tokens")) & ~F.col("reachable")).select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: which tokens of which document fill which slot of which shard."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source was to have and what it has of the mixture."""
    return mixing.reached(*_mixed(spark, sf_dir))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").where((F.col("lang") == "en") & (F.length("text") > 0))
    return reading_level.levels(docs.select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "level_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select(F.col("id").alias("doc_id"), "level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents per level and the mean distance to the level's samples."""
    return _levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("distance"), 3).alias("mean_distance"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_classes, p3_between, p6_found, p6_groups, p7_found, p7_spans, p7_items, p8_found, p8_mixture, p8_shares, p9_found, p9_profile)
}

_RECORDS = """recs AS (
  SELECT 'ms_' || upper(substr(trim(id), 4)) AS id, tags, title, body, loaded_at FROM memory_records
  UNION ALL SELECT 'ms_' || upper(substr(trim(id), 4)), tags, title, body, loaded_at FROM archive_records)"""
_TAGS = f"""{_RECORDS},
tag AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM (SELECT id, unnest(tags) AS t FROM recs) WHERE trim(t) <> ''),
big AS (SELECT id, count(*) AS n FROM tag GROUP BY id HAVING count(*) >= 4),
many AS (SELECT id, t, n FROM tag JOIN big USING (id)),
pair AS (
  SELECT a.id AS id_a, b.id AS id_b FROM many a JOIN many b ON a.t = b.t AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)))"""

_WINDOWS = """item AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM eval_items),
doc AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM item)),
dw AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))"""
_BAGS = f"""{_RECORDS},
one AS (SELECT DISTINCT ON (id) id, lower(title || ' ' || body) AS t FROM recs ORDER BY id, loaded_at),
word AS (SELECT id, unnest(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM one),
size AS (SELECT id, count(*) AS n FROM word GROUP BY id HAVING count(*) >= 20),
bag AS (SELECT id, w, count(*) AS k, any_value(n) AS n FROM word JOIN size USING (id) GROUP BY id, w),
near_ AS (SELECT a.id AS id_a, b.id AS id_b FROM bag a JOIN bag b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING sum(least(a.k, b.k)) >= 0.7 * (a.n + b.n - sum(least(a.k, b.k))))"""

SQL = {
    "p3_found": f"WITH {_TAGS} SELECT id_a, id_b FROM pair",
    "p3_classes": f"""WITH {_TAGS},
key AS (SELECT id, list_sort(list(t)) AS k FROM many GROUP BY id),
class AS (SELECT k, min(id) AS class_id, count(*) AS members FROM key GROUP BY k),
link AS (SELECT DISTINCT a.k AS k, b.k AS other FROM pair p JOIN key a ON a.id = p.id_a JOIN key b ON b.id = p.id_b WHERE a.k <> b.k),
ends AS (SELECT k, count(DISTINCT other) AS links FROM (SELECT k, other FROM link UNION SELECT other, k FROM link) GROUP BY k)
SELECT id, class_id, members, coalesce(links, 0) AS links FROM key JOIN class USING (k) LEFT JOIN ends USING (k)""",
    "p3_between": """WITH recs AS (
  SELECT 'left' AS side, 'ms_' || upper(substr(trim(id), 4)) AS id, tags FROM memory_records
  UNION ALL SELECT 'right', 'ms_' || upper(substr(trim(id), 4)), tags FROM archive_records),
tag AS (SELECT DISTINCT side, id, lower(trim(t)) AS t FROM (SELECT side, id, unnest(tags) AS t FROM recs) WHERE trim(t) <> ''),
big AS (SELECT side, id, count(*) AS n FROM tag GROUP BY side, id HAVING count(*) >= 4),
many AS (SELECT side, id, t, n FROM tag JOIN big USING (side, id))
SELECT a.id AS id_left, b.id AS id_right FROM many a JOIN many b ON a.t = b.t AND a.side = 'left' AND b.side = 'right'
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))""",
    "p6_found": f"WITH {_BAGS} SELECT id_a, id_b FROM near_",
    "p6_groups": f"""WITH RECURSIVE {_BAGS},
key AS (SELECT id, list_sort(list(w || '#' || k)) AS k FROM bag GROUP BY id),
member AS (SELECT id, min(id) OVER (PARTITION BY k) AS rep FROM key),
link AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM near_ n JOIN member a ON a.id = n.id_a JOIN member b ON b.id = n.id_b WHERE a.rep <> b.rep),
both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(rep, other) AS (SELECT DISTINCT rep, rep FROM member UNION SELECT r.rep, l.b FROM reach r JOIN both_ l ON l.a = r.other),
root AS (SELECT rep, min(other) AS group_id FROM reach GROUP BY rep), ends AS (SELECT a AS rep, count(*) AS links FROM both_ GROUP BY a)
SELECT id, group_id, coalesce(links, 0) AS links FROM member JOIN root USING (rep) LEFT JOIN ends USING (rep)""",
    "p7_spans": f"""WITH {_WINDOWS},
at_ AS (SELECT DISTINCT doc_id, item_id, k FROM (SELECT doc_id, unnest(range(0, len(w) - 12)) AS k, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM doc) JOIN iw USING (g)),
cut AS (SELECT *, CAST(k - lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) > 13 AS INTEGER) AS fresh FROM at_),
span AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY k), 0) AS s FROM cut)
SELECT doc_id, item_id, CAST(min(k) AS INTEGER) AS start_word, CAST(max(k) + 13 AS INTEGER) AS end_word FROM span GROUP BY doc_id, item_id, s""",
    "p7_found": f"WITH {_WINDOWS} SELECT doc_id, item_id FROM hit",
    "p7_items": f"WITH {_WINDOWS} SELECT i.item_id, i.split, count(h.doc_id) AS documents, count(h.doc_id) > 0 AS leaked FROM eval_items i LEFT JOIN hit h USING (item_id) GROUP BY i.item_id, i.split",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
