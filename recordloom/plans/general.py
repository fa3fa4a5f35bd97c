"""Queries of the general operators over the record, header and export tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import hierarchy, orphans, schema_drift, timestamps
from recordloom.runtime import both_records, canonical_id, stored, table

REFERENCE_FIELDS = ("supersedes", "superseded_by", "depends_on", "refines")


def forest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(forest, node, parent) over both record tables, both ends existing, one row per link.

    ``refines``: the parent is the record refined. ``supersession``: the parent is the replacement, as
    said by superseded_by or by the other record's supersedes.
    """
    rows = both_records(spark, sf_dir, "id", "refines", "supersedes", "superseded_by").withColumn("id", canonical_id("id"))
    said = rows.select(
        F.explode(
            F.concat(
                F.transform(
                    F.coalesce("refines", F.array().cast("array<string>")),
                    lambda x: F.struct(F.lit("refines").alias("forest"), F.col("id").alias("node"), canonical_id(x).alias("parent")),
                ),
                F.transform(
                    F.coalesce("supersedes", F.array().cast("array<string>")),
                    lambda x: F.struct(F.lit("supersession").alias("forest"), canonical_id(x).alias("node"), F.col("id").alias("parent")),
                ),
                F.array(F.struct(F.lit("supersession").alias("forest"), F.col("id").alias("node"), canonical_id("superseded_by").alias("parent"))),
            )
        ).alias("l")
    ).select("l.*")
    said = said.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).distinct()
    ids = rows.select("id").where(F.col("id").isNotNull()).distinct()
    return said.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")


def _forests(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    links = forest_links(spark, sf_dir)
    tag = lambda c: F.concat_ws("|", "forest", c)
    got = hierarchy.resolve_hierarchy(links.select(tag("node").alias("node"), tag("parent").alias("parent")), paths=paths)
    bare = lambda c: F.regexp_replace(c, r"^(refines|supersession)\|", "")
    return got.select(
        F.substring_index("node", "|", 1).alias("forest"), bare("node").alias("id"), bare("root").alias("root_id"), "depth", "descendants",
        F.transform("path", bare).alias("path"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forests(spark, sf_dir, False).drop("path")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path from the root, ids joined by ``/``; NULL for records caught in cycles."""
    return _forests(spark, sf_dir, True).select("forest", "id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair of either forest."""
    got = _forests(spark, sf_dir, True)
    return hierarchy.closure(got.withColumn("node", F.concat_ws("|", "forest", "id"))).select(
        F.substring_index("descendant", "|", 1).alias("forest"), "ancestor", F.substring_index("descendant", "|", -1).alias("descendant"), "distance"
    )


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forests(spark, sf_dir, False).where(F.col("root_id") == hierarchy.CYCLE).select("forest", "id")


def record_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct references with the first load of the referring record, and first loads per record."""
    rows = stored(both_records(spark, sf_dir, "id", *REFERENCE_FIELDS, "loaded_at").withColumn("id", canonical_id("id")).where(F.col("id").isNotNull()))
    loads = stored(rows.groupBy("id").agg(F.min("loaded_at").alias("first_load")))

    def targets(field):
        values = F.array(field) if field == "superseded_by" else F.coalesce(field, F.array().cast("array<string>"))
        return F.transform(values, lambda x: F.struct(F.lit(field).alias("field"), canonical_id(x).alias("target_id")))

    fields = [targets(f) for f in REFERENCE_FIELDS]
    refs = (
        rows.select("ref_table", "id", F.explode(F.concat(*fields)).alias("r")).select("ref_table", "id", "r.*")
        .where(F.col("target_id").isNotNull()).distinct().join(loads, "id")
    )
    return refs, loads


def _orphan_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    refs, loads = record_references(spark, sf_dir)
    refs = stored(refs)
    removed = table(spark, sf_dir, "removed_records", "id").select(canonical_id("id").alias("id")).distinct()
    return refs, stored(orphans.fold(orphans.reference_deltas(refs), orphans.existence_deltas(loads), orphans.removal_deltas(removed)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, state = _orphan_state(spark, sf_dir)
    return orphans.report(refs, state, ("superseded_by",))


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p5_found`` from a state kept up to date: loads before the middle of the time, then the later ones.

    The first state also holds the removed records as if they were there; the second batch takes them back.
    """
    refs, loads = record_references(spark, sf_dir)
    refs, loads = stored(refs), stored(loads)
    ends = loads.agg(F.min("first_load").alias("a"), F.max("first_load").alias("b")).first()
    middle = F.lit(ends.a + (ends.b - ends.a) / 2 if ends.a else None).cast("timestamp_ntz")
    removed = table(spark, sf_dir, "removed_records", "id", "removed_at").groupBy(canonical_id("id").alias("id")).agg(F.min("removed_at").alias("first_load"))
    early, late = F.col("first_load") < middle, F.col("first_load") >= middle
    before = stored(orphans.fold(orphans.reference_deltas(refs.where(early)), orphans.existence_deltas(loads.where(early)), orphans.existence_deltas(removed)))
    after = orphans.fold(
        before, orphans.reference_deltas(refs.where(late)), orphans.existence_deltas(loads.where(late)),
        orphans.existence_deltas(removed, -1), orphans.removal_deltas(removed),
    )
    return orphans.report(refs, stored(after), ("superseded_by",))


def p5_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of such references per referring table, month, field and reason."""
    return p5_found(spark, sf_dir).groupBy("ref_table", "period", "field", "reason").agg(F.count(F.lit(1)).alias("n"))


def p5_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_keys(_orphan_state(spark, sf_dir)[1])


STAMP_FIELDS = ("created", "check_by", "last_verified", "valid_from")
PLAIN_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stamps of the inbox that say a time: (row_id, source, field, at, value)."""
    rows = table(spark, sf_dir, "inbox_headers", "header_id", "source", *STAMP_FIELDS, "read_at")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in STAMP_FIELDS]))
    long = rows.select(
        F.col("header_id").cast("string").alias("row_id"), "source", F.col("read_at").alias("at"), each.alias("v"),
    ).select("row_id", "source", "at", "v.*")
    return long.where(F.col("value").isNotNull() & (F.col("value") != "never"))


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant per stamp of the inbox, or the reason why there is none."""
    got = timestamps.normalise(_stamps(spark, sf_dir), table(spark, sf_dir, "writers"))
    return got.select(F.col("row_id").cast("long").alias("header_id"), "field", timestamps.utc_text(F.col("utc_micros")).alias("utc"), "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamps = _stamps(spark, sf_dir)
    odd = stamps.where(~F.col("value").rlike(PLAIN_STAMP)).select("row_id", "field").distinct()
    got = timestamps.normalise(stamps, table(spark, sf_dir, "writers")).join(odd, ["row_id", "field"])
    return got.select(F.col("row_id").cast("long").alias("header_id"), "field", F.coalesce(timestamps.utc_text(F.col("utc_micros")), "reason").alias("utc"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps per field and outcome."""
    return p4_normalised(spark, sf_dir).groupBy("field", F.coalesce("reason", F.lit("instant")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "export_lines", "stream", "file_seq", "raw")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift(_export_lines(spark, sf_dir))[0]


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header under canonical column names, as canonical JSON text per column."""
    changes, fields = schema_drift.drift(_export_lines(spark, sf_dir))
    return schema_drift.unify(fields, stored(changes)).select("stream", "file_seq", "id", F.to_json("header").alias("header"))


def p2_changes_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("stream", "change").agg(F.count(F.lit(1)).alias("n"))


GENERAL = {f.__name__: f for f in (
    p1_found, p1_paths, p1_descendants, p1_cycles, p5_found, p5_incremental, p5_by_period, p5_orphan_keys, p4_found, p4_normalised,
    p4_report, p2_found, p2_unified, p2_changes_by_stream,
)}

_CANON = "CASE WHEN lower(trim({0})) = '' THEN NULL WHEN lower(trim({0})) LIKE 'ms\\_%' ESCAPE '\\' THEN 'ms_' || upper(substr(trim({0}), 4)) ELSE lower(trim({0})) END"
_ROWS = """rows_ AS (
  SELECT 'memory_records' AS ref_table, id, refines, supersedes, superseded_by, depends_on, loaded_at FROM memory_records
  UNION ALL SELECT 'archive_records', id, refines, supersedes, superseded_by, depends_on, loaded_at FROM archive_records),
recs AS (SELECT {id} AS cid, * FROM rows_)""".format(id=_CANON.format("id"))
_FOREST = f"""{_ROWS},
raw AS (
  SELECT 'refines' AS forest, cid AS node, {_CANON.format("x")} AS parent FROM (SELECT cid, unnest(refines) AS x FROM recs)
  UNION SELECT 'supersession', {_CANON.format("x")}, cid FROM (SELECT cid, unnest(supersedes) AS x FROM recs)
  UNION SELECT 'supersession', cid, {_CANON.format("superseded_by")} FROM recs),
links AS (SELECT * FROM raw WHERE node IN (SELECT cid FROM recs) AND parent IN (SELECT cid FROM recs)),
nodes AS (SELECT forest, node AS id FROM links UNION SELECT forest, parent FROM links),
walk(forest, ancestor, id, distance) AS (
  SELECT forest, id, id, 0 FROM nodes WHERE (forest, id) NOT IN (SELECT (forest, node) FROM links)
  UNION ALL SELECT w.forest, w.ancestor, l.node, w.distance + 1 FROM walk w JOIN links l ON l.forest = w.forest AND l.parent = w.id),
up(forest, ancestor, id, distance) AS (
  SELECT forest, id, id, 0 FROM walk
  UNION ALL SELECT u.forest, l.parent, u.id, u.distance + 1 FROM up u JOIN links l ON l.forest = u.forest AND l.node = u.ancestor)"""
_REFS = f"""{_ROWS},
loads AS (SELECT cid, min(loaded_at) AS first_load FROM recs GROUP BY cid),
refs AS (
  SELECT DISTINCT ref_table, cid, field, {_CANON.format("x")} AS target_id FROM (
    SELECT ref_table, cid, 'supersedes' AS field, unnest(supersedes) AS x FROM recs
    UNION ALL SELECT ref_table, cid, 'depends_on', unnest(depends_on) FROM recs
    UNION ALL SELECT ref_table, cid, 'refines', unnest(refines) FROM recs
    UNION ALL SELECT ref_table, cid, 'superseded_by', superseded_by FROM recs)),
gone AS (SELECT DISTINCT {_CANON.format("id")} AS cid FROM removed_records),
judged AS (
  SELECT r.ref_table, strftime(l.first_load, '%Y-%m') AS period, r.cid AS id, r.field, r.target_id,
    CASE WHEN t.cid IS NULL AND g.cid IS NOT NULL THEN 'deleted' WHEN t.cid IS NULL THEN 'missing'
         WHEN r.field <> 'superseded_by' AND t.first_load > l.first_load THEN 'late' END AS reason
  FROM refs r JOIN loads l ON l.cid = r.cid LEFT JOIN loads t ON t.cid = r.target_id LEFT JOIN gone g ON g.cid = r.target_id
  WHERE r.target_id IS NOT NULL)"""

_ZONES = ", ".join(f"('{k}', {v})" for k, v in timestamps.ABBREVIATIONS.items())
_MONTH = "lpad(CAST(1 + (position(lower(substr({0}, 1, 3)) IN 'janfebmaraprmayjunjulaugsepoctnovdec') - 1) // 3 AS VARCHAR), 2, '0')"
_SAID = r"^(?:[Tt]|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s*([AaPp])[Mm])?(?:\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?))?(?:\[[^\]]*\])?$"
_LOCAL = "epoch_us(timezone(zone_name, make_timestamptz({0}))) - {0}"


def _dated(pattern: str, names: str) -> str:
    return f"regexp_extract(v, '{pattern}', [{names}])"


#: Stamps by their written form alone: every date order that matters here is known.
_STAMPS = f"""said AS (SELECT DISTINCT ON (header_id, field) header_id, field, value, zone_name, date_order FROM (
  SELECT header_id, source, unnest(['created', 'check_by', 'last_verified', 'valid_from']) AS field, unnest([created, check_by, last_verified, valid_from]) AS value FROM inbox_headers) LEFT JOIN writers USING (source)
  WHERE value IS NOT NULL AND value <> 'never'),
basic AS (SELECT *, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS t FROM said),
plain AS (SELECT *, regexp_replace(regexp_replace(t, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})[Tt](\\d{{2}})(\\d{{2}})(\\d{{2}})', '\\1-\\2-\\3T\\4:\\5:\\6'), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})[Tt](\\d{{2}})(\\d{{2}})($|[Zz+-])', '\\1-\\2-\\3T\\4:\\5\\6') AS v FROM basic),
form AS (SELECT *, CASE
    WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([Tt\\s]|$)') THEN {_dated('^(\\d{4})-(\\d{2})-(\\d{2})(.*)$', "'y', 'm', 'd', 'r'")}
    WHEN regexp_matches(v, '^([A-Za-z]{{3,9}},?\\s+)?\\d{{1,2}}\\s+[A-Za-z]{{3,9}}') THEN {_dated(
        '^(?:[A-Za-z]{3,9},?\\s+)?(\\d{1,2})\\s+([A-Za-z]{3,9})\\.?,?\\s+(\\d{4})((?:\\s.*)?)$', "'d', 'm', 'y', 'r'",
    )}
    WHEN regexp_matches(v, '^[A-Za-z]{{3,9}}\\.?\\s+\\d') THEN {_dated(
        '^([A-Za-z]{3,9})\\.?\\s+(\\d{1,2}),?\\s+(\\d{4})((?:[\\s,].*)?)$', "'m', 'd', 'y', 'r'",
    )}
    WHEN regexp_matches(v, '^\\d{{1,2}}\\.') THEN {_dated('^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})((?:\\s.*)?)$', "'d', 'm', 'y', 'r'")}
    WHEN regexp_matches(v, '^\\d{{1,2}}/') AND date_order = 'mdy' THEN {_dated('^(\\d{1,2})/(\\d{1,2})/(\\d{4})((?:\\s.*)?)$', "'m', 'd', 'y', 'r'")}
    WHEN regexp_matches(v, '^\\d{{1,2}}/') THEN {_dated('^(\\d{1,2})/(\\d{1,2})/(\\d{4})((?:\\s.*)?)$', "'d', 'm', 'y', 'r'")} END AS p FROM plain),
clock AS (SELECT *, regexp_extract(p.r, '{_SAID}', ['h', 'i', 's', 'f', 'half', 'zone']) AS c, p.r = '' AS bare,
    TRY_CAST(p.y || '-' || CASE WHEN regexp_matches(p.m, '^\\d') THEN lpad(p.m, 2, '0') ELSE {_MONTH.format('p.m')} END || '-' || lpad(p.d, 2, '0') AS DATE) AS day FROM form
  WHERE p.y <> '' AND (regexp_matches(p.m, '^\\d') OR position(lower(substr(p.m, 1, 3)) IN 'janfebmaraprmayjunjulaugsepoctnovdec') % 3 = 1)),
hour_ AS (SELECT *, TRY_CAST(c.h AS INTEGER) AS h0, CASE WHEN c.half = '' THEN CASE WHEN TRY_CAST(c.h AS INTEGER) < 24 THEN TRY_CAST(c.h AS INTEGER) END
    WHEN TRY_CAST(c.h AS INTEGER) BETWEEN 1 AND 12 THEN TRY_CAST(c.h AS INTEGER) % 12 + CASE WHEN lower(c.half) = 'p' THEN 12 ELSE 0 END END AS h FROM clock),
wall AS (SELECT * EXCLUDE (zone_name), zone_name, upper(c.zone) AS z, epoch_us(CAST(day AS TIMESTAMP)) + CASE WHEN bare THEN 0
    WHEN h IS NOT NULL AND TRY_CAST(c.i AS INTEGER) < 60 AND coalesce(TRY_CAST(nullif(c.s, '') AS INTEGER), 0) < 60
    THEN ((CAST(h AS BIGINT) * 60 + TRY_CAST(c.i AS INTEGER)) * 60 + coalesce(TRY_CAST(nullif(c.s, '') AS INTEGER), 0)) * 1000000 + TRY_CAST(rpad(substr(c.f || '000000', 1, 6), 6, '0') AS INTEGER) END AS w FROM hour_),
zoned AS (SELECT x.*, CASE WHEN z = '' THEN NULL WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (TRY_CAST(z[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(nullif(regexp_extract(z, '^.\\d\\d:?(\\d\\d)$', 1), '') AS INTEGER), 0)) ELSE a.m END AS o
  FROM wall x LEFT JOIN (VALUES {_ZONES}) a(n, m) ON a.n = x.z WHERE w IS NOT NULL),
ways AS (SELECT *, CASE WHEN z = '' THEN w - ({_LOCAL.format('(w - 86400000000)')}) END AS b, CASE WHEN z = '' THEN w - ({_LOCAL.format('(w + 86400000000)')}) END AS a FROM zoned WHERE z = '' OR o IS NOT NULL),
fits AS (SELECT *, b + ({_LOCAL.format('b')}) = w AS bok, a + ({_LOCAL.format('a')}) = w AS aok FROM ways),
told AS (SELECT header_id, field, CASE WHEN z <> '' THEN w - CAST(o AS BIGINT) * 60000000 WHEN bok AND (NOT aok OR a = b) THEN b WHEN aok AND NOT bok THEN a END AS us,
    CASE WHEN z <> '' THEN NULL WHEN zone_name IS NULL THEN 'no_zone' WHEN bok AND aok AND a <> b THEN 'ambiguous' WHEN NOT bok AND NOT aok THEN 'nonexistent' END AS reason FROM fits
  UNION ALL SELECT header_id, field, n * u, NULL FROM (SELECT *, TRY_CAST(t AS BIGINT) AS n, CAST(unnest([1000000, 1000, 1]) AS BIGINT) AS u FROM basic WHERE regexp_matches(t, '^\\d{{1,16}}$'))
  WHERE n < 9000000000000000 // u * 1000 AND n * u >= epoch_us(TIMESTAMP '2023-01-01') AND n * u < epoch_us(TIMESTAMP '2028-01-01')),
stamp AS (SELECT s.header_id, s.field, s.value, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, CASE WHEN t.header_id IS NULL THEN 'unreadable' ELSE reason END AS reason FROM said s LEFT JOIN told t USING (header_id, field))"""

GENERAL_SQL = {
    "p4_found": f"WITH {_STAMPS} SELECT header_id, field, coalesce(utc, reason) AS utc FROM stamp WHERE NOT regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z$')",
    "p4_normalised": f"WITH {_STAMPS} SELECT header_id, field, utc, reason FROM stamp",
    "p4_report": f"WITH {_STAMPS} SELECT field, coalesce(reason, 'instant') AS outcome, count(*) AS n FROM stamp GROUP BY 1, 2",
    "p1_found": f"""WITH RECURSIVE {_FOREST}
SELECT n.forest, n.id, coalesce(w.ancestor, 'cycle') AS root_id, CAST(coalesce(w.distance, -1) AS INTEGER) AS depth,
  CAST(CASE WHEN w.id IS NULL THEN -1 ELSE (SELECT count(*) - 1 FROM up u WHERE u.forest = n.forest AND u.ancestor = n.id) END AS INTEGER) AS descendants
FROM nodes n LEFT JOIN walk w ON w.forest = n.forest AND w.id = n.id""",
    "p1_paths": f"""WITH RECURSIVE {_FOREST},
full_(forest, id, path) AS (
  SELECT forest, id, string_agg(ancestor, '/' ORDER BY distance DESC) FROM up GROUP BY forest, id)
SELECT n.forest, n.id, coalesce(w.ancestor, 'cycle') AS root_id, CAST(coalesce(w.distance, -1) AS INTEGER) AS depth, f.path
FROM nodes n LEFT JOIN walk w ON w.forest = n.forest AND w.id = n.id LEFT JOIN full_ f ON f.forest = n.forest AND f.id = n.id""",
    "p1_descendants": f"WITH RECURSIVE {_FOREST} SELECT forest, ancestor, id AS descendant, CAST(distance AS INTEGER) AS distance FROM up WHERE distance > 0",
    "p1_cycles": f"WITH RECURSIVE {_FOREST} SELECT forest, id FROM nodes WHERE (forest, id) NOT IN (SELECT (forest, id) FROM walk)",
    "p5_found": f"WITH {_REFS} SELECT * FROM judged WHERE reason IS NOT NULL",
    "p5_by_period": f"WITH {_REFS} SELECT ref_table, period, field, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_orphan_keys": f"WITH {_REFS} SELECT target_id AS key, count(*) AS refs, any_value(reason) AS reason FROM judged WHERE reason IN ('deleted', 'missing') GROUP BY target_id",
}
GENERAL_SQL["p5_incremental"] = GENERAL_SQL["p5_found"]
