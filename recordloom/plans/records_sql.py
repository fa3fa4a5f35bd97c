"""SQL twins of the record queries, written independently for a second engine."""

from __future__ import annotations

from recordloom.functions.porter import stem
from recordloom.functions.text import prefix_stem
from recordloom.plans.porter_sql import stems
from recordloom.sources.markdown import describe
from recordloom.plans.records import NOW_TEXT, QUERY, QUERY_ANY, QUERY_PHRASE, QUERY_PREFIX

NOW = f"TIMESTAMP '{NOW_TEXT}'"
AS_OF = "TIMESTAMP '2025-06-30 00:00:00'"
_REC = """rows_ AS (
  SELECT *, 'memory_records' AS ref_table FROM memory_records
  UNION ALL BY NAME SELECT * EXCLUDE (archived_at), 'archive_records' AS ref_table FROM archive_records),
records AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(contains(file_path, '/operator/'), false) DESC, ref_table DESC, loaded_at) AS rn FROM rows_) WHERE rn = 1),
active AS (SELECT * FROM records WHERE state = 'active')"""
_DAY = "86400000000"
_DUE = "TRY_CAST(regexp_replace(check_by, 'Z$', '') AS TIMESTAMP)"
_STALE = f"(coalesce(stale, false) OR (coalesce(kind, 'claim') <> 'observation' AND coalesce({NOW} > {_DUE}, false)))"
_KIND = "CASE WHEN regexp_matches(coalesce({0}, ''), '^(user)$', 'i') OR starts_with(lower(coalesce({0}, '')), 'human:') THEN 'operator' WHEN regexp_matches(coalesce({0}, ''), '^(migration-|.*-import$)', 'i') THEN 'import' ELSE 'agent' END"
_EFF = f"coalesce(source_kind, {_KIND.format('source')})"
_HAS = "coalesce(len(anchors), 0) > 0"
_WITNESS = f"coalesce(verified_with, CASE WHEN {_HAS} THEN 'anchor' END, 'assertion')"
_PLAIN = "trim(regexp_replace(array_to_string(list_filter(string_split(coalesce(body, ''), chr(10)), lambda x: NOT starts_with(x, '#')), ' '), '\\s+', ' ', 'g'))"
_LINE = f"CASE WHEN length({_PLAIN}) <= 120 THEN {_PLAIN} ELSE rtrim(substr({_PLAIN}, 1, 119)) || '…' END"
_DAYS = f"((epoch_us({NOW}) - epoch_us({{0}})) / {_DAY}.0)"
_AGE = f"greatest({_DAYS.format('coalesce(last_verified, created)')}, 0)"
_MARK = f"CASE WHEN coalesce(stale, false) THEN '⚠' WHEN {_HAS} THEN '⚓' ELSE '✓' || CAST(CAST(floor({_AGE}) AS BIGINT) AS VARCHAR) || 'd' END"
_HEAD = f"'- ' || id || ' ' || coalesce(type, 'observation') || ' [' || {_EFF} || '] ' || {_MARK} || ': ' || coalesce(title, '')"
_FORMAT = f"CASE WHEN {_LINE} <> '' THEN {_HEAD} || ' — ' || {_LINE} ELSE {_HEAD} END"
_TERM = "CASE type WHEN 'decision' THEN 180 ELSE 90 END"
_ROUTE = f"CASE WHEN kind = 'observation' OR type IS NULL THEN 'observations' WHEN {_EFF} = 'operator' THEN 'memory/operator/' || type || 's' ELSE 'memory/' || type || 's' END || '/' || id || '.md'"
_NORMAL = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda w: length(w) > 3))"
_KEY = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')[1:5], ' ')"
_TOKENS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_CANON = "CASE WHEN trim({0}) = '' THEN NULL WHEN starts_with(lower(trim({0})), 'ms_') THEN 'ms_' || upper(substr(trim({0}), 4)) ELSE lower(trim({0})) END"
_OVERLAP = "len(list_filter(coalesce({0}, []), lambda x: list_contains(coalesce({1}, []), x)))"
_SANITIZE = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
# What keeps the records of these tables from being loaded.
_LOAD = "CASE WHEN check_by IS NULL THEN 'check_by: no date' END"
_SECRET = "regexp_matches({0}, '(password|token|secret|api\\s*key)', 'i')"

_EDGES = ["refines", "supports", "depends_on", "conflicts_with", "supersedes", "superseded_by"]


def _edges(src: str = "records") -> str:
    parts = []
    for i, e in enumerate(_EDGES):
        values = "[superseded_by]" if e == "superseded_by" else f"coalesce({e}, [])"
        parts.append(f"SELECT id AS src, '{e}' AS edge_type, {i} AS edge_pos, k AS arr_pos, {_CANON.format('v')} AS dst FROM (SELECT id, unnest({values}) AS v, unnest(range(len({values}))) AS k FROM {src})")
    return "SELECT src, edge_type, CAST(edge_pos AS INTEGER) AS edge_pos, CAST(arr_pos AS INTEGER) AS arr_pos, dst FROM (" + " UNION ALL ".join(parts) + ") WHERE dst IS NOT NULL"


_FILES = """seen AS (SELECT id, loaded_at, coalesce(a.repo, '') AS repo, a.file AS file, a.sha AS sha FROM (SELECT id, loaded_at, unnest(anchors) AS a FROM rows_) WHERE a.file IS NOT NULL),
files AS (SELECT repo, file, sha AS current_sha FROM (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY loaded_at DESC, id DESC, sha DESC) AS rn FROM seen) WHERE rn = 1 AND length(file) % 11 <> 0),
anch AS (SELECT id, a.file AS file, min(a.sha) AS sha, coalesce(a.repo, '') AS repo FROM (SELECT id, unnest(anchors) AS a FROM active) WHERE a.file IS NOT NULL GROUP BY ALL),
drift AS (SELECT n.id, n.file, n.repo, CASE WHEN f.current_sha IS NULL THEN 'missing' WHEN f.current_sha = n.sha THEN 'unchanged' ELSE 'changed' END AS status FROM anch n LEFT JOIN files f USING (repo, file)),
drifted AS (SELECT id, count(DISTINCT file) AS files, 'anchor drift: ' || array_to_string(list_sort(list(DISTINCT file)), ', ') AS note FROM drift WHERE status <> 'unchanged' GROUP BY id),
renames AS (SELECT DISTINCT file AS old, file || 'x' AS new FROM seen WHERE length(file) % 11 = 0 AND ends_with(file, '.ts'))"""
_USES = f"uses AS (SELECT id, count(*) AS uses FROM usage_log WHERE id IS NOT NULL AND retrieved_at >= {NOW} - INTERVAL 30 DAY AND retrieved_at <= {NOW} GROUP BY id)"
_BOOST = "(log2(coalesce(uses, 0) + 1) * 0.25 + 1)"
_FRESH = f"coalesce(exp(-ln(2.0) * {_AGE} / CASE type WHEN 'decision' THEN 180 WHEN 'procedure' THEN 90 WHEN 'fact' THEN 45 END), 0)"
_SCORE = f"round(coalesce(CASE type WHEN 'decision' THEN 1.0 WHEN 'procedure' THEN 0.9 WHEN 'fact' THEN 0.8 END::DOUBLE, 0) * {_FRESH} * {_BOOST}, 6)"
_CONFLICT = f"""w AS (SELECT id, type, tags, unnest({_WORDS.format('title')}) AS t FROM {{0}} WHERE type IS NOT NULL),
v AS (SELECT id, type, tags, unnest({_WORDS.format('title')}) AS t FROM {{1}} WHERE type IS NOT NULL),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared_tokens, {_OVERLAP.format('any_value(a.tags)', 'any_value(b.tags)')} AS shared_tags
  FROM w a JOIN v b ON a.type = b.type AND a.t = b.t AND {{2}} GROUP BY a.id, b.id HAVING count(*) >= 2 AND {_OVERLAP.format('any_value(a.tags)', 'any_value(b.tags)')} > 0)"""
_CLASSES = f"""keyed AS (SELECT id, type, list_sort({_WORDS.format('title')}) AS words, list_sort(list_distinct(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL))) AS tags FROM active WHERE type IS NOT NULL),
class AS (SELECT type, words, tags, min(id) AS class_id, count(*) AS members FROM keyed GROUP BY ALL)"""
_DRAFTS = """drafts AS (SELECT 'new_' || id AS id, type, title, tags, source, source_kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM archive_records WHERE type IS NOT NULL) WHERE rn = 1),
live AS (SELECT * FROM active WHERE ref_table = 'memory_records')"""
_JUDGED = f"""judged AS (SELECT d.*, CASE WHEN lower(coalesce(trim(source), '')) IN ('', 'unknown') THEN 'source'
  WHEN EXISTS (SELECT 1 FROM live l WHERE l.type = d.type AND {_NORMAL.format('l.title')} = {_NORMAL.format('d.title')}) THEN 'duplicate'
  WHEN row_number() OVER (PARTITION BY type, {_NORMAL.format('d.title')} ORDER BY id) > 1 THEN 'duplicate in batch' END AS why FROM drafts d)"""
_NEAR = "near_ AS (SELECT id_a, id_b FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY shared_tokens DESC, shared_tags DESC, id_b) AS rn FROM pairs) WHERE rn = 1)"


def _hits(field: str, phrase: list[str], prefix: bool) -> str:
    def last(x: str) -> str:
        return f"starts_with({x}, '{phrase[-1]}')" if prefix else f"{x} = '{phrase[-1]}'"

    if len(phrase) == 1:
        return f"len(list_filter({field}, lambda w: {last('w')}))"
    tests = " AND ".join([f"{field}[i + {k}] = '{w}'" for k, w in enumerate(phrase[:-1])] + [last(f"{field}[i + {len(phrase) - 1}]")])
    return f"len(list_filter(range(1, len({field}) - {len(phrase) - 2}), lambda i: {tests}))"


_ALL_WORDS = f"""words_ AS (
  SELECT id, 't' AS f, unnest(x) AS w, unnest(range(len(x))) AS k FROM (SELECT id, {_TOKENS.format('title')} AS x FROM active)
  UNION ALL SELECT id, 'g', unnest(x), unnest(range(len(x))) FROM (SELECT id, {_TOKENS.format("array_to_string(tags, ' ')")} AS x FROM active)
  UNION ALL SELECT id, 'b', unnest(x), unnest(range(len(x))) FROM (SELECT id, {_TOKENS.format('body')} AS x FROM active)),
{stems("SELECT DISTINCT w FROM words_")},
lists_ AS (SELECT id, list(s ORDER BY k) FILTER (WHERE f = 't') AS tt, list(s ORDER BY k) FILTER (WHERE f = 'g') AS tg, list(s ORDER BY k) FILTER (WHERE f = 'b') AS tb FROM words_ JOIN stem_ USING (w) GROUP BY id),
tok AS (SELECT a.*, coalesce(tt, []) AS tt, coalesce(tg, []) AS tg, coalesce(tb, []) AS tb FROM active a LEFT JOIN lists_ USING (id))"""


def _bm25(terms: list[list[str]], prefix: bool, op: str, types: str = "", by: str = "") -> str:
    """CTEs ending in ``found(id, type, ..., bm25)``; words are compared by stem. ``by`` parts the corpus."""
    terms = [[stem(w) for w in t] for t in terms]
    f = ", ".join(f"5.0 * {_hits('tt', t, prefix)} + {_hits('tg', t, prefix)} + {_hits('tb', t, prefix)} AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 0.000001) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(terms)))
    test = f" {op} ".join(f"f{i} > 0" for i in range(len(terms)))
    group, join = (f", {by} AS part", f"JOIN stat ON stat.part = {by}") if by else ("", "CROSS JOIN stat")
    return f"""{_REC}, {_ALL_WORDS},
hit AS (SELECT *, len(tt) + len(tg) + len(tb) AS dl, {f} FROM tok),
stat AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {df}{group} FROM hit {"GROUP BY ALL" if by else ""}),
found AS (SELECT hit.*, round({score}, 6) AS bm25 FROM hit {join} WHERE ({test}) {types})"""


def _split(text: str) -> list[list[str]]:
    import re

    return [[w for w in re.split(r"[\W_]+", t) if w] for t in text.lower().split()]


_QT = _split(QUERY)
_RECENCY = f"1.0 / (1 + greatest({_DAYS.format('created')}, 0))"


def _bonus(phrase: str) -> str:
    return f"CASE WHEN contains(lower(title), '{phrase}') THEN 5 WHEN contains(lower(array_to_string(tags, ' ')), '{phrase}') THEN 4 WHEN contains(lower(body), '{phrase}') THEN 3 ELSE 0 END"


def _search(types: str = "") -> str:
    return f"""WITH {_bm25(_QT, False, 'AND', types)},
first_ AS (SELECT *, bm25 + {_bonus(QUERY)} AS raw, {_RECENCY} AS rec FROM (SELECT * FROM found ORDER BY bm25 DESC, id LIMIT 20)),
scored AS (SELECT *, round(raw / (SELECT CASE WHEN max(raw) > 0 THEN max(raw) ELSE 1 END FROM first_) * 0.4 + rec * 0.3, 6) AS score FROM first_),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, id LIMIT 10)"""


_NOTE = "replace(coalesce(title, ''), '|', '/')"
_DATE = "strftime(created, '%Y-%m-%d')"
_ACTIVE_T = "active_t AS (SELECT * FROM active WHERE type IS NOT NULL)"
_CHOSEN = "chosen AS (SELECT * FROM records WHERE type IN ('fact', 'decision', 'procedure') AND state IN ({0}))"
_NODES = f"""nodes AS (SELECT id, 'memory' AS node_type, type, coalesce(title, '') AS title, {_EFF} AS source_kind, {_WITNESS} AS verified_with, coalesce(stale, false) AS stale, state, NULL::VARCHAR AS path FROM chosen
  UNION ALL SELECT 'file:' || file, 'file', NULL, NULL, NULL, NULL, NULL, NULL, file FROM (SELECT DISTINCT a.file AS file FROM (SELECT unnest(anchors) AS a FROM chosen) WHERE a.file IS NOT NULL))"""


def _links(superseded: bool) -> str:
    kinds = "'refines', 'supports', 'depends_on', 'conflicts_with'" + (", 'supersedes'" if superseded else "")
    return f"""links AS (SELECT DISTINCT src, dst, edge_type FROM ({_edges('chosen')}) WHERE edge_type IN ({kinds}) AND dst IN (SELECT id FROM chosen)
  UNION SELECT id, 'file:' || a.file, 'anchors_to' FROM (SELECT id, unnest(anchors) AS a FROM chosen) WHERE a.file IS NOT NULL)"""


_GRAPH = f"{_REC}, {_CHOSEN.format(chr(39) + 'active' + chr(39))}, {_NODES}, {_links(False)}"
_EKEY = "src || '|' || dst || '|' || edge_type"


def _xml(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _dot(c: str) -> str:
    return f"replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ')"


def _datum(key: str, value: str) -> str:
    return f"'<data key=\"{key}\">' || {_xml(value)} || '</data>'"


_MEMORY_XML = " || ".join([
    _datum("node_type", "'memory'"), _datum("memory_type", "type"), _datum("title", "title"), _datum("source_kind", "source_kind"),
    _datum("verified_with", "verified_with"), _datum("stale", "CAST(stale AS VARCHAR)"), _datum("state", "state"),
])
_FILE_XML = " || ".join([_datum("node_type", "'file'"), _datum("path", "path")])

_OLD = f"""older AS (SELECT id, title, length(title) % 2 = 0 AS old, kind AS k0, type, state AS s0, check_by AS c0, supersedes AS sup0, anchors AS a0, superseded_by, supersede_reason, source, source_kind AS sk0, verified_with AS v0, stale AS st0,
    last_verified, ext, replace(file_path, 'operator/', '') AS was FROM records),
shaped AS (SELECT id, type, source, was, old, sk0, v0, {_KIND.format('source')} AS inferred, coalesce(sk0, {_KIND.format('source')}) AS source_kind, s0 AS state, c0 AS check_by, a0 AS anchors, sup0, last_verified, ext,
    superseded_by, supersede_reason, st0, CASE WHEN NOT old OR k0 = 'observation' THEN k0 END AS kind0, coalesce(CASE WHEN NOT old OR k0 = 'observation' THEN k0 END, 'claim') AS kind FROM older),
final AS (SELECT *, coalesce(v0, CASE WHEN {_HAS} AND last_verified IS NOT NULL THEN 'anchor' WHEN json_extract(ext, '$.last_verification.evidence') IS NOT NULL THEN 'evidence' WHEN source_kind = 'operator' THEN 'operator' ELSE 'assertion' END) AS witness,
    CASE WHEN state <> 'active' THEN 'archive/' || id || '.md' ELSE {_ROUTE} END AS target_path, coalesce(state = 'active' AND NOT coalesce(st0, false) AND {_DUE} < {NOW}, false) AS late FROM shaped),
planned AS (SELECT *, list_filter([
    CASE WHEN old AND state = 'active' THEN 'state captured -> active' WHEN old AND state = 'retired' THEN 'state decayed -> retired' END,
    CASE WHEN kind0 IS NULL THEN 'kind: claim (default)' END, CASE WHEN old AND check_by IS NOT NULL THEN 'decay_after -> check_by' END, CASE WHEN old AND len(sup0) > 0 THEN 'corrects -> supersedes' END,
    CASE WHEN (state = 'superseded' OR superseded_by IS NOT NULL) AND coalesce(supersede_reason, '') = '' THEN 'supersede_reason backfilled: "(predates reason tracking)"' END,
    CASE WHEN old AND {_HAS} THEN 'ext.code_anchors -> anchors' END, CASE WHEN old THEN 'confidence -> ext.legacy_confidence' END,
    CASE WHEN sk0 IS NULL THEN 'source_kind: ' || inferred || ' (inferred from "' || coalesce(source, '') || '")' END, CASE WHEN v0 IS NULL THEN 'verified_with: ' || witness || ' (inferred)' END,
    CASE WHEN late THEN 'stale: true (check_by in the past)' END, CASE WHEN target_path <> was THEN 'relocate -> ' || target_path END], lambda x: x IS NOT NULL) AS changes FROM final)"""
_LABEL = "CASE " + " ".join(f"WHEN starts_with(c, '{a}') THEN '{b}'" for a, b in (("state ", "state remapped"), ("kind:", "kind defaulted to claim"), ("decay_after", "decay_after -> check_by"), ("corrects", "corrects -> supersedes"), ("supersede_reason", "supersede_reason backfilled"), ("ext.code_anchors", "ext.code_anchors -> anchors"), ("confidence", "confidence -> ext.legacy_confidence"), ("source_kind", "source_kind inferred"), ("verified_with", "verified_with inferred"), ("stale:", "stale flagged"), ("relocate", "relocations queued"))) + " END"
_ASK = f"""ask AS (SELECT id, 'outdated' AS reason, length(source) % 2 = 0 AS override FROM records WHERE len(supersedes) > 0),
judge AS (SELECT a.id, CASE WHEN {_EFF} = 'operator' THEN a.reason || ' [override_operator used on operator-sourced record]' ELSE a.reason END AS reason,
  CASE WHEN state <> 'active' THEN 'is ' || state WHEN {_EFF} = 'operator' AND NOT override THEN 'operator record' END AS refused FROM ask a JOIN records r ON r.id = a.id)"""


def _chain(field: str) -> str:
    return f"""WITH {_REC}, e AS (SELECT DISTINCT src, dst FROM ({_edges()}) WHERE edge_type = '{field}' AND dst IN (SELECT id FROM records) AND src <> dst),
h2 AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src <> b.dst), h3 AS (SELECT DISTINCT a.src, b.dst FROM h2 a JOIN e b ON b.src = a.dst WHERE a.src <> b.dst)
SELECT src AS id, dst AS target, CAST(min(h) AS INTEGER) AS hops FROM (SELECT *, 1 AS h FROM e UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY src, dst"""


def _closure(field: str) -> str:
    return f"""c_{field}(src, dst) AS (SELECT src, dst FROM e_{field} UNION SELECT c.src, e.dst FROM c_{field} c JOIN e_{field} e ON e.src = c.dst)"""


_LINEAGE = f"""WITH RECURSIVE {_REC}, e_supersedes AS (SELECT DISTINCT src, dst FROM ({_edges()}) WHERE edge_type = 'supersedes' AND dst IN (SELECT id FROM records) AND src <> dst),
e_superseded_by AS (SELECT DISTINCT src, dst FROM ({_edges()}) WHERE edge_type = 'superseded_by' AND dst IN (SELECT id FROM records) AND src <> dst), {_closure('supersedes')}, {_closure('superseded_by')}"""


def _lineage_lists() -> str:
    chains = "".join(f", t_{f} AS ({_chain(f)})" for f in ("refines", "supports", "depends_on"))
    ways = {
        "ancestors": ("c_supersedes", "src", "dst"), "descendants": ("c_superseded_by", "src", "dst"),
    } | {f: (f"t_{f}", "id", "target") for f in ("refines", "supports", "depends_on")}
    lists = ", ".join(f"coalesce((SELECT list(DISTINCT {y} ORDER BY {y}) FROM {t} WHERE {t}.{x} = r.id AND {x} <> {y}), []) AS {n}" for n, (t, x, y) in ways.items())
    return f"{_LINEAGE}{chains} SELECT r.id, r.title, {lists} FROM records r"


_COSINE = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near_ AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(v.e, q.e), 6) AS similarity FROM v q CROSS JOIN v WHERE q.id % 100 = 0)"""
_DEP = f"dep AS (SELECT DISTINCT src AS id, dst AS target FROM ({_edges()}) WHERE edge_type = 'depends_on')"

SQL = {
    "scan_active": f"WITH {_REC} SELECT id, type, {_STALE} AS stale_effective FROM active",
    "scan_superseded": f"WITH {_REC} SELECT id FROM records WHERE state = 'superseded'",
    "get_by_id": f"WITH {_REC} SELECT id, state, title FROM records WHERE id = (SELECT id FROM usage_log WHERE starts_with(id, 'ms_') GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)",
    "resolve_collisions": f"WITH {_REC} SELECT id, ref_table, file_path, state FROM records",
    "layered_scan": f"WITH {_REC} SELECT id, layer FROM (SELECT m.id, m.layer, row_number() OVER (PARTITION BY m.id ORDER BY l.priority DESC NULLS LAST, m.layer NULLS FIRST, m.loaded_at) AS rn FROM rows_ m LEFT JOIN layers l ON l.name = m.layer) WHERE rn = 1",
    "layer_listing": f"WITH {_REC} SELECT name, path, priority, CASE WHEN writable THEN 'rw' ELSE 'ro' END AS mode, (SELECT count(DISTINCT id) FROM rows_ m WHERE m.layer = l.name) AS items FROM layers l",
    "usage_counts": f"WITH {_USES} SELECT * FROM uses",
    "usage_daily_layers": "SELECT layer, strftime(retrieved_at, '%Y-%m') AS month, count(*) AS uses FROM usage_log GROUP BY ALL",
    "parse_frontmatter": f"""WITH {_REC} SELECT id, kind, type, state, strftime(created, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created, source, CASE WHEN len(tags) > 0 THEN tags END AS tags, check_by, title, CASE WHEN len(anchors) > 0 THEN len(anchors) END::INTEGER AS n_anchors,
  coalesce(superseded_by, '') AS superseded_by, CAST(length(CASE WHEN starts_with(trim(body), '# ' || title || chr(10)) OR trim(body) = '# ' || title THEN trim(body) ELSE '# ' || title || chr(10) || chr(10) || trim(body) END) AS INTEGER) AS body_chars, {_LOAD} AS error FROM records""",
    "import_tables": f"WITH {_REC} SELECT id AS path, 0 AS row_no, [trim({_NOTE}), id] AS cells FROM records",
    "import_facts": f"""WITH {_REC} SELECT id AS path, trim({_NOTE}) || ' state' AS title, CASE WHEN {_SECRET.format('state')} THEN '[REDACTED]' ELSE state END AS body, list_filter([{_SANITIZE.format(f'trim({_NOTE})')}, 'state'], lambda x: x <> '') AS tags FROM records WHERE trim({_NOTE}) <> ''
  UNION ALL SELECT id, id, '[REDACTED]', [{_SANITIZE.format('id')}, 'fact'] FROM records""",
    "import_decisions": f"""WITH {_REC} SELECT id AS path, trim({_NOTE}) AS title, trim({_NOTE}) AS body, CAST(CAST(created AS DATE) AS TIMESTAMP) AS created FROM records WHERE trim({_NOTE}) <> ''
  UNION ALL SELECT id, id, CASE WHEN coalesce(source, '') <> '' THEN source ELSE id END, {NOW} FROM records""",
    "import_lessons": f"WITH {_REC} SELECT id AS path, substr(trim({_NOTE}) || ' — ' || id, 1, 80) AS title, trim({_NOTE}) || ' — ' || id AS body FROM records",
    "import_observations": f"WITH {_REC} SELECT id AS path, CASE WHEN type = 'decision' THEN 'decision' ELSE 'fact' END AS type, {_NOTE} AS title, CAST(CAST(created AS DATE) AS TIMESTAMP) AS created, 0.5::DOUBLE AS importance, CASE WHEN type = 'decision' THEN 'decision' ELSE 'habit' END AS raw_type FROM records",
    "import_dir": f"WITH {_REC} SELECT file_path AS path, CASE WHEN contains(file_path, 'procedures') THEN 'procedure' ELSE 'fact' END AS type, trim(regexp_extract(body, '(?m)^#\\s+(.+)$', 1)) AS title FROM records",
    "import_procedures": f"WITH {_REC} SELECT file_path AS path, trim(regexp_extract(body, '(?m)^#\\s+(.+)$', 1)) AS title FROM records WHERE contains(file_path, 'procedures/')",
    "detect_sources": f"""WITH {_REC} SELECT CASE WHEN contains(file_path, 'procedures/') THEN 'procedures' ELSE 'loose' END AS form, count(*) AS n FROM records GROUP BY 1
  UNION ALL SELECT unnest(['tables', 'observations']), count(*) FROM records""",
    "recent_activity": f"WITH {_REC} SELECT id, title, loaded_at FROM records WHERE loaded_at >= {NOW} - INTERVAL 60 DAY ORDER BY loaded_at DESC, id LIMIT 40",
    "git_rename_scan": f"WITH {_REC}, {_FILES} SELECT * FROM renames",
    "lazy_stale": f"WITH {_REC} SELECT id, coalesce(stale, false) AS stale_persisted, {_STALE} AS stale_effective FROM records",
    "valid_as_of": f"WITH {_REC} SELECT id FROM records WHERE (valid_from IS NULL OR valid_from <= {AS_OF}) AND (valid_to IS NULL OR {AS_OF} <= valid_to)",
    "decay_candidates": f"""WITH {_REC}, {_FILES}, d AS (SELECT *, CASE WHEN check_by IS NULL THEN coalesce(last_verified, created) + to_days({_TERM}) ELSE {_DUE} END AS due FROM active)
SELECT d.id, CASE WHEN coalesce({NOW} > due, false) THEN 'expired' ELSE 'drift' END AS reason, CAST(CASE WHEN coalesce({NOW} > due, false) THEN floor({_DAYS.format('due')}) ELSE 0 END AS INTEGER) AS days_expired
FROM d LEFT JOIN drifted x ON x.id = d.id WHERE coalesce({NOW} > due, false) OR x.id IS NOT NULL""",
    "validate_rows": f"WITH {_REC} SELECT id, CASE WHEN check_by IS NULL THEN 'check_by: no date' ELSE '' END || CASE WHEN valid_from > valid_to THEN CASE WHEN check_by IS NULL THEN '; ' ELSE '' END || 'valid_to: before valid_from' ELSE '' END AS errors FROM records",
    "schema_violations": """SELECT DISTINCT 'ms_' || lpad(CAST(header_id AS VARCHAR), 26, '0') AS id, errors FROM (SELECT header_id, array_to_string(list_filter([
  CASE WHEN created IS NULL OR NOT regexp_matches(created, '^\\d{4}-\\d\\d-\\d\\dT') THEN 'created: missing' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source: empty' END,
  CASE WHEN check_by IS NULL OR NOT (check_by = 'never' OR regexp_matches(check_by, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$')) THEN 'check_by: no date' END], lambda x: x IS NOT NULL), '; ') AS errors FROM inbox_headers) WHERE errors <> ''""",
    "infer_source_kind": f"WITH {_REC} SELECT DISTINCT source, {_KIND.format('source')} AS inferred FROM rows_",
    "effective_source_kind": f"WITH {_REC} SELECT id, {_EFF} AS kind_of_source, CASE WHEN {_EFF} = 'operator' THEN 'operator' ELSE 'standard' END AS tier FROM records",
    "storage_tier": f"WITH {_REC} SELECT CASE WHEN {_EFF} = 'operator' THEN 'operator' ELSE 'standard' END AS tier, count(*) AS n FROM records GROUP BY 1",
    "canonical_source": "SELECT DISTINCT s AS source, b AS bucket FROM (SELECT source || x AS s, source || CASE WHEN contains(x, 'session') THEN ' session' ELSE '' END AS b FROM (SELECT source, unnest(['', '-' || strftime(read_at, '%Y-%m-%d'), ' session ' || strftime(read_at, '%Y-%m-%d') || ' b']) AS x FROM inbox_headers WHERE source IS NOT NULL))",
    "witness_of": f"WITH {_REC} SELECT id, {_WITNESS} AS witness FROM records",
    "infer_verified_with": f"WITH {_REC} SELECT id, CASE WHEN {_HAS} AND last_verified IS NOT NULL THEN 'anchor' WHEN json_extract(ext, '$.last_verification.evidence') IS NOT NULL THEN 'evidence' WHEN {_EFF} = 'operator' THEN 'operator' ELSE 'assertion' END AS witness FROM records",
    "preview": f"WITH {_REC} SELECT id, substr({_PLAIN}, 1, 160) AS preview FROM records",
    "truncate_body": f"WITH {_REC} SELECT id, {_LINE} AS line FROM records",
    "witness_marker": f"WITH {_REC} SELECT id, {_MARK} AS marker FROM records",
    "format_line": f"WITH {_REC} SELECT id, {_FORMAT} AS line FROM records",
    "default_check_by": f"WITH {_REC} SELECT id, created + to_days({_TERM}) AS due FROM records",
    "parse_ttl": "SELECT DISTINCT ttl, CASE WHEN ttl = 'never' THEN -1 WHEN regexp_full_match(ttl, '\\d{1,6}[dhm]') THEN CAST(ttl[:-2] AS BIGINT) * CASE right(ttl, 1) WHEN 'd' THEN 86400000000 WHEN 'h' THEN 3600000000 ELSE 60000000 END END AS micros FROM (SELECT unnest(['7d', '12h', '90m', 'never', 'x', check_by]) AS ttl FROM inbox_headers) WHERE ttl IS NOT NULL",
    "parse_tags": f"WITH {_REC} SELECT id, list_filter(list_transform(coalesce(tags, []), lambda t: trim(t)), lambda t: t <> '') AS tags FROM records",
    "redact": f"WITH {_REC} SELECT id, CASE WHEN {_SECRET.format('title')} THEN '[REDACTED]' ELSE title END AS shown FROM records",
    "sanitize_tag": f"WITH {_REC} SELECT DISTINCT tag, {_SANITIZE.format('tag')} AS clean FROM (SELECT unnest(tags) AS tag FROM records)",
    "estimate_tokens": f"WITH {_REC} SELECT id, CAST(ceil(length(body) / 4.0) AS INTEGER) AS tokens FROM records",
    "title_functions": f"WITH {_REC} SELECT id, {_NORMAL.format('title')} AS normal, array_to_string(list_sort({_WORDS.format('title')}), ' ') AS words, {_KEY.format('title')} AS key FROM records",
    "escape_functions": f"""WITH {_REC}, t AS (SELECT id, title || ' <&> "q" \\ ' || chr(10) AS x FROM records) SELECT id, {_xml('x')} AS xml, {_dot('x')} AS dot FROM t""",
    "blob_sha": "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS sha FROM documents WHERE text IS NOT NULL",
    "route_path": f"WITH {_REC} SELECT id, {_ROUTE} AS path FROM records",
    "anchor_drift_repos": f"""WITH {_REC}, {_FILES}, near_ AS (SELECT DISTINCT a.repo AS repo FROM (SELECT unnest(anchors) AS a FROM memory_records WHERE layer = 'project') WHERE a.repo IS NOT NULL)
SELECT id, file, repo, CASE WHEN repo <> '' AND repo NOT IN (SELECT repo FROM near_) THEN 'repo_unavailable' ELSE status END AS status FROM drift""",
    "anchor_drift_join": f"WITH {_REC}, {_FILES} SELECT id, file, repo, status FROM drift",
    "rename_join": f"WITH {_REC}, {_FILES} SELECT d.id, d.file, r.new AS renamed_to FROM drift d LEFT JOIN renames r ON r.old = d.file WHERE status = 'missing'",
    "drift_agg": f"WITH {_REC}, {_FILES} SELECT id, CAST(files AS INTEGER) AS files, note FROM drifted",
    "edge_resolve": f"WITH {_REC}, e AS ({_edges()}) SELECT edge_type, count(*) AS links, count(r.title) AS resolved FROM e LEFT JOIN records r ON r.id = e.dst GROUP BY edge_type",
    "conflict_selfjoin": f"""WITH {_REC}, {_CLASSES},
pairs AS (SELECT a.class_id AS id_a, b.class_id AS id_b, len(list_intersect(a.words, b.words)) AS shared_tokens, len(list_intersect(a.tags, b.tags)) AS shared_tags FROM class a JOIN class b
  ON a.type = b.type AND (a.class_id < b.class_id OR a.class_id = b.class_id AND a.members > 1) AND list_has_any(a.words, b.words) AND list_has_any(a.tags, b.tags))
SELECT id_a, id_b, CAST(shared_tokens AS INTEGER) AS shared_tokens, CAST(shared_tags AS INTEGER) AS shared_tags FROM pairs WHERE shared_tokens >= 2""",
    "conflict_members": f"WITH {_REC}, {_CLASSES} SELECT id, class_id FROM keyed JOIN class USING (type, words, tags)",
    "title_bucket_pairs": f"""WITH {_REC}, k AS (SELECT id, type, {_KEY.format('title')} AS key FROM active WHERE type IS NOT NULL), n AS (SELECT type, key, min(id) AS class_id, count(*) AS members FROM k WHERE key <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT id, class_id, members FROM k JOIN n USING (type, key)""",
    "declared_conflicts": f"WITH {_REC}, e AS (SELECT DISTINCT least(src, dst) AS id_a, greatest(src, dst) AS id_b FROM ({_edges('active')}) WHERE edge_type = 'conflicts_with') SELECT id_a, id_b, coalesce(a.title, '(not in active set)') AS title_b FROM e LEFT JOIN active a ON a.id = e.id_b",
    "refuse_anti": f"WITH {_REC}, {_DRAFTS}, {_JUDGED} SELECT id, why AS reason FROM judged WHERE why IS NOT NULL",
    "neighbour_rank": f"WITH {_REC}, {_DRAFTS}, {_CONFLICT.format('drafts', 'live', 'a.id <> b.id')}, {_NEAR} SELECT id_a, id_b FROM near_",
    "remember": f"""WITH {_REC}, {_DRAFTS}, {_JUDGED}, good AS (SELECT * FROM judged WHERE why IS NULL), {_CONFLICT.format('good', 'live', 'a.id <> b.id')}, {_NEAR}
SELECT g.id, g.type, g.title, CASE WHEN NOT (coalesce(l.source_kind, {_KIND.format('l.source')}) = 'operator' AND coalesce(g.source_kind, {_KIND.format('g.source')}) = 'agent') THEN n.id_b END AS conflicts_with_id
FROM good g LEFT JOIN near_ n ON n.id_a = g.id LEFT JOIN live l ON l.id = n.id_b""",
    "tag_overlap": f"""WITH {_REC}, e AS (SELECT DISTINCT src, dst FROM ({_edges()}) WHERE edge_type = 'refines')
SELECT src, dst, CAST({_OVERLAP.format('a.tags', 'b.tags')} AS INTEGER) AS tags, CAST(len(list_intersect({_WORDS.format('a.title')}, {_WORDS.format('b.title')})) AS INTEGER) AS words FROM e JOIN records a ON a.id = src JOIN records b ON b.id = dst""",
    "usage_join": f"WITH {_REC}, {_USES} SELECT r.id, coalesce(uses, 0) AS uses, round({_BOOST}, 6) AS boost FROM records r LEFT JOIN uses u ON u.id = r.id",
    "count_by_state": f"WITH {_REC} SELECT state, count(*) AS n FROM records GROUP BY state",
    "count_by_type": f"WITH {_REC}, {_ACTIVE_T} SELECT type, count(*) AS n FROM active_t GROUP BY type",
    "count_by_witness": f"WITH {_REC}, {_ACTIVE_T} SELECT coalesce(verified_with, 'assertion') AS witness, count(*) AS n FROM active_t GROUP BY 1",
    "count_stale_drifted": f"WITH {_REC}, {_FILES}, {_ACTIVE_T} SELECT count(*) FILTER (WHERE stale) AS stale, count(d.id) AS drifted FROM active_t a LEFT JOIN drifted d ON d.id = a.id",
    "status_report": f"""WITH {_REC}, {_ACTIVE_T} SELECT 'state' AS section, state AS value, count(*) AS n FROM records WHERE state IS NOT NULL GROUP BY state UNION ALL SELECT 'type', type, count(*) FROM active_t GROUP BY type
  UNION ALL SELECT 'witness', coalesce(verified_with, 'assertion'), count(*) FROM active_t GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM records""",
    "source_kind_table": f"WITH {_REC} SELECT coalesce(nullif(source, ''), '(unset)') AS source, coalesce(nullif(source, ''), '(unset)') AS bucket, {_KIND.format('source')} AS inferred, count(*) AS n FROM records GROUP BY ALL",
    "sweep": f"WITH {_REC} SELECT id FROM active WHERE {_STALE}",
    "sweep_candidates": f"WITH {_REC} SELECT id, title FROM active WHERE stale AND NOT ({_HAS}) AND coalesce(verified_with, 'assertion') = 'assertion'",
    "corpus_stats": f"WITH {_REC}, t AS (SELECT len({_TOKENS.format('title')}) + len({_TOKENS.format(chr(97) + 'rray_to_string(tags, ' + chr(39) + ' ' + chr(39) + ')')}) + len({_TOKENS.format('body')}) AS n FROM active) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean FROM t",
    "freshness": f"WITH {_REC} SELECT id, round({_FRESH}, 6) AS freshness FROM records",
    "boot_scores": f"WITH {_REC}, {_USES} SELECT a.id, {_SCORE} AS score FROM active a LEFT JOIN uses u ON u.id = a.id",
    "boot_rank": f"WITH {_REC}, {_USES} SELECT a.id, {_SCORE} AS score FROM active a LEFT JOIN uses u ON u.id = a.id ORDER BY score DESC, a.id LIMIT 20",
    "pinned_topk": f"WITH {_REC} SELECT id, last_verified FROM active WHERE pinned ORDER BY last_verified DESC NULLS LAST, id LIMIT 5",
    "recent_topk": f"WITH {_REC} SELECT id, created FROM active ORDER BY created DESC, id LIMIT 5",
    "limit_per_layer": f"WITH {_REC} SELECT layer, id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY created DESC, id) AS n FROM active) WHERE n <= 3",
    "fts_tokenize": f"WITH {_REC} SELECT id, {_TOKENS.format('title')} AS title_tokens, {_TOKENS.format(chr(97) + 'rray_to_string(tags, ' + chr(39) + ' ' + chr(39) + ')')} AS tag_tokens FROM records",
    "fts_and": f"WITH {_bm25(_QT, False, 'AND')} SELECT id, bm25 FROM found",
    "fts_or": f"WITH {_bm25(_QT, False, 'OR')} SELECT id, bm25 FROM found",
    "fts_prefix": f"WITH {_bm25([[prefix_stem(t)] for t in QUERY_PREFIX.split()], True, 'AND')} SELECT id, bm25 FROM found",
    "fts_phrase_term": f"WITH {_bm25(_split(QUERY_PHRASE), False, 'AND')} SELECT id, bm25 FROM found",
    "fts_bm25": f"WITH {_bm25(_QT, False, 'AND')} SELECT id, bm25 FROM found ORDER BY bm25 DESC, id LIMIT 10",
    "fts_fallback": f"WITH {_bm25(_split(QUERY_ANY), False, 'OR')} SELECT id, bm25 FROM found",
    "fts_index_cache": f"WITH {_REC}, {_ALL_WORDS} SELECT s AS term, count(DISTINCT id) AS df, count(*) AS tf FROM words_ JOIN stem_ USING (w) GROUP BY s",
    "fts_porter": f"WITH {_REC}, {_ALL_WORDS} SELECT w AS term, s AS stem FROM stem_",
    "phrase_bonus": f"WITH {_REC}, b AS (SELECT id, {_bonus('the hidden router')} AS bonus FROM active) SELECT id, bonus FROM b WHERE bonus > 0",
    "recency": f"WITH {_REC} SELECT id, round({_RECENCY}, 6) AS recency FROM records",
    "search_rerank": f"{_search()} SELECT rank, id, bm25, score FROM ranked",
    "search_types": f"{_search('AND type = ' + chr(39) + 'decision' + chr(39))} SELECT rank, id, score FROM ranked",
    "search_as_of": f"{_search()} SELECT rank, id FROM ranked WHERE (valid_from IS NULL OR valid_from <= {AS_OF}) AND (valid_to IS NULL OR {AS_OF} <= valid_to)",
    "cosine_similarity": f"WITH {_COSINE} SELECT query_id, id, similarity FROM near_",
    "cosine_rerank": f"WITH {_COSINE} SELECT query_id, id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near_) WHERE rank <= 10",
    "edges_view": f"WITH {_REC} {_edges()}",
    "relation_chain": _chain("refines"),
    "relation_chain_depends_on": _chain("depends_on"),
    "relation_chain_supports": _chain("supports"),
    "lineage_ancestors": f"{_LINEAGE} SELECT src AS id, dst AS ancestor FROM c_supersedes WHERE src <> dst",
    "lineage_descendants": f"{_LINEAGE} SELECT src AS id, dst AS descendant FROM c_superseded_by WHERE src <> dst",
    "get_with_lineage": _lineage_lists(),
    "serialize_record": f"""WITH {_REC} SELECT id, true AS written, '---' || chr(10) || 'id: "' || id || '"' AS head FROM records""",
    "observe": f"""SELECT doc_id, substr(trim(string_split(trim(text), chr(10))[1]), 1, 120) AS title, CASE doc_id % 3 WHEN 0 THEN {NOW} + INTERVAL 12 HOUR WHEN 2 THEN {NOW} + INTERVAL 7 DAY END AS expires, coalesce(source, 'agent') AS source FROM documents WHERE trim(text) <> ''""",
    "operator_guard": f"WITH {_REC}, {_ASK} SELECT * FROM judge",
    "supersede_retract": f"WITH {_REC}, {_ASK} SELECT r.id, CASE WHEN j.id IS NOT NULL THEN 'superseded' ELSE r.state END AS state, CASE WHEN j.id IS NULL THEN r.superseded_by END AS superseded_by, CASE WHEN j.id IS NOT NULL THEN j.reason ELSE r.supersede_reason END AS supersede_reason FROM records r LEFT JOIN judge j ON j.id = r.id AND j.refused IS NULL",
    "supersede_replace": f"""WITH {_REC}, {_ASK}, ok AS (SELECT * FROM judge WHERE refused IS NULL)
SELECT r.id, CASE WHEN j.id IS NOT NULL THEN 'superseded' ELSE r.state END AS state, CASE WHEN j.id IS NOT NULL THEN 'next_' || r.id ELSE r.superseded_by END AS superseded_by, CASE WHEN j.id IS NOT NULL THEN j.reason ELSE r.supersede_reason END AS supersede_reason, r.title, r.check_by FROM records r LEFT JOIN ok j ON j.id = r.id
UNION ALL SELECT 'next_' || r.id, 'active', NULL, 'outdated', r.title, strftime({NOW} + to_days({_TERM}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' FROM records r JOIN ok j ON j.id = r.id""",
    "supersede_merge": f"""WITH {_REC}, ask AS (SELECT src AS id, min(dst) AS into_ FROM ({_edges()}) WHERE edge_type = 'refines' GROUP BY src),
going AS (SELECT a.id, a.into_ FROM ask a JOIN records r ON r.id = a.id JOIN active s ON s.id = a.into_ WHERE a.id <> a.into_ AND r.state = 'active' AND coalesce(r.source_kind, {_KIND.format('r.source')}) <> 'operator'),
more AS (SELECT into_ AS id, list(DISTINCT id) AS ids FROM going GROUP BY into_)
SELECT r.id, CASE WHEN g.id IS NOT NULL THEN 'superseded' ELSE r.state END AS state, CASE WHEN g.id IS NOT NULL THEN g.into_ ELSE r.superseded_by END AS superseded_by,
  CAST(CASE WHEN m.id IS NOT NULL THEN len(list_distinct(list_concat(coalesce(r.supersedes, []), m.ids))) ELSE coalesce(len(r.supersedes), 0) END AS INTEGER) AS n_supersedes FROM records r LEFT JOIN going g ON g.id = r.id LEFT JOIN more m ON m.id = r.id""",
    "relate": f"""WITH {_REC}, {_DEP}, ok AS (SELECT id, list(target) AS t FROM dep WHERE id <> target AND target IN (SELECT id FROM records) GROUP BY id) SELECT r.id, CAST(len(list_distinct(list_concat(coalesce(r.supports, []), ok.t))) AS INTEGER) AS n_supports FROM records r JOIN ok ON ok.id = r.id""",
    "relate_refused": f"WITH {_REC}, {_DEP} SELECT id, target FROM dep WHERE id = target OR target NOT IN (SELECT id FROM records)",
    "verify": f"""WITH {_REC}, {_FILES}, st AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE status <> 'unchanged') AS bad FROM drift GROUP BY id),
j AS (SELECT a.*, n, CASE WHEN bad > 0 THEN 'needs_review' WHEN n > 0 THEN 'verified' WHEN length(title) % 2 <> 0 THEN 'refused' ELSE 'verified_inferred' END AS status FROM active a LEFT JOIN st ON st.id = a.id)
SELECT id, status, CASE WHEN starts_with(status, 'verified') THEN CASE WHEN n > 0 THEN 'anchor' WHEN {_KIND.format('source')} = 'operator' THEN 'operator' ELSE 'evidence' END ELSE coalesce(verified_with, 'assertion') END AS verified_with,
  CASE WHEN starts_with(status, 'verified') AND check_by IS DISTINCT FROM 'never' THEN strftime({NOW} + to_days({_TERM}), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE check_by END AS check_by FROM j""",
    "archive_move": f"WITH {_REC} SELECT id, CASE WHEN state = 'active' AND {_STALE} THEN 'retired' ELSE state END AS state, CASE WHEN state = 'active' AND {_STALE} THEN 'archive/' || id || '.md' ELSE file_path END AS file_path FROM records",
    "export_nodes": f"WITH {_REC}, {_CHOSEN.format(chr(39) + 'active' + chr(39) + ', ' + chr(39) + 'superseded' + chr(39))}, {_NODES} SELECT * FROM nodes",
    "export_edges": f"WITH {_REC}, {_CHOSEN.format(chr(39) + 'active' + chr(39) + ', ' + chr(39) + 'superseded' + chr(39))}, {_links(True)} SELECT * FROM links",
    "export_jsonl": f"""WITH {_GRAPH} SELECT 'node' AS kind, id AS key, CASE node_type WHEN 'file' THEN '{{"kind":"node","node_type":"file","id":' || to_json(id)::VARCHAR || ',"path":' || to_json(path)::VARCHAR || '}}'
  ELSE '{{"kind":"node","node_type":"memory","id":' || to_json(id)::VARCHAR || ',"type":"' || type || '","title":' || to_json(title)::VARCHAR || ',"source_kind":"' || source_kind || '","verified_with":"' || verified_with || '","stale":' || CAST(stale AS VARCHAR) || ',"state":"' || state || '"}}' END AS line FROM nodes
UNION ALL SELECT 'edge', {_EKEY}, '{{"kind":"edge","from":' || to_json(src)::VARCHAR || ',"to":' || to_json(dst)::VARCHAR || ',"type":"' || edge_type || '"}}' FROM links""",
    "export_graphml": f"""WITH {_GRAPH} SELECT 'node' AS kind, id AS key, '<node id="' || {_xml('id')} || '">' || CASE node_type WHEN 'file' THEN {_FILE_XML} ELSE {_MEMORY_XML} END || '</node>' AS line FROM nodes
UNION ALL SELECT 'edge', {_EKEY}, '<edge id="e' || substr(sha1({_EKEY}), 1, 16) || '" source="' || {_xml('src')} || '" target="' || {_xml('dst')} || '">' || {_datum('edge_type', 'edge_type')} || '</edge>' FROM links""",
    "export_dot": f"""WITH {_GRAPH} SELECT 'node' AS kind, id AS key, '"' || {_dot('id')} || '" [' || CASE node_type WHEN 'file' THEN 'label="' || {_dot('path')} || '", shape="octagon", color="gray"'
  ELSE 'label="' || {_dot('title')} || '", shape="' || CASE type WHEN 'fact' THEN 'box' WHEN 'decision' THEN 'diamond' ELSE 'ellipse' END || '", color="' || CASE type WHEN 'fact' THEN 'blue' WHEN 'decision' THEN 'orange' ELSE 'green' END || '", style="rounded' || CASE WHEN stale THEN ',dashed' ELSE '' END || '"' END || '];' AS line FROM nodes
UNION ALL SELECT 'edge', {_EKEY}, '"' || {_dot('src')} || '" -> "' || {_dot('dst')} || '" [label="' || edge_type || '", color="' || CASE edge_type WHEN 'conflicts_with' THEN 'orange", style="dotted"' WHEN 'refines' THEN 'blue"' WHEN 'supports' THEN 'green"' WHEN 'depends_on' THEN 'purple"' ELSE 'gray", penwidth="0.5"' END || '];' FROM links""",
    "normalize_legacy": f"WITH {_REC} SELECT id, coalesce(kind, 'claim') AS kind, state, check_by, CAST(coalesce(len(anchors), 0) AS INTEGER) AS n_anchors, CAST(coalesce(len(supersedes), 0) AS INTEGER) AS n_supersedes FROM records",
    "migrate_apply": f"""WITH {_REC}, {_OLD}, gone AS (SELECT was <> target_path AS moves FROM planned WHERE len(changes) > 0 AND check_by IS NOT NULL)
SELECT CASE WHEN moves THEN 'moved' ELSE 'written' END AS outcome, count(*) AS n FROM gone GROUP BY 1""",
    "migrate_plan": f"WITH {_REC}, {_OLD} SELECT id, array_to_string(changes, '; ') AS changes, target_path FROM planned",
    "migration_summary": f"WITH {_REC}, {_OLD} SELECT {_LABEL} AS label, count(*) AS n FROM (SELECT unnest(changes) AS c FROM planned) GROUP BY 1",
    "operator_relocations": f"WITH {_REC}, {_OLD} SELECT id, was AS from_path, target_path AS to_path, source FROM planned WHERE target_path <> was AND contains(target_path, 'memory/operator')",
    "union_layers": f"WITH {_REC} SELECT 'all' AS layer, count(DISTINCT id) AS n FROM rows_ UNION ALL SELECT layer, count(DISTINCT id) FROM rows_ GROUP BY layer",
    "same_ids_across_formats": f"WITH {_GRAPH} SELECT 'node' AS kind, id AS key, CAST(3 AS BIGINT) AS forms FROM nodes UNION ALL SELECT 'edge', {_EKEY}, 3 FROM links",
    "attention_list": f"""WITH {_REC}, {_FILES} SELECT a.id, coalesce(note, 'check-by passed ' || CAST(greatest(coalesce(CAST(floor({_DAYS.format(_DUE)}) AS INTEGER), 0), 0) AS VARCHAR) || 'd ago') AS note, note IS NOT NULL AS is_drift,
  CASE WHEN note IS NOT NULL THEN 0 ELSE greatest(coalesce(CAST(floor({_DAYS.format(_DUE)}) AS INTEGER), 0), 0) END AS overdue FROM active a LEFT JOIN drifted d ON d.id = a.id WHERE note IS NOT NULL OR ({_STALE} AND coalesce(kind, 'claim') <> 'observation')""",
}
SQL["attention_topk"] = SQL["attention_list"] + " ORDER BY is_drift DESC, overdue DESC, a.id LIMIT 3"
SQL |= {
    "fts_meta_join": f"WITH {_bm25(_QT, False, 'AND', 'AND type IN (' + chr(39) + 'fact' + chr(39) + ', ' + chr(39) + 'decision' + chr(39) + ')')} SELECT id, type, bm25 FROM found",
    "hit_hydrate": f"{_search()} SELECT r.id, r.title, k.rank FROM ranked k JOIN records r ON r.id = k.id",
    "edge_semi_filter": f"WITH {_GRAPH} SELECT edge_type, count(*) AS n FROM links GROUP BY edge_type",
    "layer_overlay": SQL["layered_scan"].replace("SELECT id, layer FROM (SELECT m.id", "SELECT layer, count(*) AS n FROM (SELECT m.id", 1) + " GROUP BY layer",
    "token_overlap": SQL["tag_overlap"],
    "max_normalise": f"WITH {_bm25(_QT, False, 'AND')} SELECT id, round(bm25 / (SELECT max(bm25) FROM found), 6) AS relevance FROM found",
    "usage_boost": SQL["usage_join"],
    "minus_attention": f"WITH t AS ({SQL['attention_list']}), top AS (SELECT id FROM t ORDER BY is_drift DESC, overdue DESC, id LIMIT 3), {_REC} SELECT id FROM active WHERE id NOT IN (SELECT id FROM top)",
    "minus_pinned": f"WITH {_REC}, top AS (SELECT id FROM active WHERE pinned ORDER BY last_verified DESC NULLS LAST, id LIMIT 5) SELECT id FROM active WHERE id NOT IN (SELECT id FROM top)",
    "dedupe_edges": f"WITH {_REC} SELECT src, edge_type, dst FROM ({_edges()}) GROUP BY ALL",
}
SQL["scan_records"] = f"WITH {_REC} SELECT id, state, title, regexp_extract('/' || file_path, '/(memory|observations|archive)/', 1) AS area, contains('/' || file_path, '/memory/operator/') AS is_operator, {_LOAD} AS error FROM records"
SQL["fts_indexed"] = SQL["fts_and"]
SQL["anchor_merge"] = f"""WITH {_REC}, {_FILES}, fresh AS (SELECT id, list(file ORDER BY file) AS fs, list(file || '@' || sha ORDER BY file) AS txt FROM (
  SELECT d.id, d.file, arg_min(f.current_sha, d.repo) AS sha FROM drift d JOIN files f USING (repo, file) WHERE d.status = 'changed' GROUP BY d.id, d.file) GROUP BY id),
kept AS (SELECT a.id, fs, txt, list_transform(list_filter(coalesce(anchors, []), lambda x: NOT list_contains(fs, x.file)), lambda x: x.file || '@' || x.sha) AS old FROM active a JOIN fresh f ON f.id = a.id)
SELECT id, CAST(len(old) + len(fs) AS INTEGER) AS n, array_to_string(list_concat(old, txt), ' ') AS anchors FROM kept"""


def _walk(seeds: str, edges: str, depth: int, cap: int = 50) -> str:
    """CTEs ending in ``walk(id, from_id, edge_type, hops, pos)`` from ``start(id, pos)``."""
    out = [
        f"start AS ({seeds})", f"links_ AS ({edges})",
        "far0 AS (SELECT id, id AS from_id, NULL::VARCHAR AS edge_type, 0 AS hops, CAST(pos AS BIGINT) AS pos FROM start)",
    ]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM far{j}" for j in range(k))
        taken = " + ".join(f"(SELECT count(*) FROM far{j})" for j in range(1, k)) or "0"
        out.append(
            f"""step{k} AS (SELECT e.dst, f.pos, e.edge_pos, e.arr_pos, f.from_id, e.edge_type, row_number() OVER (PARTITION BY e.dst ORDER BY f.pos, e.edge_pos, e.arr_pos, f.from_id, e.edge_type) AS rn FROM links_ e JOIN far{k - 1} f ON f.id = e.src WHERE e.dst NOT IN ({seen})),
far{k} AS (SELECT dst AS id, from_id, edge_type, {k} AS hops, {taken} + row_number() OVER (ORDER BY pos, edge_pos, arr_pos, dst) AS pos FROM step{k} WHERE rn = 1 QUALIFY {taken} + row_number() OVER (ORDER BY pos, edge_pos, arr_pos, dst) <= {cap})"""
        )
    return ", ".join([
        *out,
        "walk AS (" + " UNION ALL ".join(f"SELECT id, from_id, edge_type, CAST(hops AS INTEGER) AS hops, pos FROM far{k}" for k in range(1, depth + 1)) + ")",
    ])


_BUSY = f"SELECT src AS id, row_number() OVER (ORDER BY count(*) DESC, src) AS pos FROM ({_edges('active')}) GROUP BY src ORDER BY count(*) DESC, src LIMIT 10"
_BY_LAYER = f"""WITH {_bm25(_QT, False, 'AND', by="coalesce(layer, '')")},
placed AS (SELECT f.*, coalesce(f.layer, '') AS from_layer, l.priority FROM found f LEFT JOIN layers l ON l.name = coalesce(f.layer, '')),
first_ AS (SELECT *, bm25 + {_bonus(QUERY)} AS raw, {_RECENCY} AS rec FROM placed QUALIFY row_number() OVER (PARTITION BY from_layer ORDER BY bm25 DESC, id) <= 20),
scored AS (SELECT *, round(raw / CASE WHEN max(raw) OVER (PARTITION BY from_layer) > 0 THEN max(raw) OVER (PARTITION BY from_layer) ELSE 1 END * 0.4 + rec * 0.3, 6) AS score FROM first_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY from_layer ORDER BY score DESC, id) AS rank FROM scored)
SELECT from_layer, CAST(rank AS INTEGER) AS rank, id FROM ranked WHERE rank <= 10 ORDER BY priority DESC NULLS LAST, from_layer, rank LIMIT 10"""


def _fold(items: str, budget: int, limit: int, used: str, skip: bool) -> str:
    """CTE ``walk_``: the greedy fill of one budget over ``items(n, section, pos, id, cost, cap)`` in the order of n."""
    fresh, count = "i.section <> w.section", "CASE WHEN i.section <> w.section THEN 0 ELSE w.cnt END"
    take = f"(NOT (CASE WHEN {fresh} THEN false ELSE w.closed END) AND {count} < i.cap AND w.total < {limit} AND NOT (w.used + i.cost > {budget} AND w.total > 0))"
    return f"""items AS ({items}),
walk_(n, section, pos, id, cost, taken, used, total, cnt, closed) AS (
  SELECT CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), '', 0, false, CAST({used} AS BIGINT), 0, 0, false
  UNION ALL SELECT i.n, i.section, i.pos, i.id, i.cost, {take}, w.used + CASE WHEN {take} THEN i.cost ELSE 0 END, w.total + CAST({take} AS INTEGER), {count} + CAST({take} AS INTEGER),
    (CASE WHEN {fresh} THEN false ELSE w.closed END) OR (NOT {take} AND {str(not skip).lower()}) FROM walk_ w JOIN items i ON i.n = w.n + 1)"""


_TAKEN = "SELECT section, CAST(pos AS INTEGER) AS pos, id, cost, taken FROM walk_ WHERE n > 0"
_COST = "CAST(ceil((length({0}) + 1) / 4.0) AS INTEGER)"
_BOOT = f"""{_FILES}, {_USES},
att AS (SELECT a.*, note, note IS NOT NULL AS is_drift, CASE WHEN note IS NOT NULL THEN 0 ELSE greatest(coalesce(CAST(floor({_DAYS.format(_DUE)}) AS INTEGER), 0), 0) END AS overdue,
  coalesce(note, 'check-by passed ' || CAST(greatest(coalesce(CAST(floor({_DAYS.format(_DUE)}) AS INTEGER), 0), 0) AS VARCHAR) || 'd ago') AS said FROM active a LEFT JOIN drifted d ON d.id = a.id WHERE note IS NOT NULL OR ({_STALE} AND coalesce(kind, 'claim') <> 'observation')),
shown AS (SELECT * FROM att ORDER BY is_drift DESC, overdue DESC, id LIMIT 3),
pins AS (SELECT * FROM active WHERE pinned AND id NOT IN (SELECT id FROM shown) ORDER BY last_verified DESC NULLS LAST, id LIMIT 5),
main AS (SELECT a.*, {_SCORE} AS score FROM active a LEFT JOIN uses u ON u.id = a.id WHERE a.id NOT IN (SELECT id FROM shown) AND a.id NOT IN (SELECT id FROM pins) ORDER BY score DESC, a.id LIMIT 20),
three AS (SELECT 0 AS section, row_number() OVER (ORDER BY is_drift DESC, overdue DESC, id) AS pos, id, {_COST.format(f"({_FORMAT}) || ' (' || said || ')'")} AS cost, 3 AS cap FROM shown
  UNION ALL SELECT 1, row_number() OVER (ORDER BY last_verified DESC NULLS LAST, id), id, {_COST.format(f"({_FORMAT})")}, 5 FROM pins
  UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, id), id, {_COST.format(f"({_FORMAT})")}, 20 FROM main)"""
_TITLE = "'## Project memory — ' || CAST((SELECT count(*) FROM active) AS VARCHAR) || ' active claims' || CASE WHEN (SELECT count(*) FROM att) > 0 THEN ', ' || CAST((SELECT count(*) FROM att) AS VARCHAR) || ' need attention' ELSE '' END"
SQL |= {
    "expand_graph": f"WITH {_REC}, {_walk(_BUSY, _edges('active'), 3)} SELECT * FROM walk",
    "expand_include_superseded": f"WITH {_REC}, reachable AS (SELECT * FROM records WHERE state IN ('active', 'superseded')), {_walk(_BUSY, _edges('reachable'), 3)} SELECT * FROM walk",
    "search_layers": _BY_LAYER,
    "search_expand": f"""{_search()}, best AS (SELECT id, CAST(rank AS BIGINT) AS pos FROM ranked ORDER BY rank LIMIT 5), {_walk('SELECT id, pos FROM best', _edges('active'), 2)}
SELECT id, NULL::VARCHAR AS from_id, NULL::VARCHAR AS edge_type, 0 AS hops, pos FROM best UNION ALL SELECT * FROM walk WHERE id IN (SELECT id FROM active)""",
    "budget_break": f"""WITH RECURSIVE {_REC}, {_BOOT},
{_fold("SELECT row_number() OVER (ORDER BY section, pos) AS n, * FROM three", 700, 20, f"ceil((length({_TITLE}) + 2) / 4.0)", False)} {_TAKEN}""",
    "budget_skip": f"""{_search().replace("WITH", "WITH RECURSIVE", 1).replace("LIMIT 20)", "LIMIT 40)").replace("LIMIT 10)", "LIMIT 20)")},
{_fold("SELECT CAST(rank AS BIGINT) AS n, 0 AS section, CAST(rank AS BIGINT) AS pos, id, CAST(ceil(length(body) / 4.0) AS INTEGER) AS cost, 20 AS cap FROM ranked", 1000, 20, "0", True)} {_TAKEN}""",
    "usage_append": f"{_search()} SELECT id, {NOW} AS retrieved_at FROM ranked UNION ALL SELECT id, {NOW} FROM ranked",
    "describe_schema": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {str(need).lower()}, '{v}')" for n, k, need, v in describe()) + ") t(field, type, needed, allowed)",
}
