"""Queries of the record operators over the test tables; ``records_sql`` holds their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions import text as X
from recordloom.operators import exports, graph, index, migrate, reports, search, writes
from recordloom.runtime import both_records, shared_dir, stored, table
from recordloom.sources import imports, layers, markdown, repositories

NOW_TEXT = "2026-06-30 00:00:00"
#: A search that matches all its terms, one that needs prefixes, one that needs any term.
QUERY, QUERY_PREFIX, QUERY_ANY, QUERY_PHRASE = "router supersedes", "rout supersed", "hierarchy zzzunknown", "the-hidden router"

COLUMNS = (
    "id kind type state created last_verified source source_kind tags check_by stale pinned verified_with anchors supersedes superseded_by supersede_reason conflicts_with "
    "refines supports depends_on expires valid_from valid_to ext title body file_path layer loaded_at"
).split()


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def _rows(s: SparkSession, d: str) -> DataFrame:
    return both_records(s, d, *COLUMNS)


def _records(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current records; with ``columns`` only those (and what resolution needs) are shuffled."""
    if not columns:
        return layers.resolve_collisions(_rows(s, d))
    need = list(dict.fromkeys(["id", "file_path", "loaded_at", *columns]))
    return layers.resolve_collisions(both_records(s, d, *need))


def _active(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).where(F.col("state") == "active")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__.rstrip("_")] = f
    return f


# --- scans -----------------------------------------------------------------------------------------


@query
def scan_active(s, d):
    return _records(s, d, "kind", "type", "state", "stale", "check_by").where(F.col("state") == "active").select("id", "type", R.lazy_stale(now()).alias("stale_effective"))


@query
def scan_superseded(s, d):
    return _records(s, d, "state").where(F.col("state") == "superseded").select("id")


@query
def get_by_id(s, d):
    """The record an id of the log names most often: a point lookup by key."""
    key = table(s, d, "usage_log", "id").where(F.col("id").startswith("ms_")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return _records(s, d, "state", "title").join(F.broadcast(key), "id").select("id", "state", "title")


@query
def resolve_collisions(s, d):
    return _records(s, d, "state").select("id", "ref_table", "file_path", "state")


@query
def layered_scan(s, d):
    return layers.layered(both_records(s, d, "id", "layer", "loaded_at"), table(s, d, "layers")).select("id", "layer")


@query
def layer_listing(s, d):
    return layers.listing(both_records(s, d, "id", "layer"), table(s, d, "layers"))


@query
def usage_counts(s, d):
    return reports.usage_counts(table(s, d, "usage_log", "id", "retrieved_at"), now())


@query
def usage_daily_layers(s, d):
    """Retrievals per layer and month: the log as a time series."""
    return table(s, d, "usage_log", "layer", "retrieved_at").groupBy(
        "layer", F.date_format("retrieved_at", "yyyy-MM").alias("month"),
    ).agg(F.count(F.lit(1)).alias("uses"))


@query
def parse_frontmatter(s, d):
    """Every record written as Markdown and read back."""
    got = markdown.parse_frontmatter(markdown.serialize(_records(s, d)).select("path", "content"))
    return got.select(
        "id", "kind", "type", "state", "created", "source", "tags", "check_by", "title", F.size("anchors").alias("n_anchors"),
        F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), F.length("body").alias("body_chars"), "error",
    )


def _notes(s: SparkSession, d: str) -> DataFrame:
    """One file of notes per record, in the forms the importers read."""
    r = _records(s, d, "type", "state", "title", "created", "source")
    clean = F.replace(F.coalesce("title", F.lit("")), F.lit("|"), F.lit("/"))
    text = F.concat_ws(
        "\n", F.lit("# Notes"), F.lit("## Quick Facts"), F.lit("| Entity | Key | Value |"), F.lit("|---|---|---|"), F.concat(
            F.lit("| "), clean, F.lit(" | state | "), "state", F.lit(" |"),
        ),
        F.concat(F.lit("| "), "id", F.lit(" | api key 7 |")), F.lit("|  |  |  |"), F.lit("## Decisions"), F.lit("| Date | Decision | Rationale |"), F.lit("|---|---|---|"),
        F.concat(
            F.lit("| "), F.date_format("created", "yyyy-MM-dd"), F.lit(" | "), clean, F.lit(" |  |"),
        ), F.concat(F.lit("| soon | "), "id", F.lit(" | "), F.coalesce("source", F.lit("")), F.lit(" |")), F.lit("## Lessons"), F.lit("| What | Why |"), F.lit("|---|---|"),
        F.concat(F.lit("| "), clean, F.lit(" | "), "id", F.lit(" |")), F.lit("## Log"),
        F.concat(
            F.lit("- * 12:30 "), clean, F.lit(" <!-- dc:type="), F.when(F.col("type") == "decision", "decision").otherwise("habit"),
            F.lit(" dc:importance=0.5 dc:date="), F.date_format("created", "yyyy-MM-dd"), F.lit(" -->"),
        ), F.lit("- no comment here"),
    )
    return r.select(F.col("id").alias("path"), text.alias("content"))


@query
def import_tables(s, d):
    return imports.tables(_notes(s, d), "Lessons")


@query
def import_facts(s, d):
    return imports.facts(_notes(s, d)).select("path", "title", "body", "tags")


@query
def import_decisions(s, d):
    return imports.decisions(_notes(s, d), NOW_TEXT[:10]).select("path", "title", "body", "created")


@query
def import_lessons(s, d):
    return imports.lessons(_notes(s, d)).select("path", "title", "body")


@query
def import_observations(s, d):
    return imports.observations(_notes(s, d)).select("path", "type", "title", "created", "importance", "raw_type")


@query
def import_dir(s, d):
    files = _records(s, d, "body").select("file_path", "body")
    return imports.loose_files(files.select(F.col("file_path").alias("path"), F.col("body").alias("content"))).select("path", "type", "title")


@query
def import_procedures(s, d):
    files = _records(s, d, "body").select(F.col("file_path").alias("path"), F.col("body").alias("content"))
    return imports.procedures(files).select("path", "title")


@query
def detect_sources(s, d):
    """Forms of the records' files, of a file of notes and of a list of observations beside each, and of other files."""
    files = _records(s, d, "body").select(F.col("file_path").alias("path"), F.col("body").alias("content"))
    notes = _notes(s, d)
    named = [notes.select(F.concat("path", F.lit(f"/{name}")).alias("path"), "content") for name in ("MEMORY.md", "observations.md", "picture.png")]
    every = files
    for more in (*named[:2], named[2].withColumn("content", F.lit("no text"))):
        every = every.unionByName(more)
    return imports.detect_sources(every).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


@query
def recent_activity(s, d):
    """The forty records loaded last, none more than sixty days ago."""
    r = _records(s, d, "title")
    return r.where(F.col("loaded_at") >= R.add_days(now(), F.lit(-60))).orderBy(F.desc("loaded_at"), "id").limit(40).select("id", "title", "loaded_at")


@query
def git_rename_scan(s, d):
    """The renames in what a repository says of its changed files."""
    return _renames(s, d)


# --- columns ---------------------------------------------------------------------------------------


@query
def lazy_stale(s, d):
    return _records(s, d, "kind", "stale", "check_by").select(
        "id", F.coalesce("stale", F.lit(False)).alias("stale_persisted"), R.lazy_stale(now()).alias("stale_effective"),
    )


@query
def valid_as_of(s, d):
    return _records(s, d, "valid_from", "valid_to").where(R.valid_as_of(F.lit("2025-06-30 00:00:00").cast("timestamp_ntz"))).select("id")


def _drift(s: SparkSession, d: str) -> DataFrame:
    return reports.anchor_drift(reports.anchors_view(_records(s, d, "anchors", "state").where(F.col("state") == "active")), _files(s, d))


def _files(s: SparkSession, d: str) -> DataFrame:
    """(repo, file, current_sha): what each anchored file was when last seen.

    The tables hold no file listing; files whose path has a length divisible by 11 stand for those gone.
    """
    seen = _rows(s, d).select("loaded_at", "id", F.explode("anchors").alias("a")).select(
        "loaded_at", "id", F.col("a.file").alias("file"), F.col("a.sha").alias("sha"), F.coalesce("a.repo", F.lit("")).alias("repo"),
    )
    last = seen.where(F.col("file").isNotNull()).groupBy("repo", "file").agg(F.max(F.struct("loaded_at", "id", "sha")).alias("m"))
    return last.where(F.length("file") % 11 != 0).select("repo", "file", F.col("m.sha").alias("current_sha"))


def _renames(s: SparkSession, d: str) -> DataFrame:
    """(old, new), read from name-status lines.

    The tables hold no repository, so the lines are made from the anchored files: those of ``_files``
    that are gone are said to be renamed if they end in ``.ts``, all others to be changed.
    """
    anchored = _rows(s, d).select(F.explode("anchors").alias("a")).select(F.col("a.file").alias("f")).where(F.col("f").isNotNull()).distinct()
    gone = (F.length("f") % 11 == 0) & F.col("f").endswith(".ts")
    return repositories.parse_renames(anchored.select(F.when(
        gone, F.concat(F.lit("R100\t"), "f", F.lit("\t"), "f", F.lit("x")),
    ).otherwise(F.concat(F.lit("M\t"), "f")).alias("value")))


@query
def decay_candidates(s, d):
    r = _records(s, d)
    return reports.decay_candidates(r, reports.drift_agg(_drift(s, d)), now())


@query
def validate_rows(s, d):
    return reports.validate(_records(s, d)).select("id", F.array_join("errors", "; ").alias("errors"))


@query
def schema_violations(s, d):
    """Headers of the inbox, as written, that could not be loaded."""
    raw = table(s, d, "inbox_headers", "header_id", "id", "source", "created", "check_by")
    null = lambda kind="string": F.lit(None).cast(kind)
    head = raw.select(
        F.col("header_id").cast("string").alias("key"), "id", null().alias("kind"), F.lit("fact").alias("type"), F.lit("active").alias("state"), F.when(
            F.col("created").rlike(r"^\d{4}-\d\d-\d\dT"), F.col("created"),
        ).alias("created"), "source",
        null().alias("source_kind"), null().alias("verified_with"), "check_by", null("timestamp_ntz").alias("valid_from"), null("timestamp_ntz").alias("valid_to"),
    )
    bad = reports.validate(head.drop("id").withColumnRenamed("key", "id").withColumn("id", F.concat(F.lit("ms_"), F.lpad("id", 26, "0"))))
    return bad.where(F.size("errors") > 0).distinct().select("id", F.array_join("errors", "; ").alias("errors"))


@query
def infer_source_kind(s, d):
    return both_records(s, d, "source").select("source").distinct().select("source", R.infer_source_kind(F.col("source")).alias("inferred"))


@query
def effective_source_kind(s, d):
    k = R.effective_source_kind()
    return _records(s, d, "source", "source_kind").select("id", k.alias("kind_of_source"), R.storage_tier(k).alias("tier"))


@query
def storage_tier(s, d):
    return _records(s, d, "source", "source_kind").groupBy(R.storage_tier(R.effective_source_kind()).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query
def canonical_source(s, d):
    """Sources as the headers of the inbox spell them, with and without a date."""
    base = table(s, d, "inbox_headers", "source", "read_at").where(F.col("source").isNotNull())
    dated = base.select(F.explode(F.array(
        "source", F.concat("source", F.lit("-"), F.date_format("read_at", "yyyy-MM-dd")),
        F.concat("source", F.lit(" session "), F.date_format("read_at", "yyyy-MM-dd"), F.lit(" b")),
    )).alias("source"))
    return dated.distinct().select("source", R.canonical_source(F.col("source")).alias("bucket"))


@query
def witness_of(s, d):
    return _records(s, d, "verified_with", "anchors").select("id", R.witness_of().alias("witness"))


@query
def infer_verified_with(s, d):
    return _records(s, d, "anchors", "last_verified", "ext", "source", "source_kind").select(
        "id", R.infer_verified_with(R.effective_source_kind()).alias("witness"),
    )


@query
def preview(s, d):
    return _records(s, d, "body").select("id", X.preview(F.col("body")).alias("preview"))


@query
def truncate_body(s, d):
    return _records(s, d, "body").select("id", X.truncate_body(F.col("body")).alias("line"))


@query
def witness_marker(s, d):
    return _records(s, d, "stale", "anchors", "last_verified", "created").select("id", R.witness_marker(now()).alias("marker"))


@query
def format_line(s, d):
    return _records(s, d).select("id", R.format_line(now()).alias("line"))


@query
def default_check_by(s, d):
    return _records(s, d, "type", "created").select("id", R.default_check_by(F.col("created")).alias("due"))


@query
def parse_ttl(s, d):
    """Terms as written in the check_by fields of the inbox, next to plain ones."""
    said = F.explode(F.array(F.lit("7d"), F.lit("12h"), F.lit("90m"), F.lit("never"), F.lit("x"), F.col("check_by"))).alias("ttl")
    return table(s, d, "inbox_headers", "check_by").select(said).where(F.col("ttl").isNotNull()).distinct().select("ttl", R.parse_ttl(F.col("ttl")).alias("micros"))


@query
def parse_tags(s, d):
    return _records(s, d, "tags").select("id", X.parse_tags(F.array_join("tags", " , ")).alias("tags"))


@query
def redact(s, d):
    return _records(s, d, "title").select("id", X.redact(F.col("title"), F.col("title")).alias("shown"))


@query
def sanitize_tag(s, d):
    return _records(s, d, "tags").select(F.explode("tags").alias("tag")).distinct().select("tag", X.sanitize_tag(F.col("tag")).alias("clean"))


@query
def estimate_tokens(s, d):
    return _records(s, d, "body").select("id", X.estimate_tokens(F.col("body")).alias("tokens"))


@query
def title_functions(s, d):
    t = F.col("title")
    return _records(s, d, "title").select(
        "id", X.normalise_title(t).alias("normal"), F.array_join(F.array_sort(X.title_tokens(t)), " ").alias("words"),
        X.title_key(t).alias("key"),
    )


@query
def escape_functions(s, d):
    t = F.concat("title", F.lit(' <&> "q" \\ \n'))
    return _records(s, d, "title").select("id", X.escape_xml(t).alias("xml"), X.escape_dot(t).alias("dot"))


@query
def blob_sha(s, d):
    return table(s, d, "documents", "doc_id", "text").where(F.col("text").isNotNull()).select("doc_id", R.blob_sha(F.col("text")).alias("sha"))


@query
def route_path(s, d):
    return _records(s, d, "kind", "type", "source", "source_kind").select("id", R.route_path().alias("path"))


# --- joins and conflicts ---------------------------------------------------------------------------


@query
def anchor_drift_join(s, d):
    return _drift(s, d)


@query
def anchor_drift_repos(s, d):
    """Drift where only the repositories of live records are at hand: others are out of reach."""
    live = table(s, d, "memory_records", "anchors", "layer").where(F.col("layer") == "project").select(F.explode("anchors").alias("a")).select(F.col("a.repo").alias("repo")).where(F.col("repo").isNotNull())
    return reports.anchor_drift(reports.anchors_view(_records(s, d, "anchors", "state").where(F.col("state") == "active")), _files(s, d), live)


@query
def rename_join(s, d):
    gone = _drift(s, d).where(F.col("status") == "missing")
    return gone.join(_renames(s, d).withColumnRenamed("old", "file"), "file", "left").select("id", "file", F.col("new").alias("renamed_to"))


@query
def drift_agg(s, d):
    return reports.drift_agg(_drift(s, d))


@query
def edge_resolve(s, d):
    r = _records(s, d)
    got = graph.edges_view(r).join(r.select(F.col("id").alias("dst"), "title"), "dst", "left")
    return got.groupBy("edge_type").agg(F.count(F.lit(1)).alias("links"), F.count("title").alias("resolved"))


@query
def conflict_selfjoin(s, d):
    """Pairs of classes of equal title words and tags; ``conflict_members`` tells who is in them."""
    return reports.conflict_pairs(reports.conflict_classes(_active(s, d))[1])


@query
def conflict_members(s, d):
    return reports.conflict_classes(_active(s, d))[0]


@query
def title_bucket_pairs(s, d):
    """Records with the bucket of titles that begin alike."""
    return reports.title_buckets(_active(s, d))


@query
def declared_conflicts(s, d):
    return reports.declared_conflicts(_active(s, d))


def _drafts(s: SparkSession, d: str) -> DataFrame:
    """Archived records offered to the live store as new claims."""
    rows = table(s, d, "archive_records", "id", "type", "title", "tags", "source", "source_kind", "loaded_at").where(F.col("type").isNotNull())
    return rows.groupBy("id").agg(F.min_by(
        F.struct("type", "title", "tags", "source", "source_kind"), "loaded_at",
    ).alias("r")).select(F.concat(F.lit("new_"), "id").alias("id"), "r.*")


def _live(s: SparkSession, d: str) -> DataFrame:
    return _active(s, d).where(F.col("ref_table") == "memory_records")


@query
def refuse_anti(s, d):
    return writes.remember(_drafts(s, d), _live(s, d))[0]


@query
def remember(s, d):
    return writes.remember(_drafts(s, d), _live(s, d))[1].select("id", "type", "title", "conflicts_with_id")


@query
def neighbour_rank(s, d):
    return reports.nearest(_drafts(s, d), _live(s, d)).withColumnRenamed("id", "id_a")


@query
def tag_overlap(s, d):
    """Shared tags and title words of each record and the one it refines."""
    r = _records(s, d, "title", "tags", "refines")
    e = graph.edges_view(r, ("refines",)).select("src", "dst").distinct()
    a, b = r.select(
        F.col("id").alias("src"), F.col("tags").alias("ta"), F.col("title").alias("na"),
    ), r.select(F.col("id").alias("dst"), F.col("tags").alias("tb"), F.col("title").alias("nb"))
    return e.join(a, "src").join(b, "dst").select(
        "src", "dst", X.overlap(F.col("ta"), F.col("tb")).alias("tags"),
        F.size(F.array_intersect(X.title_tokens(F.col("na")), X.title_tokens(F.col("nb")))).alias("words"),
    )


@query
def usage_join(s, d):
    u = reports.usage_counts(table(s, d, "usage_log", "id", "retrieved_at"), now())
    return _records(s, d, "type").join(u, "id", "left").select(
        "id", F.coalesce("uses", F.lit(0)).alias("uses"), F.round(R.usage_boost(F.coalesce("uses", F.lit(0))), 6).alias("boost"),
    )


# --- counts ----------------------------------------------------------------------------------------


@query
def count_by_state(s, d):
    return _records(s, d, "state").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def count_by_type(s, d):
    return _records(s, d, "state", "type").where((F.col("state") == "active") & F.col("type").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def count_by_witness(s, d):
    r = _records(s, d, "state", "type", "verified_with").where((F.col("state") == "active") & F.col("type").isNotNull())
    return r.groupBy(F.coalesce("verified_with", F.lit("assertion")).alias("witness")).agg(F.count(F.lit(1)).alias("n"))


@query
def count_stale_drifted(s, d):
    r = _records(s, d, "state", "type", "stale").where((F.col("state") == "active") & F.col("type").isNotNull())
    got = r.join(reports.drift_agg(_drift(s, d)).select("id", F.lit(True).alias("drift")), "id", "left")
    return got.agg(F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"), F.count_if(F.coalesce("drift", F.lit(False))).alias("drifted"))


@query
def status_report(s, d):
    """All counts in one pass over the records."""
    r = _records(s, d, "state", "type", "verified_with")
    active = F.when((F.col("state") == "active") & F.col("type").isNotNull(), True)
    r = r.select("state", F.when(active, F.col("type")).alias("kind_of"), F.when(active, F.coalesce("verified_with", F.lit("assertion"))).alias("witness"))
    sets = [("state", [F.col("state")]), ("type", [F.col("kind_of")]), ("witness", [F.col("witness")])]
    each = F.explode(F.array(
        *[F.struct(F.lit(n).alias("section"), c[0].alias("value")) for n, c in sets],
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("value")),
    )).alias("x")
    return r.select(each).select("x.*").where(F.col("value").isNotNull()).groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def source_kind_table(s, d):
    return migrate.source_kinds(_records(s, d, "source"))


@query
def sweep(s, d):
    return writes.sweep(_records(s, d, "state", "kind", "stale", "check_by"), now()).select("id")


@query
def sweep_candidates(s, d):
    r = _records(s, d, "state", "stale", "anchors", "verified_with", "title")
    return r.where((F.col("state") == "active") & F.coalesce("stale", F.lit(False)) & ~R.has_anchors() & (F.coalesce("verified_with", F.lit("assertion")) == "assertion")).select("id", "title")


@query
def corpus_stats(s, d):
    t = search.tokenized(_active(s, d))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("_length").alias("tokens"), F.round(F.avg("_length"), 6).alias("mean"))


# --- ranking and budgets ---------------------------------------------------------------------------


def _uses(s: SparkSession, d: str) -> DataFrame:
    return reports.usage_counts(table(s, d, "usage_log", "id", "retrieved_at"), now())


@query
def freshness(s, d):
    return _records(s, d, "type", "last_verified", "created").select("id", F.round(R.freshness(now()), 6).alias("freshness"))


@query
def boot_rank(s, d):
    return reports.boot_rank(_active(s, d), _uses(s, d), now()).orderBy(F.desc("score"), "id").limit(20).select("id", "score")


@query
def boot_scores(s, d):
    return reports.boot_rank(_active(s, d), _uses(s, d), now()).select("id", "score")


@query
def pinned_topk(s, d):
    return reports.pinned(_active(s, d)).select("id", "last_verified")


@query
def attention_list(s, d):
    return reports.attention(_active(s, d), reports.drift_agg(_drift(s, d)), now())


@query
def attention_topk(s, d):
    return attention_list(s, d).orderBy(F.desc("is_drift"), F.desc("overdue"), "id").limit(3)


@query
def recent_topk(s, d):
    return _records(s, d, "state", "created").where(F.col("state") == "active").orderBy(F.desc("created"), "id").limit(5).select("id", "created")


@query
def budget_break(s, d):
    """The boot list under its budget."""
    return reports.context(stored(_active(s, d)), _uses(s, d), reports.drift_agg(_drift(s, d)), now(), 700)


@query
def budget_skip(s, d):
    """Full bodies of the best search results: what does not fit is passed over."""
    from pyspark.sql import Window

    top = search.search(_active(s, d), QUERY, now(), 20)
    rows = top.select("id", F.row_number().over(Window.orderBy("rank")).alias("pos"), X.estimate_tokens(F.col("body")).alias("cost"))
    return reports.budget([(rows, 20)], 1000, 20, 0, skip=True)


@query
def limit_per_layer(s, d):
    """The three newest active records of every layer."""
    from pyspark.sql import Window

    r = _records(s, d, "state", "layer", "created").where(F.col("state") == "active")
    return r.withColumn("n", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("created"), "id"))).where("n <= 3").select("layer", "id", "n")


# --- search ----------------------------------------------------------------------------------------
def _found(stage: str, text: str):
    return lambda s, d: search.matches(_active(s, d), text, stage=stage).select("id", "bm25")


for _name, _stage, _text in (
    ("fts_and", "and", QUERY), ("fts_or", "or", QUERY), ("fts_prefix", "and_prefix", QUERY_PREFIX),
    ("fts_phrase_term", "and", QUERY_PHRASE),
):
    QUERIES[_name] = _found(_stage, _text)


@query
def fts_tokenize(s, d):
    return _records(s, d, "title", "tags").select("id", X.tokens(F.col("title")).alias("title_tokens"), X.tokens(F.array_join("tags", " ")).alias("tag_tokens"))


@query
def fts_bm25(s, d):
    return search.matches(_active(s, d), QUERY).orderBy(F.desc("bm25"), "id").limit(10).select("id", "bm25")


@query
def fts_fallback(s, d):
    return search.matches(_active(s, d), QUERY_ANY).select("id", "bm25")


@query
def fts_index_cache(s, d):
    """Document frequency of every stem, from the stored inverted index."""
    return stored(search.postings(_active(s, d), stem=True)).groupBy("term").agg(F.count_distinct("id").alias("df"), F.sum("tf").alias("tf"))


@query
def fts_indexed(s, d):
    """The search of ``fts_and`` answered from a stored positional index."""
    return index.matches(index.build(_active(s, d), f"{shared_dir(s)}/index-{uuid.uuid4().hex}"), QUERY, stage="and").select("id", "bm25")


@query
def fts_porter(s, d):
    return search.stemmed_vocabulary(search.postings(_active(s, d)).select("term"))


@query
def phrase_bonus(s, d):
    return _active(s, d).select("id", search.phrase_bonus("the hidden router").alias("bonus")).where(F.col("bonus") > 0)


@query
def recency(s, d):
    return _records(s, d, "created").select("id", F.round(search.recency(now()), 6).alias("recency"))


@query
def search_rerank(s, d):
    return search.search(_active(s, d), QUERY, now(), 10).select("rank", "id", "bm25", "score")


@query
def search_types(s, d):
    return search.search(_active(s, d), QUERY, now(), 10, types=["decision"]).select("rank", "id", "score")


@query
def search_as_of(s, d):
    """Results are cut first and then reduced to those valid at the time."""
    return search.search(_active(s, d), QUERY, now(), 10).where(R.valid_as_of(F.lit("2025-06-30 00:00:00").cast("timestamp_ntz"))).select("rank", "id")


@query
def search_layers(s, d):
    """All layers by priority; those the table does not know come last."""
    from pyspark.sql import Window

    active = stored(_active(s, d).withColumn("from_layer", F.coalesce("layer", F.lit(""))))
    known = table(s, d, "layers", "name", "priority").withColumnRenamed("name", "from_layer")
    # One row per layer: numbering them in one task is bounded.
    places = active.select("from_layer").distinct().join(known, "from_layer", "left").withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc_nulls_last("priority"), "from_layer")),
    )
    return search.search_places(active.join(F.broadcast(places.drop("priority")), "from_layer"), QUERY, now(), 10).select("from_layer", "rank", "id")


def _asked(v: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100, as a query."""
    return v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query
def cosine_similarity(s, d):
    """Each query vector against all vectors."""
    v = table(s, d, "embeddings", "vec_id", "embedding")
    return search.similarities(v.withColumnRenamed("vec_id", "id"), _asked(v))


@query
def cosine_rerank(s, d):
    """The ten nearest vectors of each query vector."""
    v = table(s, d, "embeddings", "vec_id", "embedding")
    return search.nearest_vectors(v.withColumnRenamed("vec_id", "id"), _asked(v), 10)


# --- graph -----------------------------------------------------------------------------------------


@query
def edges_view(s, d):
    return graph.edges_view(_records(s, d))


def _seeds(s: SparkSession, d: str) -> DataFrame:
    """The ten active records with most links, in that order."""
    from pyspark.sql import Window

    busy = graph.edges_view(_active(s, d)).groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(10)
    return stored(busy.select(F.col("src").alias("id"), F.row_number().over(Window.orderBy(F.desc("n"), "src")).alias("pos")))


@query
def expand_graph(s, d):
    return graph.expand_graph(_seeds(s, d), stored(graph.edges_view(_active(s, d))), 3)


@query
def expand_include_superseded(s, d):
    r = _records(s, d).where(F.col("state").isin("active", "superseded"))
    return graph.expand_graph(_seeds(s, d), stored(graph.edges_view(r)), 3)


@query
def search_expand(s, d):
    """Search results, then the known records they lead to."""
    active = stored(_active(s, d))
    top = search.search(active, QUERY, now(), 5)
    found = stored(top.select("id", F.col("rank").alias("pos")))
    more = graph.expand_graph(found, stored(graph.edges_view(active)), 2).join(active.select("id"), "id", "left_semi")
    hit = found.select(
        "id", F.lit(None).cast("string").alias("from_id"), F.lit(None).cast("string").alias("edge_type"), F.lit(0).alias("hops"),
        F.col("pos").cast("long").alias("pos"),
    )
    return hit.unionByName(more)


@query
def relation_chain(s, d):
    return graph.relation_chain(_records(s, d, "refines"), "refines")


@query
def relation_chain_depends_on(s, d):
    return graph.relation_chain(_records(s, d, "depends_on"), "depends_on")


@query
def relation_chain_supports(s, d):
    return graph.relation_chain(_records(s, d, "supports"), "supports")


@query
def lineage_ancestors(s, d):
    return graph.reachable(_records(s, d, "supersedes"), "supersedes").toDF("id", "ancestor")


@query
def lineage_descendants(s, d):
    return graph.reachable(_records(s, d, "superseded_by"), "superseded_by").toDF("id", "descendant")


@query
def get_with_lineage(s, d):
    """Every record with what it replaced, what replaced it and the three chains it stands in, each sorted."""
    return graph.with_lineage(_records(s, d, "title", "supersedes", "superseded_by", "refines", "supports", "depends_on")).select(
        "id", "title", "ancestors", "descendants", "refines", "supports", "depends_on",
    )


# --- writes ----------------------------------------------------------------------------------------


@query
def serialize_record(s, d):
    return markdown.serialize(_records(s, d)).select(
        "id", F.length("content") > F.lit(0), F.substring_index("content", "\n", 2).alias("head"),
    ).toDF("id", "written", "head")


@query
def observe(s, d):
    docs = table(s, d, "documents", "doc_id", "text", "source")
    ttl = F.when(F.col("doc_id") % 3 == 0, "12h").when(F.col("doc_id") % 3 == 1, "never")
    return writes.observe(docs.select("doc_id", "text", "source", ttl.alias("ttl")), now()).select("doc_id", "title", "expires", "source")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """A request against every record that replaced another: to go itself."""
    r = _records(s, d, "superseded_by", "supersedes", "source", "source_kind").where(F.size("supersedes") > 0)
    return r.select(
        "id", F.lit("outdated").alias("reason"), (F.length("source") % 2 == 0).alias("override"),
        F.concat(F.lit("next_"), "id").alias("new_id"), F.lit("New text.").alias("body"), F.lit("agent-x").alias("source"),
    )


@query
def operator_guard(s, d):
    return writes.guard(_requests(s, d), _records(s, d))


@query
def supersede_replace(s, d):
    return writes.supersede_replace(_records(s, d), stored(_requests(s, d)), now()).select(
        "id", "state", "superseded_by", "supersede_reason", "title", "check_by",
    )


@query
def supersede_merge(s, d):
    """Every refining record folds into the one it refines."""
    r = _records(s, d)
    ask = graph.edges_view(r, ("refines",)).groupBy("src").agg(F.min("dst").alias("into")).select(
        F.col("src").alias("id"), "into", F.lit("merged").alias("reason"), F.lit(False).alias("override"),
    )
    return writes.supersede_merge(r, stored(ask)).select("id", "state", "superseded_by", F.coalesce(F.size("supersedes"), F.lit(0)).alias("n_supersedes"))


@query
def supersede_retract(s, d):
    return writes.supersede_retract(_records(s, d), stored(_requests(s, d))).select("id", "state", "superseded_by", "supersede_reason")


@query
def relate(s, d):
    """Every dependency also recorded as support."""
    r = _records(s, d)
    ask = graph.edges_view(r, ("depends_on",)).select(F.col("src").alias("id"), F.col("dst").alias("target")).distinct()
    return writes.relate(r, stored(ask), "supports")[0].select("id", F.size("supports").alias("n_supports"))


@query
def relate_refused(s, d):
    r = _records(s, d)
    ask = graph.edges_view(r, ("depends_on",)).select(F.col("src").alias("id"), F.col("dst").alias("target")).distinct()
    return writes.relate(r, stored(ask), "supports")[1]


@query
def verify(s, d):
    r = _active(s, d)
    ask = r.select("id", F.when(F.length("title") % 2 == 0, "seen").alias("evidence"), F.col("source").alias("source"))
    return writes.verify(r, _drift(s, d), ask, now())


@query
def anchor_merge(s, d):
    """Changed anchors take the present content."""
    r = _active(s, d)
    fresh = _drift(s, d).where(F.col("status") == "changed").join(_files(s, d), ["repo", "file"]).select("id", "file", F.col("current_sha").alias("sha"), "repo")
    got = writes.anchor_merge(r, fresh)
    return got.select(
        "id", F.size("anchors").alias("n"),
        F.array_join(F.transform("anchors", lambda a: F.concat(a["file"], F.lit("@"), a["sha"])), " ").alias("anchors"),
    )


@query
def usage_append(s, d):
    """The log after a search was noted in it twice, read back."""
    path = f"{shared_dir(s)}/usage-{uuid.uuid4().hex}"
    found = stored(search_rerank(s, d).select("id"))
    for _ in range(2):
        imports.append_usage(found, path, now())
    return imports.usage_log(s, path)


@query
def archive_move(s, d):
    r = _records(s, d)
    return writes.archive(r, writes.sweep(r, now())).select("id", "state", "file_path")


# --- export and migration --------------------------------------------------------------------------


@query
def export_nodes(s, d):
    return exports.nodes(exports.projected(_records(s, d), True))


@query
def export_edges(s, d):
    return exports.edges(exports.projected(_records(s, d), True), True)


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chosen = stored(exports.projected(_records(s, d)))
    return exports.nodes(chosen), exports.edges(chosen)


@query
def export_jsonl(s, d):
    return exports.jsonl(*_graph(s, d))


@query
def export_graphml(s, d):
    return exports.graphml(*_graph(s, d)).select("kind", "key", "line")


@query
def export_dot(s, d):
    return exports.dot(*_graph(s, d))


def _older(s: SparkSession, d: str) -> DataFrame:
    """The records with parts of their header in an older shape."""
    r = _records(s, d)
    old = F.length("title") % 2 == 0
    return r.withColumns({
        "decay_after": F.when(old, F.col("check_by")), "check_by": F.when(~old, F.col("check_by")),
        "state": F.when(old & (F.col("state") == "active"), "captured").when(old & (F.col("state") == "retired"), "decayed").otherwise(F.col("state")),
        "corrects": F.when(old & (F.size("supersedes") > 0), F.col("supersedes")), "supersedes": F.when(~old, F.col("supersedes")),
        "confidence": F.when(old, F.lit(0.5)), "code_anchors": F.when(old & R.has_anchors(), F.col("anchors")), "anchors": F.when(~old, F.col("anchors")),
        "kind": F.when(~old | (F.col("kind") == "observation"), F.col("kind")), "file_path": F.replace("file_path", F.lit("operator/"), F.lit("")),
    })


def _older_files(s: SparkSession, d: str) -> DataFrame:
    """The files of ``_older``: its records as Markdown under the older names."""
    r = _older(s, d)
    old = lambda name, value: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), value))
    bag = F.regexp_replace(F.coalesce(F.col("ext"), F.lit("{}")), r"^\{", "")
    ext = F.when(
        F.col("code_anchors").isNotNull(),
        F.concat(F.lit('{"code_anchors": '), F.to_json("code_anchors"), F.when(F.trim(bag) == "}", "").otherwise(", "), bag),
    ).otherwise(F.col("ext"))
    lines = F.array_compact(F.array(
        old("decay_after", F.to_json(F.array("decay_after"))), old("corrects", F.to_json("corrects")),
        old("confidence", F.col("confidence").cast("string")),
    ))
    texts = markdown.serialize(r.withColumns({"ext": ext, "more": F.array_join(lines, "\n")}), F.col("more"))
    # A list of one text is read as that text.
    more = F.regexp_replace("more", r"(?m)^decay_after: \[(.*)\]$", "decay_after: $1")
    return texts.select(
        "path",
        F.when(more == "", F.col("content")).otherwise(F.concat(F.lit("---\n"), more, F.lit("\n"), F.substring("content", 5, 100_000_000))).alias("content"),
    )


def _migrated(s: SparkSession, d: str) -> DataFrame:
    """The plan for ``_older``, read from its files."""
    rows = markdown.parse_frontmatter(_older_files(s, d), legacy=True).drop("error")
    times = {c: R.stamp(F.col(c)) for c in ("created", "last_verified", "expires", "valid_from", "valid_to")}
    return migrate.plan(rows.withColumns(times).withColumnRenamed("path", "file_path"), now())


@query
def normalize_legacy(s, d):
    """Older headers read in today's shape give today's headers again."""
    got = markdown.parse_frontmatter(_older_files(s, d))
    return got.select(
        "id", "kind", "state", "check_by", F.coalesce(F.size("anchors"), F.lit(0)).alias("n_anchors"),
        F.coalesce(F.size("supersedes"), F.lit(0)).alias("n_supersedes"),
    )


@query
def migrate_plan(s, d):
    return _migrated(s, d).select("id", F.array_join("changes", "; ").alias("changes"), "target_path")


@query
def migrate_apply(s, d):
    """A store of older headers, rewritten and moved: what became of each file, and that a second run has none to do."""
    root = f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/older-{uuid.uuid4().hex}"
    markdown.relocate(_older_files(s, d).withColumn("was", F.lit(None).cast("string")), root).agg(F.count(F.lit(1))).first()
    first = migrate.apply(s, root, now())
    again = migrate.apply(s, root, now())
    return first.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(again.groupBy(F.concat(F.lit("again "), "outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


@query
def describe_schema(s, d):
    return s.createDataFrame(markdown.describe(), "field string, type string, needed boolean, allowed string")


@query
def migration_summary(s, d):
    return migrate.summary(_migrated(s, d))


@query
def operator_relocations(s, d):
    return migrate.operator_relocations(_migrated(s, d))


@query
def union_layers(s, d):
    """Distinct records per layer and over all layers."""
    r = both_records(s, d, "id", "layer").drop("ref_table")
    return r.select("id").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("layer"), "n").unionByName(r.distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("n")))


@query
def same_ids_across_formats(s, d):
    """Every node and edge with the number of text forms it stands in: all three."""
    a, b = _graph(s, d)
    forms = [f(a, b).select("kind", "key").distinct() for f in (exports.jsonl, exports.graphml, exports.dot)]
    return forms[0].unionByName(forms[1]).unionByName(forms[2]).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("forms"))


# --- the same steps on their own -------------------------------------------------------------------


@query
def fts_meta_join(s, d):
    return search.matches(_active(s, d), QUERY, ["fact", "decision"], stage="and").select("id", "type", "bm25")


@query
def hit_hydrate(s, d):
    hits = stored(search_rerank(s, d).select("id", "rank"))
    return _records(s, d, "title").join(F.broadcast(hits), "id").select("id", "title", "rank")


@query
def edge_semi_filter(s, d):
    return _graph(s, d)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query
def layer_overlay(s, d):
    return layered_scan(s, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


QUERIES["token_overlap"] = tag_overlap
QUERIES["usage_boost"] = usage_join


@query
def max_normalise(s, d):
    found = stored(search.matches(_active(s, d), QUERY, stage="and").select("id", "bm25"))
    top = found.agg(F.max("bm25")).first()[0] or 1.0
    return found.select("id", F.round(F.col("bm25") / F.lit(top), 6).alias("relevance"))


@query
def minus_attention(s, d):
    return _records(s, d, "state").where(F.col("state") == "active").join(F.broadcast(attention_topk(s, d).select("id")), "id", "left_anti").select("id")


@query
def minus_pinned(s, d):
    return _records(s, d, "state").where(F.col("state") == "active").join(F.broadcast(pinned_topk(s, d).select("id")), "id", "left_anti").select("id")


@query
def dedupe_edges(s, d):
    return graph.edges_view(_records(s, d)).select("src", "edge_type", "dst").distinct()


@query
def scan_records(s, d):
    """All records, live and archived, written as files and scanned again."""
    root = f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/store-{uuid.uuid4().hex}"
    markdown.write_store(_records(s, d), root)
    return markdown.scan_records(s, root).select("id", "state", "title", "area", "is_operator", "error")
