"""Column functions over the header of a record: provenance, staleness, witness, paths."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import truncate_body

DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Settings:
    """What a store's configuration sets."""

    decay_days: dict[str, int] = field(default_factory=lambda: {"fact": 90, "decision": 180, "procedure": 90})
    #: Sources that are people, besides every ``human:...``.
    operator_pattern: str = r"(?i)^(user)$"
    import_pattern: str = r"(?i)^(migration-|.*-import$)"
    relevance: float = 0.4
    recency: float = 0.3
    half_life_days: dict[str, int] = field(default_factory=lambda: {"decision": 180, "procedure": 90, "fact": 45})
    type_weight: dict[str, float] = field(default_factory=lambda: {"decision": 1.0, "procedure": 0.9, "fact": 0.8})


def lookup(key: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def stamp(text: Column) -> Column:
    """An ISO stamp in UTC as a timestamp without zone; NULL for anything else, ``never`` among it."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Micros since 1970 of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(DAY_MICROS)


def lazy_stale(now: Column) -> Column:
    """Flagged on disk, or a claim whose check-by date has passed."""
    due = stamp(F.col("check_by"))
    return F.coalesce("stale", F.lit(False)) | ((F.coalesce("kind", F.lit("claim")) != "observation") & F.coalesce(now > due, F.lit(False)))


def valid_as_of(at: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at <= F.col("valid_to")))


def infer_source_kind(source: Column, settings: Settings = Settings()) -> Column:
    s = F.coalesce(source, F.lit(""))
    return F.when(
        s.rlike(settings.operator_pattern) | F.lower(s).startswith("human:"), "operator",
    ).when(s.rlike(settings.import_pattern), "import").otherwise("agent")


def effective_source_kind(settings: Settings = Settings()) -> Column:
    return F.coalesce("source_kind", infer_source_kind(F.col("source"), settings))


def storage_tier(kind: Column) -> Column:
    return F.when(kind == "operator", "operator").otherwise("standard")


def canonical_source(source: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(source, r"-?\d{4}-\d{2}-\d{2}.*$", ""), r"(?i)\s+session\s+\d{4}-\d{2}-\d{2}.*$", "")
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), source)


def has_anchors() -> Column:
    return F.coalesce(F.size("anchors"), F.lit(0)) > 0


def witness_of() -> Column:
    return F.coalesce("verified_with", F.when(has_anchors(), "anchor"), F.lit("assertion"))


def evidence(ext: Column) -> Column:
    return F.get_json_object(ext, "$.last_verification.evidence").isNotNull()


def infer_verified_with(kind: Column) -> Column:
    return (
        F.when(
            has_anchors() & F.col("last_verified").isNotNull(), "anchor",
        ).when(evidence(F.col("ext")), "evidence").when(kind == "operator", "operator").otherwise("assertion")
    )


def witness_marker(now: Column) -> Column:
    since = F.greatest(F.floor(days_between(now, F.coalesce("last_verified", "created"))), F.lit(0))
    return F.when(F.coalesce("stale", F.lit(False)), "⚠").when(has_anchors(), "⚓").otherwise(F.concat(F.lit("✓"), since.cast("string"), F.lit("d")))


def format_line(now: Column, settings: Settings = Settings()) -> Column:
    body = truncate_body(F.col("body"))
    head = F.concat(
        F.lit("- "), "id", F.lit(" "), F.coalesce("type", F.lit("observation")), F.lit(" ["), effective_source_kind(settings), F.lit("] "),
        witness_marker(now), F.lit(": "), F.coalesce("title", F.lit("")),
    )
    return F.when(body != "", F.concat(head, F.lit(" — "), body)).otherwise(head)


def add_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def default_check_by(now: Column, settings: Settings = Settings()) -> Column:
    return add_days(now, F.coalesce(lookup(F.col("type"), settings.decay_days), F.lit(settings.decay_days["fact"])))


def parse_ttl(text: Column, default: str = "7d") -> Column:
    """Micros of ``Nd``, ``Nh`` or ``Nm``; -1 for never; NULL for what is none of these."""
    t = F.coalesce(text, F.lit(default))
    n = F.nullif(F.regexp_extract(t, r"^(\d{1,6})[dhm]$", 1), F.lit("")).cast("long")
    return F.when(t == "never", F.lit(-1).cast("long")).otherwise(n * lookup(F.right(t, F.lit(1)), {"d": DAY_MICROS, "h": 3_600_000_000, "m": 60_000_000}))


def route_path(settings: Settings = Settings()) -> Column:
    area = F.when((F.col("kind") == "observation") | F.col("type").isNull(), "observations").when(
        effective_source_kind(settings) == "operator", F.concat(F.lit("memory/operator/"), "type", F.lit("s")),
    )
    return F.concat(area.otherwise(F.concat(F.lit("memory/"), "type", F.lit("s"))), F.lit("/"), "id", F.lit(".md"))


def target_path(settings: Settings = Settings()) -> Column:
    """Where a record belongs by its state, kind and tier."""
    return F.when(F.col("state") != "active", F.concat(F.lit("archive/"), "id", F.lit(".md"))).otherwise(route_path(settings))


def blob_sha(content: Column) -> Column:
    """The content hash of a file as version control computes it."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.lit(b"\x00"), F.encode(content, "utf-8")))


def freshness(now: Column, settings: Settings = Settings()) -> Column:
    age = F.greatest(days_between(now, F.coalesce("last_verified", "created")), F.lit(0.0))
    return F.coalesce(F.exp(-F.ln(F.lit(2.0)) * age / lookup(F.col("type"), settings.half_life_days)), F.lit(0.0))


def usage_boost(count: Column) -> Column:
    return F.log2(count + 1) * 0.25 + 1


def rank_score(now: Column, count: Column, settings: Settings = Settings()) -> Column:
    return F.round(F.coalesce(lookup(F.col("type"), settings.type_weight), F.lit(0.0)) * freshness(now, settings) * usage_boost(count), 6)
