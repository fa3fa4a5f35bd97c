"""Headers of older shape: reading them in today's shape, and planning their rewrite."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordloom.functions import records as R
from recordloom.runtime import stored
from recordloom.sources import markdown
from recordloom.sources.markdown import LEGACY, OLD_STATES

# Fixed value: the text given where no reason was kept.
NO_REASON = "(predates reason tracking)"


def with_legacy_columns(records: DataFrame) -> DataFrame:
    """Add the columns of older headers, NULL where the input has none."""
    missing = [f.split(" ", 1) for f in LEGACY.split(", ") if f.split(" ")[0] not in records.columns]
    return records.withColumns({name: F.lit(None).cast(kind) for name, kind in missing})


def plan(records: DataFrame, now, settings: R.Settings = R.Settings(), overrides: dict[str, str] | None = None) -> DataFrame:
    """Records in today's shape with ``target_path`` and ``changes``, the list of what was changed.

    Rules apply in a fixed order, each seeing the outcome of those before; a rewritten record has no
    further changes. A new name wins where both are present; ext keeps a retired confidence and gives
    up its anchors.
    """
    df = with_legacy_columns(records)
    log: list = []

    def rule(cond, message):
        log.append(F.when(F.coalesce(cond, F.lit(False)), message if not isinstance(message, str) else F.lit(message)))

    state = F.coalesce(R.lookup(F.col("state"), OLD_STATES), F.col("state"))
    rule(F.col("state").isin(*OLD_STATES), F.concat(F.lit("state "), "state", F.lit(" -> "), state))
    rule(F.col("kind").isNull(), "kind: claim (default)")
    rule(F.col("decay_after").isNotNull() & F.col("check_by").isNull(), "decay_after -> check_by")
    rule(F.col("corrects").isNotNull() & F.col("supersedes").isNull(), "corrects -> supersedes")
    rule(F.col("corrected_by").isNotNull() & F.col("superseded_by").isNull(), "corrected_by -> superseded_by")
    rule(F.col("correction_reason").isNotNull() & F.col("supersede_reason").isNull(), "correction_reason -> supersede_reason")
    by, why = F.coalesce("superseded_by", "corrected_by"), F.coalesce("supersede_reason", "correction_reason")
    bare = ((state == "superseded") | by.isNotNull()) & (F.coalesce(why, F.lit("")) == "")
    rule(bare, f'supersede_reason backfilled: "{NO_REASON}"')
    rule(F.col("code_anchors").isNotNull() & F.col("anchors").isNull(), "ext.code_anchors -> anchors")
    rule(F.col("code_anchors").isNotNull() & F.col("anchors").isNotNull(), "dropped duplicate ext.code_anchors")
    rule(F.col("confidence").isNotNull(), "confidence -> ext.legacy_confidence")
    inferred = R.infer_source_kind(F.col("source"), settings)
    if overrides:
        inferred = F.coalesce(R.lookup(F.col("source"), overrides), inferred)
    kind = F.coalesce("source_kind", inferred)
    rule(F.col("source_kind").isNull(), F.concat(F.lit("source_kind: "), inferred, F.lit(' (inferred from "'), F.coalesce("source", F.lit("")), F.lit('")')))
    shaped = df.withColumns({
        "was_path": F.col("file_path"), "was_witness": F.col("verified_with"), "was_stale": F.coalesce("stale", F.lit(False)), "early": F.array(*log),
        "state": state, "kind": F.coalesce("kind", F.lit("claim")), "check_by": F.coalesce("check_by", "decay_after"), "supersedes": F.coalesce("supersedes", "corrects"), "superseded_by": by,
        "supersede_reason": F.when(bare, NO_REASON).otherwise(why), "anchors": F.coalesce("anchors", "code_anchors"), "source_kind": kind,
        "ext": F.when(F.col("confidence").isNull() & F.col("code_anchors").isNull(), F.col("ext")).otherwise(_extended("ext", "confidence")),
    })
    witness = F.coalesce("verified_with", R.infer_verified_with(F.col("source_kind")))
    late = (F.col("state") == "active") & ~F.col("was_stale") & (R.stamp(F.col("check_by")) < now)
    late = F.coalesce(late, F.lit(False))
    shaped = shaped.withColumns({"verified_with": witness, "stale": F.when(late, True).otherwise(F.col("stale")), "late": late})
    shaped = shaped.withColumn("target_path", R.target_path(settings))
    rest = F.array(
        F.when(F.col("was_witness").isNull(), F.concat(F.lit("verified_with: "), "verified_with", F.lit(" (inferred)"))),
        F.when(F.col("late"), "stale: true (check_by in the past)"),
        F.when(F.col("target_path") != F.col("was_path"), F.concat(F.lit("relocate -> "), "target_path")),
    )
    shaped = shaped.withColumn("changes", F.array_compact(F.concat("early", rest)))
    drop = [f.split(" ")[0] for f in LEGACY.split(", ")]
    return shaped.drop("was_witness", "was_stale", "early", "late", *drop)


@F.pandas_udf(StringType())
def _extended(ext: pd.Series, confidence: pd.Series) -> pd.Series:
    """``ext`` without anchors and with a confidence it has not yet."""

    def one(text, sure):
        try:
            bag = json.loads(text or "{}")
        except ValueError:
            return text
        if not isinstance(bag, dict):
            return text
        bag.pop("code_anchors", None)
        if sure == sure and sure is not None:
            bag.setdefault("legacy_confidence", sure)
        return json.dumps(bag, sort_keys=True) if bag else None

    return pd.Series([one(t, c) for t, c in zip(ext, confidence, strict=True)], dtype=object)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The records of a store as their headers say them, older columns included, ready for ``plan``."""
    rows = markdown.scan_records(spark, root, legacy=True).where(F.col("error").isNull())
    times = {c: R.stamp(F.col(c)) for c in ("created", "last_verified", "expires", "valid_from", "valid_to")}
    return rows.withColumns(times | {"file_path": F.regexp_extract("path", r"((?:memory|observations|archive)/.*)$", 1)}).drop("path", "area", "is_operator", "error")


def apply(spark: SparkSession, root: str, now, settings: R.Settings = R.Settings(), overrides: dict[str, str] | None = None) -> DataFrame:
    """(path, outcome) of every file that was rewritten in today's shape, moved, or gave way to another.

    Files that need no change are not touched, files that are no records neither; a second run finds
    nothing to do. Each file is read once, and of several files of one id each has its own outcome.
    """
    changed = plan(read(spark, root), now, settings, overrides).where(F.size("changes") > 0)
    moves = stored(markdown.serialize(changed.withColumn("file_path", F.col("target_path")), F.col("was_path").alias("was")))
    return stored(markdown.relocate(moves, root))


#: Label of a change by how its text begins.
LABELS = {
    "state ": "state remapped", "kind:": "kind defaulted to claim", "decay_after": "decay_after -> check_by", "corrects": "corrects -> supersedes", "corrected_by": "corrected_by -> superseded_by",
    "correction_reason": "correction_reason -> supersede_reason", "supersede_reason": "supersede_reason backfilled", "ext.code_anchors": "ext.code_anchors -> anchors",
    "dropped duplicate": "duplicate ext.code_anchors dropped", "confidence": "confidence -> ext.legacy_confidence", "source_kind": "source_kind inferred", "verified_with": "verified_with inferred",
    "stale:": "stale flagged", "relocate": "relocations queued",
}


def summary(planned: DataFrame) -> DataFrame:
    """(label, n): how often each kind of change applies."""
    label = None
    for start, name in LABELS.items():
        label = F.when(F.col("c").startswith(start), name) if label is None else label.when(F.col("c").startswith(start), name)
    return planned.select(F.explode("changes").alias("c")).select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def source_kinds(records: DataFrame, settings: R.Settings = R.Settings()) -> DataFrame:
    """(source, bucket, inferred, n): every source with the tier read from its name."""
    rows = records.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("(unset)")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", R.canonical_source(F.col("source")).alias("bucket"), R.infer_source_kind(F.col("source"), settings).alias("inferred"), "n")


def operator_relocations(planned: DataFrame) -> DataFrame:
    """(id, from_path, to_path, source) of records that move to the area kept by people."""
    moves = planned.where((F.col("target_path") != F.col("was_path")) & F.col("target_path").contains("memory/operator"))
    return moves.select("id", F.col("was_path").alias("from_path"), F.col("target_path").alias("to_path"), "source")
