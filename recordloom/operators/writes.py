"""Lifecycle changes as batch transforms: each takes records and requests and gives changed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions import text as X
from recordloom.operators import reports

OVERRIDE_NOTE = " [override_operator used on operator-sourced record]"


def observe(texts: DataFrame, now: Column) -> DataFrame:
    """New observations: the first line is the title, the term sets expiry and check date.

    ``texts``: text, ttl, source. Blank texts and unreadable terms give no observation.
    """
    body = F.trim("text")
    ttl = R.parse_ttl(F.col("ttl"))
    until = F.when(ttl >= 0, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl / 1_000_000))
    rows = texts.withColumns({"body": body, "term": ttl}).where((F.col("body") != "") & F.col("term").isNotNull())
    return rows.select(
        F.lit("observation").alias("kind"), F.lit("active").alias("state"), F.coalesce("source", F.lit("agent")).alias("source"), F.substring(F.trim(F.split("body", "\n")[0]), 1, 120).alias("title"),
        "body", until.alias("expires"), F.coalesce(until.cast("string"), F.lit("never")).alias("check_by"), *[c for c in texts.columns if c not in (
            "text", "ttl", "source", "body", "title", "kind", "state", "expires", "check_by",
        )],
    )


def remember(incoming: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rejected, accepted): new claims with a twin are refused, others get their nearest neighbour.

    ``incoming``: id, type, title, tags, source, source_kind. A twin has the same type and normalised
    title, among active records or earlier (smaller id) in the batch. Sources that are blank or
    ``unknown`` are refused. A neighbour kept by a person gets no link from an agent.
    """
    key = X.normalise_title(F.col("title"))
    new = incoming.withColumn("key", key)
    nameless = F.lower(F.coalesce(F.trim("source"), F.lit(""))).isin("", "unknown")
    twin = active.select("type", key.alias("key"), F.lit(True).alias("twin")).distinct()
    order = F.row_number().over(Window.partitionBy("type", "key").orderBy("id"))
    judged = new.withColumn("nth", order).join(twin, ["type", "key"], "left")
    why = F.when(nameless, "source").when(F.col("twin"), "duplicate").when(F.col("nth") > 1, "duplicate in batch")
    judged = judged.withColumn("why", why)
    good = judged.where(F.col("why").isNull())
    near = reports.nearest(good, active)
    kinds = active.select(F.col("id").alias("id_b"), R.effective_source_kind().alias("their_kind"))
    linked = good.join(near, "id", "left").join(kinds, "id_b", "left")
    spare = (F.col("their_kind") == "operator") & (R.effective_source_kind() == "agent")
    accepted = linked.select(*incoming.columns, F.when(~F.coalesce(spare, F.lit(False)), F.col("id_b")).alias("conflicts_with_id"))
    return judged.where(F.col("why").isNotNull()).select("id", F.col("why").alias("reason")), accepted


def guard(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(id, reason, refused): what supersession of each request's target is refused for, if anything.

    ``requests``: id, reason, override. Records kept by a person need the override, which is noted.
    """
    rows = requests.join(records.select("id", "state", R.effective_source_kind().alias("who")), "id", "left")
    keeper = F.col("who") == "operator"
    refused = F.when(F.col("state").isNull(), "not found").when(F.col("state") != "active", F.concat(F.lit("is "), "state")).when(
        keeper & ~F.coalesce("override", F.lit(False)), "operator record",
    )
    return rows.select("id", F.when(keeper, F.concat("reason", F.lit(OVERRIDE_NOTE))).otherwise(F.col("reason")).alias("reason"), refused.alias("refused"))


def _collapse(records: DataFrame, gone: DataFrame) -> DataFrame:
    """Mark the records in ``gone`` (id, by, reason) superseded."""
    got = records.join(gone.select("id", F.col("by").alias("_by"), F.col("reason").alias("_why"), F.lit(True).alias("_gone")), "id", "left")
    return got.withColumns({
        "state": F.when(F.col("_gone"), "superseded").otherwise(F.col("state")), "superseded_by": F.when(F.col("_gone"), F.col("_by")).otherwise(F.col("superseded_by")),
        "supersede_reason": F.when(F.col("_gone"), F.col("_why")).otherwise(F.col("supersede_reason")),
    }).drop("_by", "_why", "_gone").select(records.columns)


def supersede_replace(records: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Records after each request (id, new_id, body, reason, override, source) put a new one in place.

    The new record inherits type, tags and title; its term starts anew. Refused requests change nothing.
    """
    ok = guard(requests, records).where(F.col("refused").isNull()).select("id", F.col("reason").alias("why"))
    going = requests.drop("reason").join(ok, "id").withColumnsRenamed({"source": "by_source", "body": "new_body"})
    born = records.join(going, "id").withColumns({
        "supersedes": F.array("id"), "supersede_reason": F.regexp_replace("why", r" \[override_operator.*$", ""), "id": F.col("new_id"), "kind": F.lit("claim"), "state": F.lit("active"),
        "created": now, "last_verified": now, "check_by": F.concat(
            F.date_format(R.default_check_by(now), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"),
        ), "source": F.col("by_source"), "body": F.col("new_body"),
        "superseded_by": F.lit(None).cast("string"),
    }).select(records.columns)
    return _collapse(records, going.select("id", F.col("new_id").alias("by"), F.col("why").alias("reason"))).unionByName(born)


def supersede_merge(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records after each request (id, into, reason, override) folds a record into a surviving one."""
    survivors = records.where(F.col("state") == "active").select(F.col("id").alias("into"))
    asked = requests.where(F.col("id") != F.col("into")).join(survivors, "into", "left_semi")
    ok = guard(asked, records).where(F.col("refused").isNull()).select("id", F.col("reason").alias("why"))
    going = asked.select("id", "into").join(ok, "id")
    gained = going.groupBy(F.col("into").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("_more"))
    done = _collapse(records, going.select("id", F.col("into").alias("by"), F.col("why").alias("reason"))).join(gained, "id", "left")
    none = F.array().cast("array<string>")
    return done.withColumn(
        "supersedes",
        F.when(F.col("_more").isNotNull(), F.array_union(F.coalesce("supersedes", none), "_more")).otherwise(F.col("supersedes")),
    ).select(records.columns)


def supersede_retract(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records after each request (id, reason, override) retires a record without a successor."""
    ok = guard(requests, records).where(F.col("refused").isNull())
    return _collapse(records, ok.select("id", F.lit(None).cast("string").alias("by"), "reason"))


def relate(records: DataFrame, requests: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(changed, refused): links (id, target) added to ``field`` once; self-links and unknown ends refused."""
    ids = records.select("id")
    known = requests.distinct().join(ids, "id", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi",
    ).where(F.col("id") != F.col("target"))
    gained = known.groupBy("id").agg(F.sort_array(F.collect_set("target")).alias("_more"))
    none = F.array().cast("array<string>")
    changed = records.join(gained, "id").withColumn(field, F.array_union(F.coalesce(field, none), "_more")).select(records.columns)
    return changed, requests.select("id", "target").exceptAll(known.select("id", "target"))


def verify(records: DataFrame, drift: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """(id, status, verified_with, check_by) of each request (id, evidence, source) on an active record.

    ``needs_review`` where an anchor changed, is missing or out of reach - such a record stays as it
    is; ``refused`` without anchors and evidence; else the record is verified and its term starts anew.
    """
    state = drift.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "unchanged").alias("bad"))
    rows = requests.select("id", "evidence", F.col("source").alias("by")).join(records.where(F.col("state") == "active"), "id").join(state, "id", "left")
    anchored = F.coalesce("n", F.lit(0)) > 0
    status = F.when(F.col("bad") > 0, "needs_review").when(anchored, "verified").when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "refused").otherwise("verified_inferred")
    rows = rows.withColumn("status", status)
    done = F.col("status").startswith("verified")
    witness = F.when(anchored, "anchor").when(R.infer_source_kind(F.col("by")) == "operator", "operator").otherwise("evidence")
    due = F.when(F.col("check_by") == "never", "never").otherwise(F.concat(F.date_format(R.default_check_by(now), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")))
    return rows.select(
        "id", "status", F.when(done, witness).otherwise(F.coalesce("verified_with", F.lit("assertion"))).alias("verified_with"),
        F.when(done, due).otherwise(F.col("check_by")).alias("check_by"),
    )


def anchor_merge(records: DataFrame, fresh: DataFrame, replace: bool = False) -> DataFrame:
    """(id, anchors): fresh anchors (id, file, sha, repo) win over existing ones of the same file and come last."""
    one = fresh.groupBy("id", "file").agg(F.min(F.struct("repo", "sha")).alias("m")).select("id", "file", "m.sha", "m.repo")
    new = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("file", "sha", "repo"))).alias("fresh"))
    old = F.array().cast("array<struct<file:string,sha:string,repo:string>>") if replace else F.coalesce(
        "anchors", F.array().cast("array<struct<file:string,sha:string,repo:string>>"),
    )
    got = records.where(F.col("state") == "active").join(new, "id")
    files = F.transform("fresh", lambda f: f["file"])
    return got.select("id", F.concat(F.filter(old, lambda a: ~F.array_contains(files, a["file"])), "fresh").alias("anchors"))


def sweep(records: DataFrame, now: Column) -> DataFrame:
    """Active claims that are stale by now: what a sweep would retire."""
    return records.where((F.col("state") == "active") & R.lazy_stale(now))


def archive(records: DataFrame, ids: DataFrame, state: str = "retired") -> DataFrame:
    """Records after the given ids moved to the archive in ``state``."""
    got = records.join(ids.select("id", F.lit(True).alias("_go")).distinct(), "id", "left")
    return got.withColumns({
        "state": F.when(F.col("_go"), state).otherwise(F.col("state")),
        "file_path": F.when(F.col("_go"), F.concat(F.lit("archive/"), "id", F.lit(".md"))).otherwise(F.col("file_path")),
    }).select(records.columns)
