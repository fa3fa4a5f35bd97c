"""Reports over records: staleness, drift, conflicts, counts, boot list and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions import text as X
from recordloom.runtime import stored

PINNED_CAP, ATTENTION_CAP, HARD_LIMIT, USAGE_DAYS = 5, 3, 20, 30


def usage_counts(usage: DataFrame, now: Column, days: int = USAGE_DAYS) -> DataFrame:
    """(id, uses): retrievals of the last days; rows without id or time do not count.

    One id may hold most of the log: counts combine before the shuffle.
    """
    since = R.add_days(now, F.lit(-days))
    return usage.where(F.col("id").isNotNull() & (F.col("retrieved_at") >= since) & (F.col("retrieved_at") <= now)).groupBy("id").agg(F.count(F.lit(1)).alias("uses"))


def anchors_view(records: DataFrame) -> DataFrame:
    """(id, file, sha, repo): every anchor once per record and file, with the smallest hash given."""
    each = records.select("id", F.explode("anchors").alias("a")).select("id", "a.file", "a.sha", F.coalesce("a.repo", F.lit("")).alias("repo"))
    return each.where(F.col("file").isNotNull()).groupBy("id", "file", "repo").agg(F.min("sha").alias("sha"))


def anchor_drift(anchors: DataFrame, files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(id, file, repo, status): unchanged, changed, missing or repo_unavailable.

    ``files``: repo, file, current_sha. ``repos``: the repositories at hand; without it all are.
    """
    got = anchors.join(files, ["repo", "file"], "left")
    known = F.lit(True)
    if repos is not None:
        got = got.join(repos.select("repo").distinct().withColumn("at_hand", F.lit(True)), "repo", "left")
        known = F.col("at_hand").isNotNull() | (F.col("repo") == "")
    status = F.when(~known, "repo_unavailable").when(F.col("current_sha").isNull(), "missing").when(F.col("current_sha") == F.col("sha"), "unchanged").otherwise("changed")
    return got.select("id", "file", "repo", status.alias("status"))


def drift_agg(drift: DataFrame) -> DataFrame:
    """(id, files, note): what drifted, per record."""
    bad = drift.where(F.col("status") != "unchanged").groupBy("id").agg(F.sort_array(F.collect_set("file")).alias("f"))
    return bad.select("id", F.size("f").alias("files"), F.concat(F.lit("anchor drift: "), F.array_join("f", ", ")).alias("note"))


def decay_candidates(records: DataFrame, drifted: DataFrame, now: Column, settings: R.Settings = R.Settings()) -> DataFrame:
    """(id, reason, days_expired): active records past their check, or whose anchors drifted.

    Without a check-by date the deadline is the last verification plus the type's term. ``never`` and
    unreadable dates have none. An expired record is not listed as drifted.
    """
    due = F.when(
        F.col("check_by").isNull(),
        R.add_days(F.coalesce("last_verified", "created"), F.coalesce(R.lookup(F.col("type"), settings.decay_days), F.lit(90))),
    ).otherwise(R.stamp(F.col("check_by")))
    rows = records.where(F.col("state") == "active").withColumn("due", due).join(drifted.select("id", F.lit(True).alias("drift")), "id", "left")
    expired = F.coalesce(F.lit(now) > F.col("due"), F.lit(False))
    return rows.where(expired | F.col("drift")).select(
        "id", F.when(expired, "expired").otherwise("drift").alias("reason"), F.when(expired, F.floor(R.days_between(now, F.col("due")))).otherwise(0).cast("int").alias("days_expired")
    )


def declared_conflicts(active: DataFrame) -> DataFrame:
    """(id_a, id_b, title_b): declared conflicts, each unordered pair once."""
    from recordloom.operators.graph import edges_view

    pairs = edges_view(active, ("conflicts_with",)).select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).distinct()
    return pairs.join(
        active.select(F.col("id").alias("id_b"), F.col("title").alias("title_b")), "id_b", "left",
    ).select("id_a", "id_b", F.coalesce("title_b", F.lit("(not in active set)")).alias("title_b"))


def title_buckets(active: DataFrame) -> DataFrame:
    """(id, class_id, members): typed records whose titles begin alike, by the smallest id of the bucket.

    A bucket of any size is one class, not a list of its pairs; titles without letters are in none.
    """
    keyed = active.where(F.col("type").isNotNull()).select("id", "type", X.title_key(F.col("title")).alias("key")).where(F.col("key") != "")
    sizes = keyed.groupBy("type", "key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    return keyed.join(sizes, ["type", "key"]).select("id", "class_id", "members")


def conflict_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): typed records with equal title words and tags are one class, named by the smallest id.

    members: id, class_id. classes: class_id, type, words, tags, members. NULL and repeated tags do not count.
    """
    tags = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))))
    rows = stored(records.where(F.col("type").isNotNull()).select(
        "id", "type", F.array_sort(X.title_tokens(F.col("title"))).alias("words"), tags.alias("tags"),
    ))
    classes = stored(rows.groupBy("type", "words", "tags").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    return rows.join(classes.drop("members"), ["type", "words", "tags"]).select("id", "class_id"), classes


def conflict_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, shared_tokens, shared_tags): classes of the same type with a shared tag and two shared title words.

    ``left`` and ``right`` are classes (see ``conflict_classes``), named by their ids. Without ``right``
    id_a < id_b, and a class of several records that conflict with each other is paired with itself. A
    join on pairs of title words, which every match shares, gives the candidates; what they share is
    read once per candidate.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        here = F.col("words")
        pairs = F.flatten(F.transform(here, lambda x, i: F.transform(F.slice(here, i + 2, F.size(here)), lambda y: F.concat_ws(" ", x, y))))
        return df.select(F.col("class_id").alias(name), "type", F.explode(pairs).alias("key"))

    other = left if right is None else right
    order = F.col("id_a") < F.col("id_b") if right is None else F.lit(True)
    met = keyed(left, "id_a").join(keyed(other, "id_b"), ["type", "key"]).where(order).select("id_a", "id_b").distinct()
    if right is None:
        met = met.unionByName(left.where((F.col("members") > 1) & (F.size("words") > 1)).select(
            F.col("class_id").alias("id_a"), F.col("class_id").alias("id_b"),
        ))
    side = lambda df, name: df.select(F.col("class_id").alias(f"id_{name}"), F.col("words").alias(f"w_{name}"), F.col("tags").alias(f"t_{name}"))
    both = met.join(side(left, "a"), "id_a").join(side(other, "b"), "id_b").where(F.arrays_overlap("t_a", "t_b"))
    return both.select(
        "id_a", "id_b", F.size(F.array_intersect("w_a", "w_b")).alias("shared_tokens"),
        F.size(F.array_intersect("t_a", "t_b")).alias("shared_tags"),
    )


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, id_b): of each left record the right one with most shared title words, then tags, then the smallest id.

    Equal records have equal neighbours, so classes are compared and their members told.
    """
    members, classes = conflict_classes(left)
    pairs = conflict_pairs(classes, conflict_classes(right)[1])
    best = pairs.groupBy("id_a").agg(F.min(F.struct(-F.col("shared_tokens"), -F.col("shared_tags"), "id_b")).alias("m"))
    return members.join(best.select(F.col("id_a").alias("class_id"), F.col("m.id_b").alias("id_b")), "class_id").select("id", "id_b")


def boot_rank(active: DataFrame, uses: DataFrame, now: Column) -> DataFrame:
    """Typed records with their boot score; untyped ones score 0."""
    return active.join(uses, "id", "left").withColumn("score", R.rank_score(now, F.coalesce("uses", F.lit(0))))


def attention(active: DataFrame, drifted: DataFrame, now: Column) -> DataFrame:
    """(id, note, is_drift, overdue): drifted records, then stale ones by how long they are overdue."""
    due = F.floor(R.days_between(now, R.stamp(F.col("check_by"))))
    rows = active.join(drifted.select("id", "note"), "id", "left").withColumn(
        "stale_now", R.lazy_stale(now) & (F.coalesce("kind", F.lit("claim")) != "observation"),
    )
    keep = rows.where(F.col("note").isNotNull() | F.col("stale_now"))
    overdue = F.greatest(F.coalesce(due, F.lit(0)), F.lit(0)).cast("int")
    return keep.select(
        "id", F.coalesce("note", F.concat(F.lit("check-by passed "), overdue.cast("string"), F.lit("d ago"))).alias("note"),
        F.col("note").isNotNull().alias("is_drift"), F.when(F.col("note").isNotNull(), 0).otherwise(overdue).alias("overdue"),
    )


def pinned(active: DataFrame, cap: int = PINNED_CAP) -> DataFrame:
    return active.where(F.coalesce("pinned", F.lit(False))).orderBy(F.desc("last_verified"), "id").limit(cap)


def budget(sections: list[tuple[DataFrame, int]], budget_tokens: int, total_limit: int = HARD_LIMIT, used: int = 0, skip: bool = False) -> DataFrame:
    """(section, pos, id, cost, taken): greedy fill of one budget, section after section.

    Each section is (id, pos, cost) in order with its cap. An item that does not fit ends its section,
    or with ``skip`` is passed over; the first item of all is always taken. At most a cap of rows per
    section is folded, as one array, so the fold is bounded.
    """
    rows = None
    for i, (df, cap) in enumerate(sections):
        # With ``skip`` later items may still fit, so a section keeps all it was given.
        one = df.select("id", "pos", "cost") if skip else df.select("id", "pos", "cost").orderBy("pos").limit(min(cap, total_limit))
        one = one.withColumns({"section": F.lit(i), "cap": F.lit(cap)})
        rows = one if rows is None else rows.unionByName(one)
    items = rows.agg(F.array_sort(F.collect_list(F.struct("section", "pos", "id", F.col("cost").cast("int").alias("cost"), "cap"))).alias("items"))
    start = F.struct(
        F.lit(used).alias("used"), F.lit(0).alias("total"), F.lit(-1).alias("section"), F.lit(0).alias("n"), F.lit(False).alias("closed"),
        F.array().cast("array<boolean>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        fresh = s["section"] != x["section"]
        n, closed = F.when(fresh, 0).otherwise(s["n"]), F.when(fresh, False).otherwise(s["closed"])
        over = (s["used"] + x["cost"] > budget_tokens) & (s["total"] > 0)
        full = (n >= x["cap"]) | (s["total"] >= total_limit)
        take = ~closed & ~full & ~over
        return F.struct(
            (s["used"] + F.when(take, x["cost"]).otherwise(0)).alias("used"), (s["total"] + take.cast("int")).alias("total"), x["section"].alias("section"),
            (n + take.cast("int")).alias("n"), (closed | (~take & F.lit(not skip))).alias("closed"), F.concat(s["out"], F.array(take)).alias("out"),
        )

    done = items.select("items", F.aggregate("items", start, step)["out"].alias("out"))
    flat = done.select(F.explode(F.arrays_zip("items", "out")).alias("z"))
    return flat.select("z.items.section", "z.items.pos", "z.items.id", "z.items.cost", F.col("z.out").alias("taken"))


def context(active: DataFrame, uses: DataFrame, drifted: DataFrame, now: Column, budget_tokens: int = 2000, limit: int = HARD_LIMIT) -> DataFrame:
    """The boot list: needs-attention, pinned and working sections under one token budget."""
    limit = min(limit, HARD_LIMIT)
    wanted = stored(attention(active, drifted, now))
    shown = stored(wanted.orderBy(F.desc("is_drift"), F.desc("overdue"), "id").limit(ATTENTION_CAP))
    rest = active.join(F.broadcast(shown.select("id")), "id", "left_anti")
    pins = stored(pinned(rest))
    main = rest.join(F.broadcast(pins.select("id")), "id", "left_anti")
    ranked = stored(boot_rank(main, uses, now).orderBy(F.desc("score"), "id").limit(limit))
    n, m = active.count(), wanted.count()
    note = f", {m} need attention" if m else ""
    header = f"## Project memory — {n} active claims{note}"
    line = R.format_line(now)
    cost = lambda c: X.estimate_tokens(F.concat(c, F.lit("\n")))
    number = lambda *o: F.row_number().over(Window.orderBy(*o))
    a = active.join(F.broadcast(shown.drop("overdue", "is_drift").join(shown.select("id", "is_drift", "overdue"), "id")), "id")
    sections = [
        (
            a.select(
                "id", number(F.desc("is_drift"), F.desc("overdue"), "id").alias("pos"),
                cost(F.concat(line, F.lit(" ("), "note", F.lit(")"))).alias("cost"),
            ),
            ATTENTION_CAP,
        ),
        (pins.select("id", number(F.desc("last_verified"), "id").alias("pos"), cost(line).alias("cost")), PINNED_CAP),
        (ranked.select("id", number(F.desc("score"), "id").alias("pos"), cost(line).alias("cost")), limit),
    ]
    return budget(sections, budget_tokens, limit, -(-len(header + "\n\n") // 4))


# The shapes a header's fields must have.
_ID, _ISO = r"^ms_[A-Z0-9]{26}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def validate(records: DataFrame) -> DataFrame:
    """(id, errors): the constraint violations of each record, as ``field: what is wrong``."""
    bad = lambda cond, msg: F.when(cond, F.lit(msg))
    off = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    claim = F.coalesce("kind", F.lit("claim")) != "observation"
    checks = [
        bad(F.col("id").isNull() | ~F.col("id").rlike(_ID), "id: bad form"),
        bad(off("kind", ("claim", "observation")), "kind: unknown"),
        bad(off("type", ("fact", "decision", "procedure")), "type: unknown"),
        bad(F.col("type").isNull() & claim, "type: required for claims"),
        bad(F.col("state").isNull() | off("state", ("active", "superseded", "retired")), "state: unknown"),
        bad(F.col("created").isNull(), "created: missing"),
        bad(F.coalesce(F.trim("source"), F.lit("")) == "", "source: empty"),
        bad(off("source_kind", ("operator", "agent", "import")), "source_kind: unknown"),
        bad(off("verified_with", ("anchor", "operator", "evidence", "assertion")), "verified_with: unknown"),
        bad(F.col("check_by").isNull() | ~((F.col("check_by") == "never") | F.col("check_by").rlike(_ISO)), "check_by: no date"),
        bad(F.col("valid_from") > F.col("valid_to"), "valid_to: before valid_from"),
    ]
    return records.select("id", F.array_compact(F.array(*checks)).alias("errors"))
