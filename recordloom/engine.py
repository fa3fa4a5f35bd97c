"""One object over a store of records: the calls a user makes, each giving a DataFrame."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions import text as X
from recordloom.operators import exports, graph, migrate, reports, search, writes
from recordloom.runtime import forget, ship, stored
from recordloom.sources import imports, layers, markdown
from recordloom.sources.config import Config

TYPES = ("fact", "decision", "procedure")
_TIMES = ("created", "last_verified", "expires", "valid_from", "valid_to")


def _checked_type(kind: str | None) -> str | None:
    if kind is not None and kind not in TYPES:
        raise ValueError(f"unsupported type: {kind}")
    return kind


def _checked_number(name: str, n: int, most: int | None = None) -> int:
    if not isinstance(n, int) or n < 1 or (most is not None and n > most):
        raise ValueError(f"invalid {name}: {n}")
    return n


def _instant(name: str, text: str) -> Column:
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"invalid {name}: {text}") from None
    utc = at.astimezone(tz=None).utctimetuple() if at.tzinfo else at.timetuple()
    return F.lit(datetime(*utc[:6], at.microsecond)).cast("timestamp_ntz")


class Engine:
    """Records, their usage log and the files they are anchored to, at one moment.

    ``records`` has the columns of ``markdown.HEADER`` with times as timestamps without zone, title,
    body and file_path. ``now`` is fixed at construction, so that all answers agree with each other.
    """

    def __init__(
        self, records: DataFrame, now: str | None = None, usage: DataFrame | None = None, files: DataFrame | None = None, settings: R.Settings | None = None, config: Config | None = None
    ):
        self.spark = records.sparkSession
        ship(self.spark)
        self.records = records
        self.config = config or Config()
        self.settings = settings or self.config.settings
        self.now = _instant("now", now or datetime.now().astimezone().isoformat())
        self._usage, self._files = usage, files

    @classmethod
    def from_store(cls, spark: SparkSession, *roots: str, **more) -> Engine:
        """Stores of Markdown files, the first winning where ids meet.

        Files without a header, or with one that is not a record's, are left out; ``markdown.scan_records``
        lists them with what is wrong.
        """
        rows = None
        for place, root in enumerate(roots):
            ship(spark)
            one = markdown.scan_records(spark, root).where(F.col("error").isNull())
            one = one.withColumns({c: R.stamp(F.col(c)) for c in _TIMES}).withColumns({
                "file_path": F.regexp_extract("path", r"((?:memory|observations|archive)/.*)$", 1), "layer": F.lit(str(place)),
                "loaded_at": F.col("created"), "ref_table": F.lit("store"),
            })
            one = layers.resolve_collisions(one.drop("path", "error", "is_operator", "area")).withColumn("place", F.lit(place))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            raise ValueError("no store given")
        table = spark.createDataFrame([(str(i), -i) for i in range(len(roots))], "name string, priority int")
        return cls(stored(layers.layered(rows, table).drop("place")), **more)

    # --- reading ---

    @property
    def active(self) -> DataFrame:
        return self.records.where(F.col("state") == "active")

    def get(self, *ids: str) -> DataFrame:
        return self.records.where(F.col("id").isin(*ids))

    def uses(self) -> DataFrame:
        if self._usage is None:
            return self.spark.createDataFrame([], "id string, uses long")
        return reports.usage_counts(self._usage, self.now)

    def drift(self) -> DataFrame:
        """Anchors of active records against the files at hand; without files nothing is known to drift."""
        anchors = reports.anchors_view(self.active)
        if self._files is None:
            return anchors.select("id", "file", "repo", F.lit("unchanged").alias("status"))
        return reports.anchor_drift(anchors, self._files)

    def search(
        self, query: str, limit: int = 10, type: str | None = None, as_of: str | None = None, expand_edges: bool = False, edge_types: tuple[str, ...] = graph.EDGE_TYPES,
        expand_depth: int = 1, include_superseded: bool = False, full: int | None = None, profile: str = "default",
    ) -> DataFrame:
        """Ranked records, then (``expand_edges``) those they lead to; ``full`` is a token budget for bodies.

        ``profile`` names the types and weights of a profile of the configuration; a type goes before it.
        Results are cut to ``limit`` first and reduced to those valid ``as_of`` a time after that.
        Columns: rank, id, type, title, score, preview, from_id, edge_type, hops, stale, witness, body.
        """
        _checked_number("limit", limit, 50)
        unknown = set(edge_types) - set(graph.EDGE_TYPES)
        if unknown:
            raise ValueError(f"unknown edge types: {sorted(unknown)}")
        if profile not in self.config.profiles:
            raise ValueError(f"unknown profile: {profile}")
        how = self.config.profiles[profile]
        types = [_checked_type(type)] if type else list(how.types)
        settings = self.settings if profile == "default" else replace(self.settings, relevance=how.relevance, recency=how.recency)
        top = search.search(self.active, query, self.now, limit, types, settings)
        if as_of is not None:
            top = top.where(R.valid_as_of(_instant("as_of", as_of)))
        none = F.lit(None).cast("string")
        hits = stored(top.select(
            "id", F.col("rank").cast("long").alias("rank"), "score", none.alias("from_id"), none.alias("edge_type"), F.lit(0).alias("hops"),
        ))
        if expand_edges:
            pool = self.records.where(F.col("state").isin("active", "superseded")) if include_superseded else self.active
            more = graph.expand_graph(hits.select("id", F.col("rank").alias("pos")), stored(graph.edges_view(pool, edge_types)), expand_depth)
            known = more.join(pool.select("id"), "id", "left_semi")
            hits = hits.unionByName(known.select(
                "id", (F.col("pos") + limit).alias("rank"), F.lit(None).cast("double").alias("score"), "from_id", "edge_type", "hops",
            ))
        rows = self.records.join(F.broadcast(hits), "id").select(
            "rank", "id", "type", "title", "score", X.preview(F.col("body")).alias("preview"), "from_id", "edge_type", "hops", R.lazy_stale(self.now).alias("stale"), R.witness_of().alias("witness"), "body"
        )
        if full is None:
            return rows.drop("body").orderBy("rank")
        _checked_number("full", full)
        fits = reports.budget(
            [(rows.select("id", F.col("rank").alias("pos"), X.estimate_tokens(F.coalesce("body", F.lit(""))).alias("cost")), limit + graph.MAX_RESULTS)],
            full, limit + graph.MAX_RESULTS, 0, True,
        )
        return rows.join(F.broadcast(fits.where("taken").select("id")), "id", "left_semi").orderBy("rank")

    def context(self, budget: int = 2000, limit: int = reports.HARD_LIMIT, type: str | None = None) -> DataFrame:
        """The boot list: (section, pos, id, line) of what fits the budget."""
        _checked_number("budget", budget)
        _checked_number("limit", limit)
        active = self.active if _checked_type(type) is None else self.active.where(F.col("type") == type)
        taken = reports.context(active, self.uses(), reports.drift_agg(self.drift()), self.now, budget, limit).where("taken")
        return active.join(F.broadcast(taken), "id").select(
            "section", "pos", "id", R.format_line(self.now, self.settings).alias("line"),
        ).orderBy("section", "pos")

    def status(self) -> DataFrame:
        """(section, value, n): counts by state, type and witness, stale, drifted and conflicting records."""
        live = self.active.where(F.col("type").isNotNull())
        count = lambda d, section, value: d.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "value", "n")
        total = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), F.lit("all").alias("value"), "n")
        parts = [
            count(self.records, "state", F.col("state")), count(live, "type", F.col("type")), count(
                live, "witness", F.coalesce("verified_with", F.lit("assertion")),
            ), total(self.records, "total"),
            total(live.where(F.coalesce("stale", F.lit(False))), "stale"), total(reports.drift_agg(self.drift()), "drifted"), total(
                reports.declared_conflicts(self.active), "declared conflicts",
            ),
            # Pairs of the buckets, by their sizes.
            reports.title_buckets(self.active).agg(F.coalesce(F.sum((F.col("members") - 1) / 2), F.lit(0)).cast("long").alias("n")).select(
                F.lit("title overlaps").alias("section"), F.lit("all").alias("value"), "n",
            ),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def reconcile(self, renames: DataFrame | None = None) -> DataFrame:
        """(id, file, status, renamed_to): anchors that changed or went missing."""
        bad = self.drift().where(F.col("status") != "unchanged")
        if renames is None:
            return bad.select("id", "file", "status", F.lit(None).cast("string").alias("renamed_to"))
        return bad.join(
            renames.select(F.col("old").alias("file"), F.col("new").alias("renamed_to")), "file", "left",
        ).select("id", "file", "status", "renamed_to")

    def lineage(self, id: str) -> DataFrame:
        """(role, id, title): what a record replaced, what replaced it and what it is built on."""
        before, after = graph.lineage(self.records)
        rows = before.where(F.col("id") == id).select(F.lit("ancestor").alias("role"), F.col("ancestor").alias("id"))
        rows = rows.unionByName(after.where(F.col("id") == id).select(F.lit("descendant").alias("role"), F.col("descendant").alias("id")))
        for field in ("refines", "supports", "depends_on"):
            rows = rows.unionByName(graph.relation_chain(self.records, field).where(F.col("id") == id).select(F.lit(field).alias("role"), F.col("target").alias("id")))
        return rows.join(self.records.select("id", "title"), "id").select("role", "id", "title")

    def conflicts(self) -> DataFrame:
        """(id_a, id_b, shared_tokens, shared_tags) of classes of records with equal title words and tags."""
        return reports.conflict_pairs(reports.conflict_classes(self.active)[1])

    def decaying(self) -> DataFrame:
        return reports.decay_candidates(self.records, reports.drift_agg(self.drift()), self.now, self.settings)

    def invalid(self) -> DataFrame:
        return reports.validate(self.records).where(F.size("errors") > 0)

    def sweepable(self) -> DataFrame:
        return writes.sweep(self.records, self.now)

    def at(self, files: DataFrame) -> Engine:
        """The same records with these files (repo, file, current_sha) at hand."""
        other = Engine(self.records, None, self._usage, files, self.settings, self.config)
        other.now = self.now
        return other

    def anchored(self) -> DataFrame:
        return reports.anchors_view(self.active).select("repo", "file").distinct()

    def export(self, form: str, include_superseded: bool = False, types: tuple[str, ...] = TYPES) -> DataFrame:
        """(part, key, value): the graph as ``jsonl``, ``graphml`` or ``dot`` text."""
        if form not in ("jsonl", "graphml", "dot"):
            raise ValueError(f"unsupported form: {form}")
        chosen = stored(exports.projected(self.records, include_superseded, types))
        return exports.document(getattr(exports, form)(exports.nodes(chosen), exports.edges(chosen, include_superseded)), form)

    def migration(self, overrides: dict[str, str] | None = None) -> DataFrame:
        return migrate.plan(self.records, self.now, self.settings, overrides)

    def views(self) -> None:
        """Temporary views ``records``, ``edges`` and ``postings`` for SQL."""
        self.records.createOrReplaceTempView("records")
        graph.edges_view(self.records).createOrReplaceTempView("edges")
        search.postings(self.active).createOrReplaceTempView("postings")

    # --- changing: each gives the engine after the change ---

    def close(self) -> None:
        """Delete what this session stored; its results cannot be read any more."""
        forget(self.spark)

    def _with(self, records: DataFrame) -> Engine:
        after = Engine(stored(records), None, self._usage, self._files, self.settings, self.config)
        after.now = self.now
        return after

    def remember(self, incoming: DataFrame) -> tuple[Engine, DataFrame]:
        """(engine, rejected) after new claims (id, type, title, body, tags, source, source_kind)."""
        rejected, accepted = writes.remember(incoming, self.active)
        new = accepted.select(
            "id", F.lit("claim").alias("kind"), "type", F.lit("active").alias("state"), self.now.alias("created"), "source", F.coalesce(
                "source_kind", R.infer_source_kind(F.col("source"), self.settings),
            ).alias("source_kind"), "tags",
            F.concat(
                F.date_format(R.default_check_by(self.now, self.settings), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"),
            ).alias("check_by"), self.now.alias("last_verified"),
            F.when(R.effective_source_kind(self.settings) == "operator", "operator").otherwise("assertion").alias("verified_with"), F.when(
                F.col("conflicts_with_id").isNotNull(), F.array("conflicts_with_id"),
            ).alias("conflicts_with"), "title", "body",
        ).withColumn("file_path", R.route_path(self.settings))
        return self._with(self.records.unionByName(new, allowMissingColumns=True)), stored(rejected)

    def observe(self, texts: DataFrame) -> Engine:
        """After new observations (id, text, ttl, source)."""
        new = writes.observe(texts, self.now).withColumns({
            "created": self.now, "last_verified": self.now, "source_kind": F.lit("agent"), "type": F.lit(None).cast("string"),
        }).withColumn("file_path", R.route_path(self.settings))
        return self._with(self.records.unionByName(new, allowMissingColumns=True))

    def supersede(self, requests: DataFrame, how: str) -> Engine:
        """After ``replace``, ``merge`` or ``retract`` requests, see ``operators.writes``."""
        if how == "replace":
            return self._with(writes.supersede_replace(self.records, requests, self.now))
        if how == "merge":
            return self._with(writes.supersede_merge(self.records, requests))
        if how == "retract":
            return self._with(writes.supersede_retract(self.records, requests))
        raise ValueError(f"unsupported: {how}")

    def relate(self, requests: DataFrame, field: str) -> Engine:
        if field not in graph.EDGE_TYPES[:4]:
            raise ValueError(f"unsupported relation: {field}")
        changed = stored(writes.relate(self.records, requests, field)[0])
        return self._with(self.records.join(changed.select("id"), "id", "left_anti").select(self.records.columns).unionByName(changed))

    def sweep(self, approved: DataFrame | None = None) -> Engine:
        """After the sweepable records (only those approved, if given) moved to the archive."""
        going = self.sweepable().select("id")
        return self._with(writes.archive(self.records, going if approved is None else going.join(approved.select("id"), "id", "left_semi")))

    def amend(self, id: str, fields: dict) -> Engine:
        """After fields of one record were set; fields that are None stay as they are."""
        kinds = dict(self.records.dtypes)
        given = {k: R.stamp(F.lit(v)) if kinds[k].startswith("timestamp") else F.lit(v).cast(kinds[k]) for k, v in fields.items() if v is not None}
        if not given:
            return self
        return self._with(self.records.withColumns({k: F.when(F.col("id") == id, v).otherwise(F.col(k)) for k, v in given.items()}))

    def take_in(self, folder: str) -> tuple[Engine, DataFrame]:
        """(engine, rejected) after the notes in a folder - tables, observations, loose files - became claims."""
        texts = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
        notes = stored(texts.select("path", F.decode("content", "utf-8").alias("content")))
        claim = lambda df, kind, tags=None: df.select(
            kind.alias("type"), "title", "body", (F.array().cast("array<string>") if tags is None else tags).alias("tags"),
        )
        today = self.spark.range(1).select(F.date_format(self.now, "yyyy-MM-dd").alias("d")).first().d
        main = notes.where(F.col("path").endswith("MEMORY.md"))
        seen = imports.observations(notes.where(F.col("path").endswith("observations.md")))
        loose = imports.loose_files(notes.where(~F.col("path").rlike(r"(MEMORY|observations)\.md$")))
        found = claim(imports.facts(main), F.lit("fact"), F.col("tags")).unionByName(claim(imports.decisions(main, today), F.lit("decision"))).unionByName(claim(imports.lessons(main), F.lit("fact")))
        found = found.unionByName(claim(seen.withColumn("body", F.col("title")), F.col("type"))).unionByName(claim(loose, F.col("type")))
        # Ids follow from the content, so that a note taken in twice is one record.
        ids = F.concat(F.lit("ms_"), F.substring(F.upper(F.sha1(F.concat_ws("\n", "type", "title", "body"))), 1, 26))
        return self.remember(found.dropDuplicates(["type", "title"]).select(
            ids.alias("id"), "type", "title", "body", "tags", F.lit("notes-import").alias("source"), F.lit("import").alias("source_kind"),
        ))

    def verify(self, requests: DataFrame) -> tuple[Engine, DataFrame]:
        """(engine, outcomes) after requests (id, evidence, source) to confirm active records."""
        got = stored(writes.verify(self.records, self.drift(), requests, self.now))
        good = got.where(F.col("status").startswith("verified")).select("id", F.col("verified_with").alias("_with"), F.col("check_by").alias("_due"))
        after = self.records.join(good, "id", "left")
        done = F.col("_with").isNotNull()
        after = after.withColumns({
            "verified_with": F.when(done, F.col("_with")).otherwise(F.col("verified_with")), "check_by": F.when(done, F.col("_due")).otherwise(F.col("check_by")),
            "last_verified": F.when(done, self.now).otherwise(F.col("last_verified")), "stale": F.when(done, False).otherwise(F.col("stale")),
        }).select(self.records.columns)
        return self._with(after), got.select("id", "status")

    def anchor(self, fresh: DataFrame, replace: bool = False) -> Engine:
        """After anchors (id, file, sha, repo) were added to active records, or put in place of theirs."""
        got = stored(writes.anchor_merge(self.records, fresh, replace)).withColumnRenamed("anchors", "_anchors")
        return self._with(self.records.join(got, "id", "left").withColumn("anchors", F.coalesce("_anchors", "anchors")).select(self.records.columns))

    def save_changes(self, root: str, before: Engine) -> DataFrame:
        """(path, outcome) of the files under ``root`` that differ from those of ``before``."""
        text = lambda e: markdown.serialize(e.records.withColumn("file_path", R.target_path(e.settings)))
        old = text(before).select("id", "content").join(before.records.select("id", F.col("file_path").alias("was")), "id").withColumnRenamed("content", "said")
        each = text(self).join(old, "id", "left").where(F.col("said").isNull() | (F.col("said") != F.col("content")) | (F.col("path") != F.col("was")))
        return stored(markdown.relocate(stored(each.select("path", "content", "was")), root))

    def save(self, root: str) -> None:
        """Write every record to its place under ``root``."""
        markdown.write_store(self.records.withColumn("file_path", R.target_path(self.settings)), root)
