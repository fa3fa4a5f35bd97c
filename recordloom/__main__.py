"""Command line over stores of Markdown records: ``python -m recordloom STORE COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import secrets
import time
from pathlib import Path

#: Fixed value: the digits of record ids.
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_READS = ("search", "context", "get", "lineage", "export", "status", "conflicts", "decaying", "invalid", "sweepable", "reconcile", "migration")
_LINKS = ("refines", "supports", "depends_on", "conflicts_with")


def new_id() -> str:
    """``ms_`` and 26 digits: 48 bits of time, then 80 of chance, so that ids sort by time."""
    n = (int(time.time() * 1000) << 80) | secrets.randbits(80)
    return "ms_" + "".join(_DIGITS[n >> 5 * k & 31] for k in reversed(range(26)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recordloom", description=__doc__)
    p.add_argument("store", help="stores, comma separated, the first winning; changes go to the first")
    p.add_argument("--now")
    p.add_argument("--config", help="configuration file, else config.yaml of the first store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(
        name: str, *texts: str, flags: tuple[str, ...] = (), numbers: dict[str, int | None] | None = None, options: tuple[str, ...] = (),
    ) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for t in texts:
            c.add_argument(t, **({"nargs": "+"} if t == "files" else {}))
        for o in flags:
            c.add_argument("--" + o.replace("_", "-"), dest=o, action="store_true")
        for o, default in (numbers or {}).items():
            c.add_argument("--" + o.replace("_", "-"), dest=o, type=int, default=default)
        for o in options:
            c.add_argument("--" + o.replace("_", "-"), dest=o)
        return c

    command(
        "search", "query", flags=("expand_edges", "include_superseded"), numbers={"limit": 10, "expand_depth": 1, "full": None},
        options=("type", "as_of", "edge_types", "profile"),
    )
    command("context", numbers={"budget": 2000, "limit": 20}, options=("type",))
    command("get", "id")
    command("lineage", "id")
    command("export", "form", flags=("include_superseded",), options=("types",))
    for name in ("status", "conflicts", "decaying", "invalid", "sweepable", "stores", "init"):
        command(name)
    command("reconcile", options=("repository", "since"))
    command("remember", "type", "title", flags=("pin",), options=("body", "source", "tags", "check_by", "valid_from", "valid_to", *_LINKS[:3]))
    command("observe", "text", options=("ttl", "source"))
    command("supersede", "id", "reason", flags=("override_operator",), options=("body", "title", "merge_from", "source"))
    command("relate", "id", "target", options=("field",))
    command("verify", "id", options=("evidence", "source"))
    command("anchor", "id", "files", flags=("replace",), options=("repository",))
    command("sweep", flags=("dry_run",))
    command("import", "folder")
    command("migrate", flags=("apply",), options=("override",))
    return p


def _listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _changed(e, command: str, a: dict):
    """(engine, what to show or None) after one write command."""
    one = lambda schema, *row: e.spark.createDataFrame([row], schema)
    source = a.get("source") or "agent"
    if command == "remember":
        new = {
            "id": new_id(), "type": a["type"], "title": a["title"], "body": a["body"] or "", "tags": _listed(a["tags"]), "source": source,
            "source_kind": None,
        }
        more = {
            "pinned": a["pin"] or None, "check_by": a["check_by"], "valid_from": a["valid_from"], "valid_to": a["valid_to"],
        } | {k: _listed(a[k]) or None for k in _LINKS[:3]}
        after, rejected = e.remember(one(
            "id string, type string, title string, body string, tags array<string>, source string, source_kind string", *new.values(),
        ))
        return after.amend(new["id"], more), rejected
    if command == "observe":
        return e.observe(one("id string, text string, ttl string, source string", new_id(), a["text"], a["ttl"], source)), None
    if command == "supersede":
        asked = {"id": a["id"], "reason": a["reason"], "override": a["override_operator"]}
        schema = "id string, reason string, override boolean"
        if a["merge_from"]:
            rows = [(i, a["reason"], a["override_operator"], a["id"]) for i in _listed(a["merge_from"])]
            return e.supersede(e.spark.createDataFrame(rows, schema + ", into string"), "merge"), None
        if a["body"] is None:
            return e.supersede(one(schema, *asked.values()), "retract"), None
        born = new_id()
        after = e.supersede(one(schema + ", new_id string, body string, source string", *asked.values(), born, a["body"], source), "replace")
        return after.amend(born, {"title": a["title"]}), None
    if command == "relate":
        return e.relate(one("id string, target string", a["id"], a["target"]), a["field"] or "refines"), None
    if command == "verify":
        return e.verify(one("id string, evidence string, source string", a["id"], a["evidence"], source))
    if command == "anchor":
        from recordloom.sources import repositories

        files = repositories.hashes(a["repository"] or ".", a["files"])
        return e.anchor(
            e.spark.createDataFrame([(a["id"], f, sha, None) for f, sha in files], "id string, file string, sha string, repo string"),
            a["replace"],
        ), None
    if command == "import":
        return e.take_in(a["folder"])
    return e.sweep(), None


def _answer(e, command: str, a: dict, stores: list[str]):
    """The rows a command shows; write commands change the first store and show what became of its files."""
    from recordloom.operators import migrate
    from recordloom.sources import layers, repositories

    if command == "get":
        return e.get(a["id"])
    if command == "search" and a["edge_types"]:
        a["edge_types"] = tuple(_listed(a["edge_types"]))
    if command == "export":
        a["types"] = tuple(_listed(a["types"])) or None
    if command == "reconcile":
        where = a["repository"] or "."
        return e.at(repositories.files(e.spark, where, e.anchored())).reconcile(repositories.renames(e.spark, where, a["since"]))
    if command == "stores":
        known = e.spark.createDataFrame([(str(k), s, -k, k == 0) for k, s in enumerate(stores)], "name string, path string, priority int, writable boolean")
        return layers.listing(e.records, known)
    if command == "migrate":
        pairs = dict(x.split("=", 1) for x in _listed(a["override"]))
        return migrate.apply(e.spark, stores[0], e.now, e.settings, pairs) if a["apply"] else e.migration(pairs).select("id", "changes", "target_path")
    if command in _READS:
        return getattr(e, command)(**{k: v for k, v in a.items() if v is not None})
    if command == "sweep" and a["dry_run"]:
        return e.sweepable()
    after, shown = _changed(e, command, a)
    files = after.save_changes(stores[0], e)
    return files if shown is None else files.select("path", "outcome").unionByName(shown.select(
        "id", *[c for c in ("reason", "status") if c in shown.columns],
    ).toDF("path", "outcome"))


def init(root: str) -> None:
    """The folders of an empty store; what is there stays."""
    for area in ("memory/facts", "memory/decisions", "memory/procedures", "memory/operator", "observations", "archive"):
        Path(root, area).mkdir(parents=True, exist_ok=True)


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    stores, now, command, config = a.pop("store").split(","), a.pop("now"), a.pop("command"), a.pop("config")
    if command == "init":
        init(stores[0])
        return 0

    from recordloom.engine import Engine
    from recordloom.runtime import local_session
    from recordloom.sources.config import Config

    said = Path(config) if config else Path(stores[0], "config.yaml")
    engine = Engine.from_store(local_session(), *stores, now=now, config=Config.read(said.read_text() if said.exists() else None))
    # Rows stream to the output one partition at a time.
    for row in _answer(engine, command, a, stores).toLocalIterator():
        print(row.value if command == "export" else json.dumps(row.asDict(True), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
