"""Records as Markdown files with a YAML header: scanning, parsing and writing them."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of older headers, old states and what they are now.
LEGACY = "decay_after string, confidence double, corrects array<string>, corrected_by string, correction_reason string, code_anchors array<struct<file:string,sha:string,repo:string>>"
OLD_STATES = {"captured": "active", "corrected": "superseded", "decayed": "retired", "archived": "retired"}

HEADER = (
    "id string, kind string, type string, state string, created string, source string, source_kind string, tags array<string>, check_by string, stale boolean, pinned boolean, "
    "last_verified string, verified_with string, anchors array<struct<file:string,sha:string,repo:string>>, supersedes array<string>, superseded_by string, supersede_reason string, "
    "conflicts_with array<string>, refines array<string>, supports array<string>, depends_on array<string>, expires string, valid_from string, valid_to string, ext string"
)
NAMES = [c.split(" ")[0] for c in HEADER.split(", ")]
_LISTS = {c.split(" ")[0] for c in HEADER.split(", ") if "array<string>" in c}


# What the fields of a header may say, and its form.
KINDS, TYPES, STATES = ("claim", "observation"), ("fact", "decision", "procedure"), ("active", "superseded", "retired")
SOURCE_KINDS, WITNESSES = ("operator", "agent", "import"), ("anchor", "operator", "evidence", "assertion")
ID_FORM = r"^ms_[A-Z0-9]{26}$"
#: The columns of older headers, read beside today's with ``legacy``.
OLD_NAMES = [f.split(" ")[0] for f in LEGACY.split(", ")]


def _plain(v):
    """Dates and times as ISO text, whatever YAML made of them."""
    from datetime import date, datetime, timezone

    if isinstance(v, datetime):
        return (v.astimezone(timezone.utc) if v.tzinfo else v).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return f"{v.isoformat()}T00:00:00.000Z" if isinstance(v, date) else v


def _value(name: str, v):
    import json

    v = _plain(v)
    if v is None:
        return None
    if name in _LISTS or name == "corrects":
        return [str(x) for x in v if x is not None] if isinstance(v, list) else [str(v)]
    if name in ("anchors", "code_anchors"):
        return [{k: None if a.get(k) is None else str(a[k]) for k in ("file", "sha", "repo")} for a in v if isinstance(a, dict)] if isinstance(v, list) else None
    if name in ("stale", "pinned"):
        return v if isinstance(v, bool) else None
    if name == "confidence":
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if name == "ext":
        return json.dumps(v, sort_keys=True, default=str)
    return str(v)


def modern(head: dict) -> dict:
    """A header in today's shape: an older name gives its value where today's name has none."""
    new = {k: v for k, v in head.items() if k not in OLD_NAMES}
    ext = dict(head["ext"]) if isinstance(head.get("ext"), dict) else None
    corrects = head.get("corrects")
    older = {
        "kind": "claim", "check_by": head.get("decay_after"), "superseded_by": head.get("corrected_by"), "supersede_reason": head.get("correction_reason"),
        "supersedes": [corrects] if corrects is not None and not isinstance(corrects, list) else corrects, "anchors": ext.get("code_anchors") if ext and isinstance(ext.get("code_anchors"), list) else None,
    }
    for name, value in older.items():
        if new.get(name) is None and value is not None:
            new[name] = value
    if isinstance(new.get("state"), str):
        new["state"] = OLD_STATES.get(new["state"], new["state"])
    sure = head.get("confidence")
    if isinstance(sure, (int, float)) and not isinstance(sure, bool):
        ext = {"legacy_confidence": sure} | (ext or {})
    return new if ext is None else new | {"ext": ext}


def problems(head: dict) -> list[str]:
    """What keeps a header of today's shape from being a record's, as ``field: what is wrong``."""
    import re

    def dated(v) -> bool:
        v = _plain(v)
        if not isinstance(v, str) or not re.search(r"\d{4}", v):
            return False
        if re.fullmatch(r"(?:1[7-9]|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])T(?:[01]\d|2[0-3])(?::[0-5]\d){2}(?:\.\d{3})?Z", v, re.A):
            return True
        try:
            return not pd.isna(pd.Timestamp(v))
        except ValueError:
            return False

    get = head.get
    text = lambda v: isinstance(v, str)
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    one_of = lambda values: lambda v: isinstance(v, str) and v in values
    anchor = lambda a: isinstance(a, dict) and text(a.get("file")) and text(a.get("sha")) and (a.get("repo") is None or text(a["repo"]))
    needed = [
        (
            "id", lambda v: text(v) and re.match(ID_FORM, v), "bad form",
        ), ("state", one_of(STATES), "unknown"), ("created", dated, "missing"), ("source", lambda v: text(v) and v != "", "empty"),
        ("check_by", lambda v: v == "never" or dated(v), "no date"),
    ]
    free = [
        ("kind", one_of(KINDS), "unknown"), ("type", one_of(TYPES), "unknown"), ("source_kind", one_of(SOURCE_KINDS), "unknown"), ("verified_with", one_of(WITNESSES), "unknown"),
        *((n, texts, "no list of texts") for n in NAMES if n in _LISTS), *((n, lambda v: isinstance(v, bool), "no flag") for n in ("stale", "pinned")),
        *((n, dated, "no date") for n in ("last_verified", "expires", "valid_from", "valid_to")), *((n, text, "no text") for n in ("superseded_by", "supersede_reason")),
        ("anchors", lambda v: isinstance(v, list) and all(map(anchor, v)), "bad form"), ("ext", lambda v: isinstance(v, dict), "no object"),
    ]
    found = [f"{n}: {what}" for n, good, what in needed if not good(get(n))]
    found += [f"{n}: {what}" for n, good, what in free if get(n) is not None and not good(get(n))]
    if get("kind", "claim") != "observation" and get("type") is None:
        found.append("type: required for claims")
    return found


# A header of plain characters only, and a line of it; anything else is left to YAML.
_CLEAN = r"[\n\x20-\x7e\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]*"
_LINE = r"([a-z_]+): (.+)"


def _header():
    """A reader of header texts. Lines in YAML's JSON form, as ``serialize`` writes them, need no YAML parser."""
    import json
    import re

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    clean, line, names = re.compile(_CLEAN), re.compile(_LINE), {*NAMES, *OLD_NAMES}

    def number(v: str) -> float:
        if "e" in v or "E" in v:
            raise ValueError("YAML takes some of these for texts")
        return float(v)

    def constant(v: str):
        raise ValueError("YAML takes these for texts")

    decode = json.JSONDecoder(parse_float=number, parse_constant=constant).decode

    def read(text: str):
        # YAML has no surrogate pairs, and keys of a limited length.
        if "\\u" not in text and "\\/" not in text and clean.fullmatch(text):
            head = {}
            for said in text.split("\n"):
                m = line.fullmatch(said)
                if not m or m[1] not in names or (len(said) > 1000 and "{" in said):
                    break
                try:
                    head[m[1]] = decode(m[2])
                except ValueError:
                    break
            else:
                return head
        return yaml.load(text, Loader=loader)  # noqa: S506 - a safe loader

    return read


def _arrow(kind: str):
    import pyarrow as pa

    text = pa.string()
    anchors = pa.list_(pa.struct([("file", text), ("sha", text), ("repo", text)]))
    return {"string": text, "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(text)}.get(kind, anchors)


def _parse(legacy: bool, read: bool = False):
    """Rows of files (path, content), or with ``read`` of paths whose files are read here."""
    kinds = [("path", "string"), *(c.split(" ", 1) for c in HEADER.split(", ")), *((c.split(" ", 1) for c in LEGACY.split(", ")) if legacy else ()), *((c, "string") for c in ("title", "body", "error"))]
    names = NAMES + (OLD_NAMES if legacy else [])

    def run(batches):
        import re

        import pyarrow as pa

        schema = pa.schema([(n, _arrow(k)) for n, k in kinds])
        header, heading = _header(), re.compile(r"^#\s+(.+)$", re.M)
        parts = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)\Z", re.S)

        def parsed(path, text):
            row = dict.fromkeys(schema.names) | {"path": path}
            try:
                if read:
                    with open(path.removeprefix("file:"), "rb") as f:
                        text = f.read()
                    text = text.decode("utf-8")
                m = parts.match(text or "")
                head = header(m[1]) if m else None
                if not isinstance(head, dict):
                    raise ValueError("no header")
                now = modern(head)
                row["error"] = "; ".join(problems(now)) or None
                ext = head.get("ext") if isinstance(head.get("ext"), dict) else {}
                said = head | {"code_anchors": ext.get("code_anchors")} if legacy else now
                row |= {k: _value(k, said.get(k)) for k in names}
                row["body"] = m[2].strip()
                found = heading.search(row["body"])
                row["title"] = found[1].strip() if found else ""
            except OSError:
                raise
            except Exception as e:
                row["error"] = f"{type(e).__name__}: {e}"[:200]
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                paths = some.column(0).to_pylist()
                texts = [None] * len(paths) if read else some.column(1).to_pylist()
                yield pa.RecordBatch.from_pylist([parsed(*x) for x in zip(paths, texts, strict=True)], schema=schema)

    return run


def _columns(legacy: bool) -> str:
    return f"path string, {HEADER}{f', {LEGACY}' if legacy else ''}, title string, body string, error string"


def parse_frontmatter(files: DataFrame, legacy: bool = False) -> DataFrame:
    """Header fields, title, body and ``error`` of each file (path, content).

    Older headers are read in today's shape; with ``legacy`` as written, the older columns beside
    today's. ``error`` says what keeps a file from being a record: no readable header, or the fields
    that have not the form they must have. Such a file is kept with what could be read; nothing fails.
    """
    return files.select("path", "content").mapInArrow(_parse(legacy), _columns(legacy))


def describe() -> list[tuple[str, str, bool, str]]:
    """(field, type, needed, values) of a header, in the order fields are written."""
    values = {"kind": KINDS, "type": TYPES, "state": STATES, "source_kind": SOURCE_KINDS, "verified_with": WITNESSES}
    kinds = [c.split(" ", 1) for c in HEADER.split(", ")]
    return [(n, k, n in ("id", "state", "created", "source", "check_by"), "|".join(values.get(n, ()))) for n, k in kinds]


def _listed(root: str):
    """The paths of the Markdown files under ``root``; hidden names are passed over as the file source does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        hidden = lambda n: n.startswith(".") or (n.startswith("_") and "=" not in n) or n.endswith("._COPYING_")
        for _ in batches:
            found: list[str] = []
            folders = [root]
            while folders:
                with os.scandir(folders.pop()) as entries:
                    for e in entries:
                        if hidden(e.name):
                            continue
                        if e.is_dir():
                            folders.append(e.path)
                        elif e.name.endswith(".md") and e.is_file():
                            found.append(f"file:{e.path}")
                            if len(found) == 10_000:
                                yield pd.DataFrame({"path": found})
                                found = []
            yield pd.DataFrame({"path": found}, dtype=object)

    return run


def scan_records(spark: SparkSession, root: str, legacy: bool = False) -> DataFrame:
    """All Markdown files under ``root``, parsed, with their area and tier from the path.

    Rows with an ``error`` are the side output: they are no records. A mounted folder is listed by one
    task and read by all, in parts of equal numbers of files: the file source lists on the driver and
    counts a file as 4 MB at least, so that a few small files are a task. It reads what is not mounted.
    """
    if (folder := Path(root.removeprefix("file://").removeprefix("file:")).absolute()).is_dir():
        sc = spark.sparkContext
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism)
        paths = spark.range(0, 1, 1, 1).mapInPandas(_listed(str(folder)), "path string").repartition(parts, "path")
        rows = paths.mapInArrow(_parse(legacy, read=True), _columns(legacy))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        rows = parse_frontmatter(files.select("path", F.decode("content", "utf-8").alias("content")), legacy)
    return rows.withColumns({
        "area": F.regexp_extract("path", r"/(memory|observations|archive)/", 1), "is_operator": F.col("path").contains("/memory/operator/"),
    })


def recent_files(spark: SparkSession, root: str, since) -> DataFrame:
    """(path, modified) of the files changed since, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return files.select("path", F.col("modificationTime").alias("modified")).where(F.col("modified") >= since).orderBy(F.desc("modified"), "path")


def serialize(records: DataFrame, *keep: Column) -> DataFrame:
    """(id, path, content): each record as Markdown; empty fields are left out, the heading is written once.

    Values are written in YAML's JSON form, which needs no rules of its own for quoting. ``keep`` gives
    further columns of the same rows.
    """
    kinds = dict(records.dtypes)

    def line(name: str):
        c = F.col(name)
        if kinds.get(name, "").startswith("timestamp"):
            c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
        if name == "ext":
            return F.when(F.col(name).isNotNull(), F.concat(F.lit("ext: "), c))
        if name in _LISTS or name == "anchors":
            return F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: "), F.to_json(name)))
        if kinds.get(name) == "boolean":
            return F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string")))
        quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), quoted))

    head = F.array_join(F.array_compact(F.array(*[line(n) for n in NAMES if n in kinds])), "\n")
    body = F.trim(F.coalesce("body", F.lit("")))
    title = F.concat(F.lit("# "), F.coalesce("title", F.lit("")))
    text = F.when(
        body.startswith(F.concat(title, F.lit("\n"))) | (body == title), body,
    ).when(F.coalesce("title", F.lit("")) == "", body).otherwise(F.concat(title, F.lit("\n\n"), body))
    return records.select("id", F.col("file_path").alias("path"), F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), text, F.lit("\n")).alias("content"), *keep)


def write_store(records: DataFrame, root: str) -> None:
    """Write each record to its own file under ``root``; tasks write their rows independently."""
    relocate(serialize(records).select("path", "content", F.lit(None).cast("string").alias("was")), root).agg(F.count(F.lit(1))).first()


def relocate(files: DataFrame, root: str) -> DataFrame:
    """(path, outcome) after each file (path, content, was) was written under ``root`` and left its old place.

    A moved file gets its new name before its text is written and its old name goes last, so that a task
    that fails in between leaves it under both and its repetition ends the move. A move onto a file that
    is already there keeps that one: ``kept``. A NULL content only removes the old file. Texts are written
    over the old ones: to empty files first, or to make new ones while others go, costs file systems much.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        there: set[str] = set()

        def write(target: str, said: bytes) -> None:
            try:
                with open(target, "r+b") as f:
                    f.write(said)
                    f.truncate()
            except FileNotFoundError:
                with open(target, "wb") as f:
                    f.write(said)

        def renamed(old: str, target: str) -> bool:
            """Whether ``target`` names the old file now; one that has names elsewhere stays what it is there."""
            try:
                if os.path.exists(target):
                    return os.path.samefile(old, target)
                if os.path.islink(old) or os.stat(old).st_nlink > 1 or not os.access(old, os.W_OK):
                    return False
                os.link(old, target)
            except OSError:
                return False
            return True

        def move(old: str, target: str, said: bytes) -> str:
            if renamed(old, target):
                write(target, said)
                return "moved"
            try:
                with open(target, "xb") as f:
                    f.write(said)
            except FileExistsError:
                return "kept"
            return "moved"

        for pdf in batches:
            out = []
            for path, content, was in zip(pdf["path"], pdf["content"], pdf["was"], strict=True):
                target, old = os.path.join(root, path), os.path.join(root, was) if isinstance(was, str) and was != path else None
                if not isinstance(content, str):
                    outcome = "removed"
                else:
                    if (folder := os.path.dirname(target)) not in there:
                        os.makedirs(folder, exist_ok=True)
                        there.add(folder)
                    said = content.encode("utf-8")
                    if old is None:
                        write(target, said)
                    outcome = "written" if old is None else move(old, target, said)
                if old is not None:
                    Path(old).unlink(missing_ok=True)
                out.append((path, outcome))
            yield pd.DataFrame(out, columns=["path", "outcome"])

    return files.select("path", "content", "was").mapInPandas(put, "path string, outcome string")
