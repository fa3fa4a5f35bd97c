"""Headers whose shape drifts from file to file: one consistent table and a list of every change.

Columns of each file are profiled by type, columns that go and columns that come between two versions
are matched one to one by how far their values agree, beyond chance, over records that hold both, with
name similarity as the tie break, and matched columns become one column under its canonical name.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.runtime import canonical_id, stored, trimmed

#: Records compared per pair of columns that may be one; up to so many shared records all are compared.
SKETCH_RECORDS = 1000
#: Share of the compared records whose values must agree.
AGREEMENT = 0.8
#: Share by which the agreement must exceed that of unrelated columns, of what is possible.
BEYOND_CHANCE = 0.6
#: Values that nearly always agree by chance are constants; names at least this similar still tell.
CONSTANT, SAME_NAME = 0.95, 0.5
#: Records that must show it: for any rename with another name, and for a constant without other proof.
LEAST_SHARED, LEAST_CONSTANT = 2, 5
#: Factors between two ways to write one number (a share and a percentage).
SCALES = (Decimal(1), Decimal(100), Decimal("0.01"))
#: Largest share that name similarity can add to a match.
NAME_WEIGHT = 0.05

_ISO = re.compile(r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d)?)(?:[.,]\d+)?(?:Z|[+-]00:?00)?)?$")
_NUMBER = re.compile(r"^-?\d+(\.\d+)?$")


def _number(x: Decimal) -> str:
    return f"n{x.normalize() + 0:f}"


def leaves(value) -> list[str]:
    """Scalars of a JSON value in one spelling per meaning, whatever holds them.

    Times become seconds, numbers lose trailing zeros (0.7 and "0.70" agree), joined lists become their
    items; keys count only where they look like data (paths).
    """
    if value is None:
        return []
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in (leaves(k) if re.search(r"[/.@]", k) else []) + leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, bool):
        return [str(value).lower()]
    text = value.strip() if isinstance(value, str) else repr(value)
    if m := _ISO.match(text):
        at = pd.Timestamp(f"{m[1]}T{m[2] or '00:00'}")
        return [f"t{int(at.timestamp())}"]
    if _NUMBER.match(text):
        if re.fullmatch(r"\d{10}(\d{3}|\d{6})?", text):
            return [f"t{int(text[:10])}"]
        return [_number(Decimal(text))]
    if re.search(r"[;@]", text):
        return [x for part in re.split(r"[;@,\s]+", text) if part for x in leaves(part)]
    return [text.lower()]


def same_value(a: list[str], b: list[str]) -> bool:
    """One side's scalars are all among the other's; a wrapper may add as many of its own."""
    x, y = set(a), set(b)
    return bool(x) and bool(y) and (x <= y or y <= x) and max(len(x), len(y)) <= 2 * min(len(x), len(y))


class Evidence(NamedTuple):
    """How two columns agree over their shared records."""

    share: float = 0.0
    #: The share that columns with these values would have without any relation.
    chance: float = 1.0
    records: int = 0
    #: What the agreement rests on: ``words`` (or times), ``numbers`` (or codes), ``flags``.
    rests_on: str = "flags"


Pairs = list[tuple[list[str], list[str]]]


def evidence(pairs: Pairs) -> Evidence:
    """The best of: equal values, numbers under one factor, words under a one-to-one code."""
    found = [_direct(pairs, k) for k in SCALES] + [recoding(pairs)]
    return max(found, key=lambda e: (e.share, -e.chance))


def agreement(pairs: Pairs) -> float:
    """Share of records whose two values mean the same, directly, to scale or under a recoding."""
    return evidence(pairs).share


def _direct(pairs: Pairs, scale: Decimal) -> Evidence:
    if scale != 1:
        if not all(x.startswith("n") and _NUMBER.match(x[1:]) for a, _ in pairs for x in a):
            return Evidence()
        pairs = [([_number(Decimal(x[1:]) * scale) for x in a], b) for a, b in pairs]
    if not pairs:
        return Evidence()
    n = len(pairs)
    left, right = (Counter(tuple(sorted(set(p[side]))) for p in pairs) for side in (0, 1))
    chance = sum(k * right[v] for v, k in left.items()) / n**2
    kinds = {"flags" if x in ("true", "false") else "numbers" if re.match(r"^n-?[\d.]+$", x) or len(x) < 3 else "words" for a, _ in pairs for x in a}
    rests_on = next((k for k in ("words", "numbers") if k in kinds), "flags")
    return Evidence(sum(same_value(a, b) for a, b in pairs) / n, chance, n, rests_on)


def recoding(pairs: Pairs) -> Evidence:
    """The best word <-> small number code; no evidence where the values are no code."""
    word = lambda v: len(v) == 1 and not re.match(r"^[nt]-?\d", v[0]) and v[0] not in ("true", "false")
    code = lambda v: len(v) == 1 and re.match(r"^n\d$", v[0])
    if not pairs or not all(word(a) and code(b) or code(a) and word(b) for a, b in pairs):
        return Evidence()
    seen = Counter((a[0], b[0]) for a, b in pairs)
    left, right = (Counter(p[side][0] for p in pairs) for side in (0, 1))
    if len(left) != len(right):
        return Evidence()
    n, best, chance, used_a, used_b = len(pairs), 0, 0, set(), set()
    for (a, b), k in seen.most_common():
        if a not in used_a and b not in used_b:
            best, chance, used_a, used_b = best + k, chance + left[a] * right[b], used_a | {a}, used_b | {b}
    return Evidence(best / n, chance / n**2, n, "numbers")


def believable(e: Evidence, name: float, alone: bool) -> bool:
    """Whether the evidence makes two columns one.

    Constants agree by chance: there a similar name decides, or that the constant is a word or a time;
    a constant number or code counts where no other column of the step could be meant, a flag never.
    """
    if e.share < AGREEMENT or (e.records < LEAST_SHARED and name < SAME_NAME):
        return False
    if e.chance <= CONSTANT:
        return (e.share - e.chance) / (1 - e.chance) >= BEYOND_CHANCE
    if name >= SAME_NAME:
        return True
    return e.records >= LEAST_CONSTANT and (e.rests_on == "words" or (e.rests_on == "numbers" and alone))


def name_similarity(a: str, b: str) -> float:
    bare = lambda n: re.sub(r"[^a-z0-9]", "", n.lower().removeprefix("ext."))
    return SequenceMatcher(None, bare(a), bare(b)).ratio()


def assignment(gain: list[list[float]]) -> list[tuple[int, int]]:
    """Matching of rows to columns with the largest total gain (Hungarian method, potentials).

    Pairs without gain stay unmatched.
    """
    n, m = len(gain), len(gain[0]) if gain else 0
    if not n or not m:
        return []
    size = max(n, m)
    cost = [[-(gain[i][j] if i < n and j < m else 0.0) for j in range(size)] for i in range(size)]
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        owner[0], at = i, 0
        slack, came, done = [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while owner[at]:
            done[at], step, to = True, float("inf"), 0
            for j in range(1, size + 1):
                if not done[j]:
                    c = cost[owner[at] - 1][j - 1] - u[owner[at]] - v[j]
                    if c < slack[j]:
                        slack[j], came[j] = c, at
                    if slack[j] < step:
                        step, to = slack[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    slack[j] -= step
            at = to
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, size + 1) if owner[j] <= n and j <= m and gain[owner[j] - 1][j - 1] > 0)


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """Renames of one step from the values that the columns that go and come have in shared records."""
    read: dict[str, list[str]] = {}
    pairs_of: dict[tuple[str, str], list[tuple[list[str], list[str]]]] = {}
    for a, b, x, y in pdf[["old_name", "new_name", "old_value", "new_value"]].itertuples(index=False):
        for v in (x, y):
            if v not in read:
                read[v] = leaves(json.loads(v))
        pairs_of.setdefault((a, b), []).append((read[x], read[y]))
    old, new = sorted({a for a, _ in pairs_of}), sorted({b for _, b in pairs_of})
    facts = {key: evidence(pairs) for key, pairs in pairs_of.items()}
    agree = [key for key, e in facts.items() if e.share >= AGREEMENT]
    gain = []
    for a in old:
        row = []
        for b in new:
            e, name = facts.get((a, b), Evidence()), name_similarity(a, b)
            alone = sum(x == a or y == b for x, y in agree) == 1
            row.append(e.share + NAME_WEIGHT * name if believable(e, name, alone) else 0.0)
        gain.append(row)
    pairs = assignment(gain)
    keep = {c: [pdf[c].iloc[0]] * len(pairs) for c in ("stream", "file_seq")}
    return pd.DataFrame(keep | {"old_name": [old[i] for i, _ in pairs], "new_name": [new[j] for _, j in pairs]}, dtype=object)


def _kind(value: Column) -> Column:
    """The type of a JSON value as the change list names it."""
    s = F.schema_of_variant(value)
    return (
        F.when(s == "STRING", "string").when(s == "BIGINT", "whole").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "decimal")
        .when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY<OBJECT"), "array of objects")
        .when(s == "ARRAY<VOID>", "array").when(s.startswith("ARRAY"), "array of strings")
    )


def header_fields(lines: DataFrame) -> DataFrame:
    """(stream, file_seq, id, field, kind, value): the non-null fields of every readable line.

    ``lines``: stream, file_seq, raw. Lines that are no JSON object are left out, repeated deliveries
    count once; NULL stream or file_seq belongs to no file. Keys inside ``ext`` appear as ``ext.key``;
    an ``ext`` that is no object is a field of its own. A record listed twice in a file keeps both lines.
    """
    once = lines.where(F.col("stream").isNotNull() & F.col("file_seq").isNotNull()).select("stream", "file_seq", "raw").distinct()
    v = F.try_parse_json("raw")
    read = once.where(trimmed(F.col("raw")).endswith("}")).select("stream", "file_seq", v.alias("doc"))
    read = read.where(F.schema_of_variant("doc").startswith("OBJECT"))
    read = read.withColumn("id", canonical_id(F.try_variant_get("doc", "$.id", "string")))
    top = read.lateralJoin(read.sparkSession.tvf.variant_explode(F.col("doc").outer())).select(
        "stream", "file_seq", "id", F.col("key").alias("field"), F.col("value").alias("v"),
    )
    nested = (F.col("field") == "ext") & F.schema_of_variant("v").startswith("OBJECT")
    inner = top.where(nested).select("stream", "file_seq", "id", "v")
    inner = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "stream", "file_seq", "id", F.concat(F.lit("ext."), "key").alias("field"), F.col("value").alias("v"),
    )
    every = top.where(~nested).unionByName(inner)
    return every.select("stream", "file_seq", "id", "field", _kind(F.col("v")).alias("kind"), F.to_json("v").alias("value")).where(F.col("kind").isNotNull())


def steps(lines: DataFrame) -> DataFrame:
    """(stream, file_seq, before): each file with the one before it in its stream."""
    files = lines.select("stream", "file_seq").where(F.col("stream").isNotNull() & F.col("file_seq").isNotNull()).distinct()
    return files.withColumn("before", F.lag("file_seq").over(Window.partitionBy("stream").orderBy("file_seq"))).where(F.col("before").isNotNull())


def drift(lines: DataFrame, sketch_records: int = SKETCH_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(changes, fields): every change of shape, and the field rows it was read from.

    changes: stream, file_seq, change, old_name, new_name. Empty input gives no changes; a file without
    readable lines has no fields, so all fields of the file before it are removed.
    """
    fields = stored(header_fields(lines))
    step = stored(steps(lines))
    shape = stored(fields.groupBy("stream", "file_seq", "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds")))
    was = step.join(shape.withColumnRenamed("file_seq", "before"), ["stream", "before"]).select(
        "stream", "file_seq", "before", "field", F.col("kinds").alias("old_kinds"),
    )
    now = step.join(shape, ["stream", "file_seq"]).select("stream", "file_seq", F.col("before").alias("b"), "field", F.col("kinds").alias("new_kinds"))
    both = stored(was.join(now, ["stream", "file_seq", "field"], "full").withColumn("before", F.coalesce("before", "b")).drop("b"))
    gone, come = both.where(F.col("new_kinds").isNull()), both.where(F.col("old_kinds").isNull())

    # Evidence: up to ``sketch_records`` of the records that hold both the field that goes and the one
    # that comes, those of smallest hash, so that sparse fields and few shared records count in full.
    gone_names, come_names = (part.select("stream", "file_seq", F.col("before"), F.col("field").alias(name)) for part, name in ((gone, "old_name"), (come, "new_name")))
    open_ = gone_names.select("stream", "file_seq").distinct().join(come_names.select("stream", "file_seq").distinct(), ["stream", "file_seq"])
    side = lambda names, name, at, value: (
        names.join(open_, ["stream", "file_seq"]).select("stream", F.col("file_seq").alias("step"), F.col(at).alias("file_seq"), F.col(name).alias("field"))
        .join(fields, ["stream", "file_seq", "field"]).where(F.col("id").isNotNull())
        .groupBy("stream", F.col("step").alias("file_seq"), "id", F.col("field").alias(name)).agg(F.min("value").alias(value))
    )
    shared = side(gone_names, "old_name", "before", "old_value").join(side(come_names, "new_name", "file_seq", "new_value"), ["stream", "file_seq", "id"])
    nearest = Window.partitionBy("stream", "file_seq", "old_name", "new_name").orderBy(F.xxhash64("id"), "id")
    sketches = shared.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= sketch_records).drop("_n", "id")
    renames = stored(sketches.groupBy("stream", "file_seq").applyInPandas(_match, "stream string, file_seq int, old_name string, new_name string"))

    key = ["stream", "file_seq"]
    blank = F.lit("")
    a = gone.withColumnRenamed("field", "old_name").join(renames, [*key, "old_name"], "left")
    b = come.withColumnRenamed("field", "new_name").join(renames, [*key, "new_name"], "left")
    kinds = renames.join(
        gone.select(*key, F.col("field").alias("old_name"), "old_kinds"), [*key, "old_name"],
    ).join(come.select(*key, F.col("field").alias("new_name"), "new_kinds"), [*key, "new_name"])
    stay = both.where(F.col("old_kinds").isNotNull() & F.col("new_kinds").isNotNull()).select(
        *key, F.col("field").alias("old_name"), F.col("field").alias("new_name"), "old_kinds", "new_kinds",
    )
    row = lambda d, change, old, new: d.select(*key, F.lit(change).alias("change"), old.alias("old_name"), new.alias("new_name"))
    changes = (
        row(renames, "renamed", F.col("old_name"), F.col("new_name"))
        .unionByName(row(a.where(F.col("new_name").isNull()), "removed", F.col("old_name"), blank))
        .unionByName(row(b.where(F.col("old_name").isNull()), "added", blank, F.col("new_name")))
        .unionByName(row(
            kinds.select(*stay.columns).unionByName(stay).where(F.col("old_kinds") != F.col("new_kinds")), "retyped", F.col("old_name"),
            F.col("new_name"),
        ))
    )
    return changes, fields


def canonical_names(changes: DataFrame) -> DataFrame:
    """(field, canonical): names linked by renames anywhere are one column, named by the shortest,
    of equally short ones the first in spelling order, lower case before capitals.

    The graph has one node per distinct field name - a schema, not data - and is closed by label
    propagation until no name changes.
    """
    edges = changes.where(F.col("change") == "renamed").select(F.col("old_name").alias("a"), F.col("new_name").alias("b")).distinct()
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # Swapped case turns spelling order round for capitals.
    rank = lambda c: F.struct(
        F.length(c).alias("n"),
        F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz").alias("swapped"),
        c.alias("name"),
    )
    label = stored(edges.select("a").distinct().select(F.col("a").alias("field"), rank(F.col("a")).alias("label")))
    while True:
        heard = edges.join(label.select(F.col("field").alias("b"), "label"), "b").groupBy(F.col("a").alias("field")).agg(F.min("label").alias("heard"))
        after = stored(label.join(heard, "field", "left").select("field", F.least("label", F.coalesce("heard", "label")).alias("new"), "label"))
        if after.where(F.col("new") < F.col("label")).isEmpty():
            return after.select("field", F.col("label.name").alias("canonical"))
        label = after.select("field", F.col("new").alias("label"))


def unify(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """(stream, file_seq, id, header): one map per record and file from canonical name to JSON value."""
    named = fields.join(canonical_names(changes), "field", "left").withColumn("canonical", F.coalesce("canonical", "field"))
    one = named.groupBy("stream", "file_seq", "id", "canonical").agg(F.min("value").alias("value"))
    return one.groupBy("stream", "file_seq", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("canonical", "value")))).alias("header"))
