"""Mixed timestamp spellings, precisions and zones to one UTC instant or the reason there is none.

Every value yields an array of all its interpretations: each day/month order of a date with slashes, each
unit of a count, both instants of a wall-clock hour that occurs twice. What is known about the writer
(date order, years, whether such an hour may be guessed) is a cost of an interpretation. Viterbi picks
the series of readings of a source, in record order, of least cost with format switches and backward
jumps in time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.runtime import stored, trimmed

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# English month names by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Rows of one Viterbi chunk.
CHUNK_ROWS = 50_000
SWITCH_COST, BACKWARD_COST = 1.0, 1.5
#: Cost of a reading that what is known rules out: more than the four penalties its neighbours can save.
#: Where only such readings are left, giving none costs less than any of them.
RULED_OUT, NO_READING = 10.0, 5.0

_CLOCK = r"^(?:[Tt]|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s*([AaPp])[Mm])?(?:\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?))?(?:\[[^\]]*\])?$"
_DATES = {
    # name: (pattern of the date, groups of year, month, day)
    "iso": (r"^(\d{4})-(\d{2})-(\d{2})(?=[Tt\s]|$)", (1, 2, 3)),
    "day_name": (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})(?=\s|$)", (3, 2, 1)),
    "name_day": (r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?=[\s,]|$)", (3, 1, 2)),
    "dots": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?=\s|$)", (3, 2, 1)),
    "dmy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=\s|$)", (3, 2, 1)),
    "mdy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?=\s|$)", (3, 1, 2)),
}
_DAY = 86_400_000_000


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _int(c: Column) -> Column:
    return F.when(c != "", c.try_cast("long"))


def _date(value: Column, name: str) -> Column:
    """Micros of the day's start, NULL where the pattern or the calendar does not fit."""
    pattern, (y, m, d) = _DATES[name]
    part = lambda k: F.regexp_extract(value, pattern, k)
    month = F.element_at(
        _map({k: f"{i:02d}" for k, i in MONTHS.items()}), F.lower(F.substring(part(m), 1, 3)),
    ) if name in ("day_name", "name_day") else F.lpad(part(m), 2, "0")
    text = F.concat_ws("-", part(y), month, F.lpad(part(d), 2, "0"))
    return F.when(value.rlike(pattern) & month.isNotNull(), F.unix_date(F.try_to_date(text, "yyyy-MM-dd")) * F.lit(_DAY))


def with_readings(rows: DataFrame, first_year: int, last_year: int, guess_folds: bool = False) -> DataFrame:
    """Add ``readings``: array<struct<fmt, at, utc, reason, cost>> of all interpretations of ``text``.

    ``rows`` has ``text`` (trimmed), ``zone_name`` and ``date_order``. The work goes in steps of plain
    columns, so that no expression is spelled out twice in the plan.
    """
    keep = rows.columns
    # Basic form is written out first, so that one clock pattern serves all.
    v = F.regexp_replace("text", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    df = rows.withColumn("_v", F.regexp_replace(v, r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?=$|[Zz+-])", "$1-$2-$3T$4:$5"))
    either = "|".join(f"(?:{p})" for p in dict.fromkeys(p for p, _ in _DATES.values()))
    df = df.withColumn("_rest", F.regexp_replace("_v", either, ""))
    df = df.withColumns({f"_c{k}": F.regexp_extract("_rest", _CLOCK, k) for k in range(1, 7)})
    n = F.when(F.col("text").rlike(r"^\d{1,18}$"), F.col("text").try_cast("long"))
    df = df.withColumns({"_n": n, "_h": _int(F.col("_c1")), "_half": F.lower("_c5"), "_said": F.upper("_c6")})
    df = df.withColumns({f"_{k}": _date(F.col("_v"), k) for k in _DATES})

    hour = F.when(F.col("_half") == "", F.when(F.col("_h") < 24, F.col("_h"))).when(
        F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0),
    )
    micros = F.coalesce(_int(F.rpad(F.substring("_c4", 1, 6), 6, "0")), F.lit(0))
    minute, second = _int(F.col("_c2")), F.coalesce(_int(F.col("_c3")), F.lit(0))
    of_day = F.when(F.col("_rest") == "", F.lit(0).cast("long")).when((minute < 60) & (second < 60), ((hour * 60 + minute) * 60 + second) * 1_000_000 + micros)
    said = F.col("_said")
    signed = F.when(said.startswith("-"), -1).otherwise(1) * (_int(F.substring(said, 2, 2)) * 60 + F.coalesce(
        _int(F.regexp_extract(said, r"^.\d\d:?(\d\d)$", 1)), F.lit(0),
    ))
    offset = F.when(said.rlike(r"^[+-]"), signed).otherwise(F.try_element_at(_map(ABBREVIATIONS), said))
    df = df.withColumns({"_day": of_day, "_offset": offset, "_has": said != ""})
    # A zone word that is no zone leaves no interpretation.
    df = df.withColumn("_day", F.when(~(F.col("_has") & F.col("_offset").isNull()), F.col("_day")))

    order, plain, day = F.col("date_order"), ("iso", "day_name", "name_day", "dots"), F.col("_day")
    against = lambda k: F.when(F.coalesce(order != k, F.lit(False)), RULED_OUT).otherwise(0.0)
    named = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k in plain])
    same = F.col("_dmy") == F.col("_mdy")
    df = df.withColumns({
        "_fmt1": F.coalesce(
            named, F.when(same & (order == "mdy"), "mdy").otherwise("dmy"),
        ), "_wall1": F.coalesce(*[F.col(f"_{k}") for k in plain], "_dmy") + day,
        "_cost1": F.when(named.isNotNull() | F.coalesce(same, F.lit(False)), 0.0).otherwise(against("dmy")),
        "_fmt2": F.lit("mdy"), "_wall2": F.when(~F.coalesce(same, F.lit(False)), F.col("_mdy")) + day, "_cost2": against("mdy"),
    })

    shift = lambda u: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(u), F.col("zone_name"))) - u
    for i in (1, 2):
        wall = F.when(~F.col("_has"), F.col(f"_wall{i}"))
        df = df.withColumns({f"_b{i}": wall - shift(wall - _DAY), f"_a{i}": wall - shift(wall + _DAY)})
        df = df.withColumns({f"_{x}ok{i}": F.col(f"_{x}{i}") + shift(F.col(f"_{x}{i}")) == F.col(f"_wall{i}") for x in "ab"})

    reading = lambda fmt, at, utc, reason, cost: F.struct(
        fmt.alias("fmt"), at.alias("at"), utc.alias("utc"), reason.alias("reason"), cost.cast("double").alias("cost"),
    )
    none = F.lit(None).cast("string")
    low, high = (int((pd.Timestamp(f"{y}-01-01") - pd.Timestamp(0)).total_seconds()) * 1_000_000 for y in (first_year, last_year + 1))
    out = []
    for unit, size in {"seconds": 1_000_000, "millis": 1000, "micros": 1}.items():
        at = F.try_multiply(F.col("_n"), F.lit(size).cast("long"))
        out.append(F.when(at.isNotNull(), reading(F.lit(unit), at, at, none, F.when((at >= low) & (at < high), 0.0).otherwise(RULED_OUT))))
    for i in (1, 2):
        fmt, wall, cost, b, a, bok, aok = (F.col(f"_{x}{i}") for x in ("fmt", "wall", "cost", "b", "a", "bok", "aok"))
        fold = ~F.col("_has") & bok & aok & (a != b)
        utc = F.when(F.col("_has"), wall - F.col("_offset") * 60_000_000).when(bok & (~aok | (a == b)), b).when(aok & ~bok, a)
        reason = F.when(~F.col("_has") & F.col("zone_name").isNull(), "no_zone").when(fold, "ambiguous").when(~F.col("_has") & ~bok & ~aok, "nonexistent")
        said_so, guessed = (NO_READING, 0.0) if guess_folds else (0.0, RULED_OUT)
        out.append(F.when(wall.isNotNull(), reading(fmt, F.coalesce(utc, b, wall), utc, reason, cost + F.when(fold, said_so).otherwise(0.0))))
        out += [F.when(wall.isNotNull() & fold, reading(fmt, x, x, none, cost + guessed)) for x in (b, a)]
    df = df.withColumn("_all", F.array_compact(F.array(*out)))
    nothing = reading(none, F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit("unreadable"), F.lit(NO_READING))
    least = F.array_min(F.transform("_all", lambda r: r["cost"]))
    return df.select(*keep, F.when(least >= RULED_OUT, F.array_append("_all", nothing)).otherwise(F.col("_all")).alias("readings"))


def _cost(a, b) -> float:
    """From reading ``a`` to the next record's reading ``b``; giving no reading has no neighbours."""
    if a["at"] is None or b["at"] is None:
        return 0.0
    return SWITCH_COST * (a["fmt"] != b["fmt"]) + BACKWARD_COST * (b["at"] < a["at"])


def _best(rows: list, start: list[float]) -> tuple[list[float], list[list[int]]]:
    """Least cost to each reading of the last row, and the back pointers; ``start`` has the first row's costs."""
    cost, back = start, []
    for prev, now in zip(rows, rows[1:], strict=False):
        ways = [[c + _cost(a, b) for c, a in zip(cost, prev, strict=True)] for b in now]
        back.append([min(range(len(w)), key=w.__getitem__) for w in ways])
        cost = [min(w) + b["cost"] for w, b in zip(ways, now, strict=True)]
    return cost, back


def _only(n: int, k: int) -> list[float]:
    return [0.0 if i == k else math.inf for i in range(n)]


def _certain(series: list) -> list[int]:
    """Places of values with one reading: what lies between two of them is decided on its own."""
    return [i for i, r in enumerate(series) if len(r) == 1]


_KEYS = ["source", "field"]


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per series within a chunk: its first and last readings and the least cost between them.

    Costs are up to a constant of the series and chunk.
    """
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    for (part, source, field), g in pd.concat(rows).groupby(["part", *_KEYS], dropna=False, sort=False):
        series = g.sort_values(["at", "row_id"])["readings"].tolist()
        sure, n = _certain(series), len(series[0])
        if sure:
            before = [_best(series[: sure[0] + 1], _only(n, k))[0][0] for k in range(n)]
            after = _best(series[sure[-1] :], [0.0])[0]
            costs = [x + y for x in before for y in after]
        else:
            costs = [c for k in range(n) for c in _best(series, _only(n, k))[0]]
        yield pd.DataFrame({"part": [part], "source": [source], "field": [field], "first": [list(series[0])], "last": [list(series[-1])], "costs": [costs]})


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """The readings at which the cheapest path of a whole series enters and leaves each chunk."""
    pdf = pdf.sort_values("part").reset_index(drop=True)
    cost: list[float] = []
    trail = []
    for i, c in enumerate(pdf.itertuples()):
        n, m = len(c.first), len(c.last)
        enter = [b["cost"] for b in c.first] if not i else [min(x + _cost(a, b) for x, a in zip(cost, pdf["last"][i - 1], strict=True)) + b["cost"] for b in c.first]
        come = [0] * n if not i else [min(range(len(cost)), key=lambda k, b=b, i=i, cost=cost: cost[k] + _cost(pdf["last"][i - 1][k], b)) for b in c.first]
        ways = [[enter[a] + c.costs[a * m + z] for a in range(n)] for z in range(m)]
        pick = [min(range(n), key=w.__getitem__) for w in ways]
        trail.append((come, pick))
        cost = [min(w) for w in ways]
    z, out = min(range(len(cost)), key=cost.__getitem__), []
    for come, pick in reversed(trail):
        a = pick[z]
        out.append((a, z))
        z = come[a]
    pdf["enter"], pdf["leave"] = zip(*reversed(out), strict=True)
    return pdf[["part", "source", "field", "enter", "leave"]]


def _walk(series: list, enter: int, leave: int) -> list[int]:
    """The choices of the cheapest way between two given readings of the first and the last row."""
    _, back = _best(series, _only(len(series[0]), enter))
    out = [leave]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


def _decode(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """Choose a reading for every row of a chunk, given where the path enters and leaves it."""
    at = {(s, f): (a, z) for s, f, a, z in ends[["source", "field", "enter", "leave"]].itertuples(index=False)}
    out = []
    for (source, field), g in pdf.groupby(_KEYS, dropna=False, sort=False):
        g = g.sort_values(["at", "row_id"])
        series = g["readings"].tolist()
        a, z = (int(x) for x in at[source if isinstance(source, str) else None, field])
        cuts = [(0, a), *((i, 0) for i in _certain(series)), (len(series) - 1, z)]
        chosen = [0] * len(series)
        for (i, enter), (j, leave) in zip(cuts, cuts[1:], strict=False):
            if j > i + 1 or enter or leave:
                chosen[i : j + 1] = _walk(series[i : j + 1], enter, leave)
        out.append(pd.DataFrame({"row_id": g["row_id"].tolist(), "field": field, "choice": chosen}))
    return pd.concat(out) if out else pd.DataFrame({"row_id": [], "field": [], "choice": []})


def choose(read: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(row_id, field, choice) of each value of a series that holds an uncertain one.

    ``read``: row_id, source, field, at, readings. A series may hold any share of the rows: it is cut
    into chunks by ranges of its order, each chunk is summarised by a small matrix of least costs,
    the matrices of a series are chained, and each chunk is decoded between its fixed ends.
    """
    uncertain = read.where(F.size("readings") > 1).select(*_KEYS).distinct()
    key = lambda d: d.withColumn("series", F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("field")))
    rows = stored(key(read.where(F.size("readings") > 0)).join(key(uncertain).select("series"), "series", "left_semi").drop("series"))
    cut = stored(rows.repartitionByRange(
        max(1, math.ceil(rows.count() / chunk_rows)), "source", "field", "at", "row_id",
    ).withColumn("part", F.spark_partition_id()))
    kind = cut.schema["readings"].dataType.simpleString()
    sums = cut.groupBy("part").applyInPandas(
        lambda pdf: pd.concat([*_summaries(iter([pdf]))]) if len(pdf) else pdf, f"part int, source string, field string, first {kind}, last {kind}, costs array<double>"
    )
    ends = key(sums).groupBy("series").applyInPandas(lambda pdf: _stitch(pdf), "part int, source string, field string, enter int, leave int")
    ends = stored(ends).select(F.col("part").alias("to"), "source", "field", "enter", "leave")
    return cut.groupBy("part").cogroup(ends.groupBy("to")).applyInPandas(_decode, "row_id string, field string, choice int")


def normalise(
    values: DataFrame, writers: DataFrame, first_year: int = 2023, last_year: int = 2027, chunk_rows: int = CHUNK_ROWS,
    guess_folds: bool = False,
) -> DataFrame:
    """(row_id, field, utc_micros, reason) of each non-NULL value.

    ``values``: row_id string, source, field, at (record order), value. ``writers``: source, zone_name,
    date_order (unique per source; small and fixed, its size left to the planner). ``reason`` is NULL
    with an instant, else ``unreadable``, ``no_zone``, ``ambiguous`` or ``nonexistent``. Blank text is
    unreadable; a NULL or unknown source has no zone; equal (row_id, field) rows count once. With
    ``guess_folds`` an hour that occurs twice gets the instant that fits the source's order best.
    """
    known = writers.select("source", "zone_name", "date_order").dropDuplicates(["source"])
    read = values.select("row_id", "source", "field", "at", "value").where(F.col("value").isNotNull()).dropDuplicates(["row_id", "field"]).join(known, "source", "left")
    read = read.withColumn("text", F.coalesce(trimmed(F.col("value")), F.lit("")))
    read = stored(with_readings(read, first_year, last_year, guess_folds).select("row_id", "source", "field", "at", "readings"))
    chosen = read.join(choose(read, chunk_rows), ["row_id", "field"], "left")
    one = F.try_element_at("readings", F.coalesce("choice", F.lit(0)) + 1)
    return chosen.select("row_id", "field", one["utc"].alias("utc_micros"), F.when(one.isNull(), "unreadable").otherwise(one["reason"]).alias("reason"))


def utc_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``, whatever the session's zone."""
    day = F.floor(micros / F.lit(_DAY)).cast("int")
    left = F.pmod(micros, F.lit(_DAY))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    seconds = F.floor(left / 1_000_000)
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"),
        two(seconds % 60), F.lit("."), F.lpad((left % 1_000_000).cast("string"), 6, "0"), F.lit("Z"),
    )
