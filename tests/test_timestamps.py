import random
from datetime import datetime, timedelta

import pytest

from recordloom.operators import timestamps

WRITERS = [
    ("utc", "UTC", "dmy"), ("ny", "America/New_York", "mdy"), ("kath", "Asia/Kathmandu", None), ("lost", None, "dmy"),
    ("london", "Europe/London", "dmy"),
]
CASES = [
    ("utc", "2024-03-05T06:07:08.123456789Z", "2024-03-05T06:07:08.123456Z"),
    ("ny", "2024-03-05 06:07:08,5+05:45", "2024-03-05T00:22:08.500000Z"),
    ("ny", "2024-03-05T06:07:08 -0500", "2024-03-05T11:07:08.000000Z"),
    ("ny", "2024-03-05t06:07:08z", "2024-03-05T06:07:08.000000Z"),
    ("ny", "20240305T060708Z", "2024-03-05T06:07:08.000000Z"),
    ("ny", "2024-07-01 12:00", "2024-07-01T16:00:00.000000Z"),
    ("ny", "2024-03-10 02:30", "nonexistent"),
    ("ny", "2024-11-03 01:30:00", "ambiguous"),
    ("ny", "2024-11-03 01:30:00 EST", "2024-11-03T06:30:00.000000Z"),
    ("ny", "03/04/2024 10:52 PM", "2024-03-05T03:52:00.000000Z"),
    ("london", "03/04/2024 10:52", "2024-04-03T09:52:00.000000Z"),
    ("ny", "31/11/2024 09:15", "unreadable"),
    ("utc", "05.03.2024 06:07:08", "2024-03-05T06:07:08.000000Z"),
    ("kath", "Jan 10, 2024 19:15:44", "2024-01-10T13:30:44.000000Z"),
    ("kath", "Mon, 8 Jan 2024 22:35:05 +1100", "2024-01-08T11:35:05.000000Z"),
    ("utc", "16 January 2024", "2024-01-16T00:00:00.000000Z"),
    ("lost", "2024-03-05 06:07", "no_zone"),
    ("lost", "1711906598", "2024-03-31T17:36:38.000000Z"),
    ("lost", "1711906598976", "2024-03-31T17:36:38.976000Z"),
    ("lost", "1711906598976123", "2024-03-31T17:36:38.976123Z"),
    ("lost", "171190659897612399999", "unreadable"),
    (None, "2024-03-05", "no_zone"),
    ("who", "2024-03-05T00:00:00+00:00[UTC]", "2024-03-05T00:00:00.000000Z"),
    ("utc", "2024-02-30", "unreadable"),
    ("utc", "0000-00-00 00:00:00", "unreadable"),
    ("utc", "2024-03-05 25:00:00", "unreadable"),
    ("utc", "2024-03-05 10:00:00 QQQ", "unreadable"),
    ("utc", "", "unreadable"),
    ("utc", "   ", "unreadable"),
    ("utc", "TODO " * 5000, "unreadable"),
]


@pytest.fixture(scope="module")
def writers(spark):
    return spark.createDataFrame(WRITERS, "source string, zone_name string, date_order string")


def run(spark, writers, rows, **more):
    df = spark.createDataFrame(rows, "row_id string, source string, field string, at timestamp_ntz, value string, zone_name string")
    got = timestamps.normalise(df, writers, **more)
    from pyspark.sql import functions as F

    return {r.row_id: r.out for r in got.select("row_id", F.coalesce(timestamps.utc_text(F.col("utc_micros")), "reason").alias("out")).collect()}


def test_forms_and_reasons(spark, writers):
    at = datetime(2024, 1, 1)
    rows = [(str(i), s, "created", at, v, "clash") for i, (s, v, _) in enumerate(CASES)] + [
        ("n", "utc", "created", at, None, ""), ("0", CASES[0][0], "created", at, CASES[0][1], ""),
    ]
    assert run(spark, writers, rows) == {str(i): want for i, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_unknown_order_follows_its_neighbours(spark, writers, chunk):
    """Slashed dates without a known order: the order that runs forward in time wins, across chunks."""
    rng = random.Random(3)
    day, rows, want = datetime(2024, 1, 2), [], {}
    for i in range(40):
        day += timedelta(days=rng.randint(1, 4))
        rows.append((f"{i:03d}", "kath", "created", datetime(2024, 1, 1) + timedelta(hours=i), day.strftime("%m/%d/%Y 12:00"), ""))
        want[f"{i:03d}"] = (day + timedelta(hours=12) - timedelta(hours=5, minutes=45)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    assert run(spark, writers, rows, chunk_rows=chunk) == want


def test_what_is_known_of_the_writer_outweighs_the_neighbours(spark, writers):
    """A known date order holds even against a jump back, and a date it makes impossible is not turned round."""
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    said = ["04/01/2024 10:00", "04/02/2024 10:00", "01/05/2024 10:00", "31/12/2024 10:00", "1711906598", "99"]
    rows = [(str(k), "ny", "created", at(k), v, "") for k, v in enumerate(said)]
    want = [
        "2024-04-01T14:00:00.000000Z", "2024-04-02T14:00:00.000000Z", "2024-01-05T15:00:00.000000Z", "unreadable",
        "2024-03-31T17:36:38.000000Z", "unreadable",
    ]
    for chunk in (2, 1000):
        assert run(spark, writers, rows, chunk_rows=chunk) == {str(k): w for k, w in enumerate(want)}


def test_an_hour_that_occurs_twice_can_be_guessed_from_its_neighbours(spark, writers):
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    rows = [(str(k), "ny", "created", at(k), v, "") for k, v in enumerate(["2024-11-03 01:20:00", "2024-11-03 01:50:00", "2024-11-03 01:10:00", "2024-11-03 04:00:00"])]
    assert [run(spark, writers, rows)[str(k)] for k in range(3)] == ["ambiguous"] * 3
    got = run(spark, writers, rows, guess_folds=True)
    assert got["2"] == "2024-11-03T06:10:00.000000Z" and got["1"] == "2024-11-03T05:50:00.000000Z"


@pytest.mark.parametrize("seed", range(4))
def test_chunks_find_the_cheapest_series(seed):
    """Chunked decoding against all series of readings of a random case."""
    from itertools import product

    import pandas as pd

    rng = random.Random(seed)
    series = [[{"fmt": rng.choice("ab"), "at": rng.randrange(20), "cost": float(rng.randrange(3))} for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(8)]
    total = lambda picks: sum(r[k]["cost"] for r, k in zip(series, picks, strict=True)) + sum(timestamps._cost(series[i][picks[i]], series[i + 1][picks[i + 1]]) for i in range(7))
    best = min(total(p) for p in product(*[range(len(r)) for r in series]))
    rows = pd.DataFrame({
        "part": [0, 0, 0, 1, 1, 2, 2, 2], "source": "s", "field": "f", "at": range(8), "row_id": [str(i) for i in range(8)],
        "readings": series,
    })
    sums = pd.concat(list(timestamps._summaries(iter([g])))[0] for _, g in rows.groupby("part"))
    ends = timestamps._stitch(sums)
    got = pd.concat(timestamps._decode(g, ends[ends["part"] == p]) for p, g in rows.groupby("part"))
    assert abs(total(got.sort_values("row_id")["choice"].tolist()) - best) < 1e-9


def test_empty(spark, writers):
    assert run(spark, writers, []) == {}
