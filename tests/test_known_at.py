import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronotext.operators import temporal
from chronotext.operators.known_at import for_every_entity, known_at
from chronotext.plans.known_vintages import known_vintages, plain_number

D = date(2020, 1, 1)
EV, CH = "k string, day date, v string", "k string, av date, rank int, v string"


def brute(events, changes):
    out = []
    for k, d, v in events:
        best = max(((r, x or "") for kk, a, r, x in changes if k is not None and d is not None and kk == k and a is not None and a <= d), default=None)
        out.append((k, d, v, best[1] if best else None))
    return out


@pytest.mark.parametrize("span,salts", [(366, 1), (7, 1), (7, 3)])
def test_against_brute_force(spark, span, salts):
    r = random.Random(3)
    days = [D + timedelta(days=i) for i in range(60)] + [None]
    events = [(r.choice(["a", "a", "a", "b", None]), r.choice(days), str(i % 4)) for i in range(120)]
    changes = [(r.choice(["a", "a", "b", "c", None]), r.choice(days), r.randrange(5), f"x{r.randrange(5)}") for _ in range(80)]
    got = known_at(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH), ["k"], "day", "av", [F.col("rank")], ["v"], span_days=span, salts=salts)
    assert got.columns == ["k", "day", "v", "known_v"]  # clashing names stay apart
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(events, changes), key=key)


def test_empty_tables(spark):
    e, c = spark.createDataFrame([("a", D, "1")], EV), spark.createDataFrame([], CH)
    assert [r["known_v"] for r in known_at(e, c, ["k"], "day", "av", [F.col("rank")], ["v"]).collect()] == [None]
    assert known_at(e.limit(0), c, ["k"], "day", "av", [F.col("rank")], ["v"]).count() == 0


def test_no_look_ahead(spark):
    """A change that becomes known later never alters an earlier event."""
    e = spark.createDataFrame([("a", D, "1")], EV)
    c = [("a", D, 1, "old")]
    later = [("a", D + timedelta(days=1), 9, "new")]
    for rows in (c, c + later):
        assert known_at(e, spark.createDataFrame(rows, CH), ["k"], "day", "av", [F.col("rank")], ["v"]).first()["known_v"] == "old"


def test_exclusive(spark):
    e, c = spark.createDataFrame([("a", D, "1")], EV), spark.createDataFrame([("a", D, 1, "x")], CH)
    assert known_at(e, c, ["k"], "day", "av", [F.col("rank")], ["v"], inclusive=False).first()["known_v"] is None


def test_vintages(spark):
    cal = spark.createDataFrame([(D, None), (D, None), (date(2020, 3, 1), D)], "meeting_date date, blackout_date date")
    t = datetime(2019, 12, 31, 23, 59)
    obs = [(1, "s", date(2019, 11, 1), t, " 1.5 "), (2, "s", date(2019, 11, 1), t, "1.5"), (3, "s", date(2019, 12, 1), t, "NA"), (4, "s", date(2020, 2, 1), t, "9"), (5, "s", date(2019, 12, 1), datetime(2020, 2, 1), "2"), (6, None, D, t, "1"), (7, "s", D, t, None)]
    got = known_vintages(cal, spark.createDataFrame(obs, "obs_id long, series string, obs_date date, realtime_start timestamp_ntz, value string"))
    assert sorted((r["event_type"], str(r["day"]), r["known_obs_id"]) for r in got.collect()) == [("blackout_date", "2020-01-01", 1), ("meeting_date", "2020-01-01", 1), ("meeting_date", "2020-03-01", 4)]


def test_plain_number(spark):
    values = ["1", " -1.5\t", "+.5", "1.", ".", "", "1e5", "1,000", "NA", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(plain_number(F.col("v"))).collect()]
    assert got == ["1", "-1.5", "+.5", "1.", None, None, None, None, None, None]


def test_calendar_for_every_entity(spark):
    e = spark.createDataFrame([("a",), ("b",)], "k string")
    assert for_every_entity(e, spark.createDataFrame([(D,), (D,), (None,)], "day date")).count() == 4
    assert for_every_entity(e, spark.createDataFrame([], "day date")).count() == 0


def test_nearest_tie_goes_back_and_row_match_keeps_nulls(spark):
    left = spark.createDataFrame([(D,)], "d date")
    right = spark.createDataFrame([(D - timedelta(days=1), None), (D + timedelta(days=1), 5)], "r date, v int")
    near = temporal.asof(left, right, [], "d", "r", ["v"], "nearest", tolerance_days=2).first()
    assert near["known_at"] == D - timedelta(days=1) and near["known_v"] is None
    assert temporal.asof(left, right, [], "d", "r", ["v"], "nearest", skip_null="v").first()["known_v"] == 5
    assert temporal.asof(left, right, [], "d", "r", ["v"], "forward", tolerance_days=0.5).first()["known_v"] is None
