"""Daily scores on odd events, against the queries' own SQL on one thread: there the order in which
it adds is that of the events, so that nothing is left open."""

import pytest

from tests.oracle import assert_same, views
from tidemark.plans import catalog

DAY = 86400


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Days before 1970, events without a time, a user or a value."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows, start = [], 1704067200 + 25 * DAY
    for user in (1, 2, None):
        rows += [(start + i * DAY, user, v) for i, v in enumerate((5.0, 9.5, 3.25))]
        rows += [(-DAY - 1, user, 4.0), (-1, user, 4.5), (1, user, 4.25), (None, user, 50.0 if user == 2 else 1.0), (start + 3 * DAY, user, None if user == 2 else 2.0)]
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, t long, user_id long, value double").coalesce(1)
    events = events.selectExpr("event_id", "cast(timestamp_seconds(t) as timestamp_ntz) as ts", "user_id", "'view' as event_type", "value", "'{}' as props")
    events.toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return folder


def same(spark, folder, name):
    con = views(folder)
    con.execute("SET threads = 1")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    assert len(want)
    assert_same(catalog.QUERIES[name](spark, folder).toPandas(), want)


def test_peaks_of_odd_days(spark, odd):
    same(spark, odd, "peak_high_water")


def test_states_of_odd_days(spark, odd):
    same(spark, odd, "state_change_events")


def test_missed_peaks_of_odd_days(spark, odd):
    same(spark, odd, "missed_peaks")
