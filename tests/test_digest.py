"""The digest consumer: cursor, quiet hours, failing channels, runs that break off."""

import pytest

from tidemark.sources import stored
from tidemark.streaming import digest

EVENT = "event_id long, t long, type string, source string, ref_id string"
ITEM = "id string, score double, confidence double, lang string"
NOON, NIGHT = 1706702400, 1706742000  # 12:00 and 23:00 UTC


@pytest.fixture()
def log(spark):
    kinds = ["trend.detected", "creator.breakout", "trend.peaked", "manual.intervention.required"]
    rows = [(i, i * 60, kinds[i % 4], "s", f"i{i % 7}" if i % 5 else None) for i in range(1, 31)]
    items = [(f"i{k}", 10.0 * k, 0.1 * k, [None, "en", "fr"][k % 3]) for k in range(6)]
    return spark.createDataFrame(rows, EVENT), spark.createDataFrame(items, ITEM)


@pytest.fixture()
def make(spark, tmp_path):
    table = stored.StoredTable(spark, f"file://{tmp_path}/state", "0")
    return lambda name="me", **options: digest.Digest(table, name, digest.Wanted(**options))


def test_batches_are_told_once_in_order(log, make):
    me, sent = make(batch=12, most=4, least_score=15.0, languages=["en"]), []
    results = [me.dispatch(*log, NOON, {"mail": lambda rows, batch: sent.append((batch, [r["event_id"] for r in rows]))}) for _ in range(4)]
    assert [r.cursor for r in results] == [12, 24, 30, 30] and results[-1].considered == 0
    assert [b for b, _ in sent] == [0, 1, 2]
    # of events 1 to 12: items 3 (no language) and 4 pass, told by their first event; 3, 7, 11 need a human
    assert sent[0][1] == [4, 3, 7, 11]


def test_items_are_told_by_their_first_event(spark, log):
    events = spark.createDataFrame([(5, 1, "trend.detected", "s", "i4"), (3, 1, "creator.breakout", "s", "i4"), (2, 1, "trend.peaked", "s", "i4"), (4, 1, "trend.detected", "s", "gone"), (6, 1, "trend.detected", "s", "i5")], EVENT)
    got = digest.notices(events, log[1], digest.Wanted()).collect()
    assert [(r["event_id"], r["kind"], r["score"]) for r in got] == [(6, "viral", 50.0), (3, "breakout", 40.0)]


def test_quiet_hours_hold_the_batch(log, make):
    me, sent = make(quiet=(22, 7)), []
    tell = {"mail": lambda rows, batch: sent.append(len(rows))}
    held = me.dispatch(*log, NIGHT, tell)
    assert held.held and held.considered > 0 and held.cursor == 0 and not sent
    assert not me.dispatch(*log, NOON, tell).held and sent == [held.considered]
    wraps = digest.Wanted(quiet=(22, 7), zone="Asia/Tehran")
    assert [wraps.is_quiet(NOON + 3600 * h) for h in (0, 6, 7, 14, 15, 16)] == [False, False, True, True, True, False]
    assert not digest.Wanted(quiet=(5, 5)).is_quiet(NIGHT)


def test_nothing_to_say_moves_the_cursor_even_at_night(log, make):
    me = make(kinds=["breakout"], least_score=1e9, quiet=(22, 7))
    assert me.dispatch(*log, NIGHT, {"mail": lambda *a: None}).cursor == 30


def test_a_channel_that_is_down(log, make):
    me, sent = make(), []

    def down(rows, batch):
        raise OSError("down")

    none = me.dispatch(*log, NOON, {"down": down})
    assert none.sent == 0 and none.cursor == 0
    both = me.dispatch(*log, NOON, {"down": down, "mail": lambda rows, batch: sent.append(batch)})
    assert both.channels == ("mail",) and both.cursor == 30 and sent == [0]
    assert me.dispatch(*log, NOON, {}).cursor == 30


def test_a_run_that_breaks_off_repeats_its_batch(spark, log, make):
    events, items = log
    me, sent = make(batch=10), []
    tell = {"mail": lambda rows, batch: sent.append(("mail", batch)), "chat": lambda rows, batch: sent.append(("chat", batch))}

    class Killed(BaseException):
        pass

    def killed(rows, batch):
        raise Killed

    with pytest.raises(Killed):
        me.dispatch(events.where("event_id <= 7"), items, NOON, {"mail": tell["mail"], "chat": killed})
    assert sent == [("mail", 0)] and me._position() == (0, 7, 0)
    # more events have come, but the batch is the one that was begun, and mail has it
    again = me.dispatch(events, items, NOON, tell)
    assert sent == [("mail", 0), ("chat", 0)] and again.cursor == 7
    assert me.dispatch(events, items, NOON, tell).cursor == 17 and sent[2:] == [("mail", 1), ("chat", 1)]


def test_consumers_have_cursors_of_their_own(log, make):
    a, b = make("a", batch=10), make("b", batch=30)
    tell = {"mail": lambda rows, batch: None}
    assert a.dispatch(*log, NOON, tell).cursor == 10 and b.dispatch(*log, NOON, tell).cursor == 30
    assert a.dispatch(*log, NOON, tell).cursor == 20
