"""Timers, restarts, replays and side tables of the streams, on small deliveries of their own."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.streaming import stateful as SF
from tickloom.streaming import streams as ST

START = dt.datetime(2024, 1, 1)
ROWS = "key string, ts timestamp, event_id long, value double"


def rows_of(spark, rows):
    """Rows (key, minute, event_id, value) with their microseconds."""
    return SF.with_micros(spark.createDataFrame([(k, START + dt.timedelta(minutes=m), e, v) for k, m, e, v in rows], ROWS))


def minute(us):
    return round((us / 1e6 - dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) / 60, 6)


def test_cooldown_exits_at_their_time_without_a_row_of_the_key(spark):
    """Key a falls silent while held: only the watermark of b ends the hold.  Of rows at one time the smallest id opens."""
    first = [("a", 0, 2, 9.0), ("a", 0, 1, 8.0), ("a", 5, 3, 9.0), ("b", 1, 4, 1.0), ("b", 7, 5, None)]
    second = [("b", 200, 6, 1.0)]
    third = [("a", 201, 7, 9.0), ("c", 500, 8, 2.0)]
    out, _ = ST.run_deliveries([rows_of(spark, r) for r in (first, second, third)], lambda s: SF.cooldown(s, "key", 5.0, 600), "t", watermark="1 minute")
    got = sorted((minute(r.us), r.key, r.event_id, r.kind) for r in out.collect())
    assert got == [(0, "a", 1, "open"), (10, "a", 1, "exit"), (201, "a", 7, "open"), (211, "a", 7, "exit")]


def test_cooldown_opens_again_at_the_exit_itself(spark):
    """A hold that ended inside a micro-batch, before its timer: exit and next opening stand at the same time."""
    rows = [("a", 0, 1, 9.0), ("a", 9, 2, 9.0), ("a", 10, 3, 9.0), ("a", 15, 4, 9.0)]
    out, _ = ST.run_deliveries([rows_of(spark, rows[:2]), rows_of(spark, rows[2:])], lambda s: SF.cooldown(s, "key", 5.0, 600), "t", watermark="1 minute")
    assert sorted((minute(r.us), r.kind, r.event_id) for r in out.collect()) == [(0, "open", 1), (10, "exit", 1), (10, "open", 3)]


def test_heartbeat_tells_each_silence_once(spark):
    first = [("a", 0, 1, None), ("a", 5, 2, None), ("b", 0, 3, None)]
    second = [("b", 8, 4, None), ("b", 300, 5, None)]
    third = [("a", 400, 6, None), ("a", 400, 7, None), ("b", 305, 8, None)]
    out, _ = ST.run_deliveries([rows_of(spark, r) for r in (first, second, third)], lambda s: SF.heartbeat(s, "key", 600), "t", watermark="1 minute")
    got = sorted((r.key, minute(r.us), r.status, None if r.last_us is None else minute(r.last_us)) for r in out.collect())
    assert got == [("a", 0, "live", None), ("a", 15, "dead", 5), ("a", 400, "live", 5), ("b", 0, "live", None), ("b", 18, "dead", 8), ("b", 300, "live", 8), ("b", 315, "dead", 305)]


def test_positions_count_a_replayed_fill_once(spark):
    """Repeats in one delivery and in a later one; a replay behind the watermark is late; closing leaves exactly zero."""
    fills = lambda rows: rows_of(spark, [(k, m, e, p) for k, m, e, _, p in rows]).join(spark.createDataFrame([(r[2], r[3]) for r in set(rows)], "event_id long, qty double"), "event_id").withColumnRenamed("value", "price")
    a = [("a", 0, 1, 100000.1, 2.0), ("a", 1, 2, 200000.2, 5.0), ("a", 1, 2, 200000.2, 5.0)]
    b = [("a", 0, 1, 100000.1, 2.0), ("a", 2, 3, -300000.3, 6.0), ("b", 2, 4, 2.0, 3.0), ("b", 3, 5, -5.0, 4.0)]
    c = [("a", 4, 6, 5.0, 7.0), ("b", 3, 5, -5.0, 4.0), ("z", 600, 9, 1.0, 1.0)]
    d = [("a", 0, 1, 100000.1, 2.0), ("b", 601, 10, -1.0, 8.0)]
    out, _ = ST.run_deliveries([fills(x) for x in (a, b, c, d)], lambda s: SF.positions(s, "key"), "t", watermark="30 minutes")
    last = {r.key: (round(r.v.qty, 6), round(r.v.avg_price, 6), r.v.fills) for r in out.groupBy("key").agg(F.max_by(F.struct("qty", "avg_price", "fills"), "fills").alias("v")).collect()}
    assert last == {"a": (5.0, 7.0, 4), "b": (-4.0, 5.0, 3), "z": (1.0, 1.0, 1)}


BAR = "key string, ts timestamp, us long, session long, open double, high double, low double, close double, volume double"


def test_session_features_carry_over_deliveries(spark):
    """Cut into many deliveries, the features equal those of one; a late bar changes nothing and goes to the side table."""
    bars = []
    for day in range(5):
        for slot in range(3):
            ts, c = START + dt.timedelta(days=day, hours=slot), 10.0 + day + (slot * 7 % 5)
            bars.append(("k", ts, 0, day, c - 1, c + 2 + slot, c - 2, c, float(slot)))
    make = lambda rows: SF.with_micros(spark.createDataFrame(rows, BAR))
    work = lambda s: SF.session_features(s, "key", lookback=2)
    whole, none = ST.run_deliveries([make(bars)], work, "t", late="late")
    parts, late = ST.run_deliveries([make(bars[:4]), make(bars[4:9] + bars[2:3]), make(bars[9:])], work, "t", late="late")
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert order(whole) == order(parts) and none.count() == 0 and [tuple(r)[2:] for r in late.collect()] == [(None,) * 6 + (True,)]
    rows = order(whole)
    assert len(rows) == 15 and [r[2] for r in rows[:4]] == [0, 1, 2, 0] and rows[0][3] == bars[0][7]
    moves = [abs(b[7] / bars[3 * b[3]][4] - 1) for b in bars]
    assert rows[7][5] == pytest.approx((moves[1] + moves[4]) / 2) and rows[4][5] is None
    assert rows[7][6] == pytest.approx(max(bars[6][4], bars[5][7]) * (1 + rows[7][5]))


def test_quarantine_writes_once_after_a_failure(spark, tmp_path, monkeypatch):
    """The query dies after the side table is written and before the good rows are; run again, every line stands once."""
    path = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"x":1.5}\n{"id":2,"x":"no"}\n\n{"id":3}\n{"id":4,"x":2.5\n{"id":5,"x":null}\nnot json\n{"id":6,"x":2,"more":1}\n')
    stream = lambda: ST.json_stream(spark, f"{path}/in", "id long, x double")
    run, calls = ST.start_and_wait, []

    def dying(s, write, checkpoint):
        def broken(batch, number):
            batch.where("reason is not null").select("raw", "reason").write.mode("overwrite").parquet(f"{path}/bad/batch={number}")
            calls.append(number)
            raise RuntimeError("lost")

        run(s, broken, checkpoint)

    with monkeypatch.context() as m:
        m.setattr(ST, "start_and_wait", dying)
        with pytest.raises(Exception, match="lost"):
            ST.quarantined(stream(), path)
    assert calls == [0] and spark.read.parquet(f"{path}/bad").count() == 5
    good, bad = ST.quarantined(stream(), path)
    assert sorted(map(tuple, good.collect())) == [(1, 1.5), (6, 2.0)]
    assert sorted((r.reason, r.raw[:9]) for r in bad.collect()) == [("incomplete", '{"id":3}'), ("incomplete", '{"id":5,"'), ("malformed", "not json"), ("malformed", '{"id":2,"'), ("malformed", '{"id":4,"')]
    (tmp_path / "in" / "b.json").write_text('{"id":7,"x":3.5}\n{"id":8,"x":[]}\n')
    good, bad = ST.quarantined(stream(), path)
    assert good.count() == 3 and bad.count() == 6


def test_streams_need_a_shared_folder_off_local_mode():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://cluster"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        ST.shared_path(Session(), "x")


def test_rows_of_one_time_and_id_stand_with_nulls_last():
    rows = [Row(us=1, event_id=2, value=None), Row(us=1, event_id=2, value=3.0), Row(us=0, event_id=9, value=None)]
    assert SF._ordered(iter(rows), "us", "event_id", "value") == [(0, 9, None), (1, 2, 3.0), (1, 2, None)]
