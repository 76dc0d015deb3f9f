"""Queries against their SQL on tables of the kinds that round 4's review met."""

import datetime as dt
import itertools
import math
import random

import pytest
from test_findings_r03 import same


def events(spark, folder, values):
    """A table of events: for each type the values of each hour, a minute apart."""
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(hours=h, minutes=m), t, v) for t, hours in values.items() for h, vs in hours.items() for m, v in enumerate(vs)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, ts, 1, t, v, "{}") for i, (ts, t, v) in enumerate(rows)], schema).write.parquet(f"{folder}/events.parquet")
    return folder


def test_market_history_keeps_assets_whose_rows_all_go_aside(spark, tmp_path):
    """All hours of view and of no type are too wide, none of error's, one of click's."""
    wide, up, down = [1.0, 100.0], [2.0, 3.0], [3.0, 2.0]
    folder = events(spark, tmp_path, {"view": {0: wide, 1: wide}, None: {0: wide}, "error": {0: up, 1: down}, "click": {0: up, 1: wide, 2: down}})
    rows = same(spark, "read_market_history", folder).collect()
    assert {r.asset: tuple(r)[1:] for r in rows} == {"VIEW": (2, 0, 2), None: (1, 0, 1), "ERROR": (0, 1, 2), "CLICK": (1, 1, 3)}


def test_ticks_without_a_price_neither_open_nor_close_a_bar(spark, tmp_path):
    folder = events(spark, tmp_path, {"error": {0: [None, 2.0, 3.0], 1: [3.0, 2.0, None], 2: [None, None], 3: [2.0, 3.0]}})
    same(spark, "resample_ohlcv", folder)
    assert [tuple(r) for r in same(spark, "read_market_history", folder).collect()] == [("ERROR", 0, 1, 4)]


def plain_spreads(bars):
    """Hours' high, low and close by the papers' formulas, one pair of consecutive hours after the other."""
    pairs = [(bars[i], bars[i + 1]) for i in sorted(bars) if i + 1 in bars and min(bars[i] + bars[i + 1]) > 0]
    v, s, k = [], [], 3 - 2 * math.sqrt(2)
    for x, y in pairs:
        (h, l, c), (h1, l1, _) = (tuple(map(math.log, b)) for b in (x, y))  # noqa: E741
        v.append((c - (h + l) / 2) * (c - (h1 + l1) / 2))
        beta, gamma = (h - l) ** 2 + (h1 - l1) ** 2, (max(h, h1) - min(l, l1)) ** 2
        alpha = (math.sqrt(2 * beta) - math.sqrt(beta)) / k - math.sqrt(gamma / k)
        s.append(2 * (math.exp(alpha) - 1) / (1 + math.exp(alpha)))
    s = [max(x, 0) for x in s if -0.5 < x < 0.5]
    mean = lambda xs: sum(xs) / len(xs)
    return len(pairs), 2 * math.sqrt(max(0, mean(v))) if len(v) >= 200 else None, len(s), mean(s) if len(s) >= 200 else None


def test_both_spread_estimators_find_a_planted_spread(spark, tmp_path):
    """Trades at one percent around a slow walk: view has 312 hours with gaps and an hour of a zero price; error too few pairs; click's hours spread over decades."""
    draw, mid, values = random.Random(7), 100.0, {"view": {}, "error": {}, "click": {}}
    for hour in range(320):
        if hour % 40 == 39:
            mid *= 1.5
            continue
        trades = []
        for _ in range(12):
            mid *= math.exp(draw.gauss(0, 0.0004))
            trades.append(mid * draw.choice((0.995, 1.005)))
        values["view"][hour] = [0.0, *trades] if hour == 100 else trades
        values["click"][hour] = [draw.choice((1.0, 1e3, 1e6)) * x for x in trades]
    values["error"] = dict(itertools.islice(values["view"].items(), 150))
    got = {r.asset: r for r in same(spark, "spread_estimators", events(spark, tmp_path, values)).collect()}
    for asset, hours in values.items():
        r, want = got[asset.upper()], plain_spreads({h: (max(x), min(x), x[-1]) for h, x in hours.items()})
        assert (r.pairs, r.inside) == want[::2] and [r.abdi_ranaldo, r.corwin_schultz] == [x and pytest.approx(x, abs=1e-6) for x in want[1::2]]
    view, click, error = got["VIEW"], got["CLICK"], got["ERROR"]
    assert view.pairs == 302 and 0.009 < view.abdi_ranaldo < 0.011 and 0.009 < view.corwin_schultz < 0.011
    assert error.pairs < 200 and error.abdi_ranaldo is error.corwin_schultz is None
    assert click.inside < 200 and click.abdi_ranaldo > 1 and click.corwin_schultz is None
