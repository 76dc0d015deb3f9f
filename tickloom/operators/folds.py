"""Operators that are sequential within a key: one key's series is folded in pandas, keys run in parallel.

A group is one instrument's series, one date's book or one account's state, never a whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cascade_alpha(period: int, poles: int = 4) -> float:
    beta = (1 - math.cos(2 * math.pi / period)) / (2 ** (1 / poles) - 1)
    return -beta + math.sqrt(beta * beta + 2 * beta)


def ema_cascade(bars: DataFrame, key: str, ts: str, period: int = 144, poles: int = 4, width: float = 1.414) -> DataFrame:
    """key, ts, filter, upper, lower: chained averages of the typical price, each seeded with its first value, and bands by those of the true range; null before ``period`` bars."""
    alpha = cascade_alpha(period, poles)
    kinds = dict(bars.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        mid, span = (pdf.high + pdf.low + pdf.close) / 3, pdf.tr
        for _ in range(poles):
            mid, span = mid.ewm(alpha=alpha, adjust=False).mean(), span.ewm(alpha=alpha, adjust=False).mean()
        ready = np.arange(len(pdf)) >= period - 1
        out = pd.DataFrame({key: pdf[key], ts: pdf[ts], "filter": mid, "upper": mid + width * span, "lower": mid - width * span})
        out.loc[~ready, ["filter", "upper", "lower"]] = None
        return out

    return bars.select(key, ts, "high", "low", "close", "tr").groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {ts} {kinds[ts]}, filter double, upper double, lower double")


def wilder_atr(bars: DataFrame, keys: list[str], ts: str, period: int = 14) -> DataFrame:
    """Mean of the first ``period`` true ranges, then (prior * (period - 1) + tr) / period; null before."""
    kinds = dict(bars.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        tr = pdf.tr.to_numpy(float)
        out = np.full(len(tr), np.nan)
        if len(tr) >= period:
            rest = np.concatenate([[tr[:period].mean()], tr[period:]])
            out[period - 1 :] = pd.Series(rest).ewm(alpha=1 / period, adjust=False).mean()
        return pdf[[*keys, ts]].assign(atr=pd.Series(out, index=pdf.index).astype(object).where(~np.isnan(out), None))

    return bars.select(*keys, ts, "tr").groupBy(*keys).applyInPandas(fold, ", ".join(f"{k} {kinds[k]}" for k in [*keys, ts]) + ", atr double")


def atr_ema(bars: DataFrame, key: str, ts: str, period: int = 14) -> DataFrame:
    """The first true range, then a + (tr - a) / period."""
    kinds = dict(bars.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        return pdf[[key, ts]].assign(atr=pdf.tr.ewm(alpha=1 / period, adjust=False).mean())

    return bars.select(key, ts, "tr").groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {ts} {kinds[ts]}, atr double")


def cooldown_trades(signals: DataFrame, key: str, ts_s: str = "ts_s", hold_s: int = 3600, multiple: float = 1.0, release: str | None = None) -> DataFrame:
    """Trades in time order: none while held; open beyond ``multiple`` times the cost; hold ``hold_s`` seconds, or until ``release`` (a column of seconds).

    Rows without a cost are passed over.  Columns needed: pred_bps, fwd_bps, cost_bps.
    """
    kinds = dict(signals.dtypes)
    extra = [release] if release else []

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, free = [], None
        pdf = pdf.sort_values(ts_s)
        ends = pdf[release] if release else pdf[ts_s] + hold_s
        for t, p, f, cost, end, k in zip(pdf[ts_s], pdf.pred_bps, pdf.fwd_bps, pdf.cost_bps, ends, pdf[key]):
            if cost != cost or (free is not None and t < free) or not abs(p) > multiple * cost:
                continue
            side = 1 if p > 0 else -1
            rows.append((k, t, side, side * f - cost))
            free = end
        return pd.DataFrame(rows, columns=[key, ts_s, "side", "net_bps"])

    return signals.select(key, ts_s, "pred_bps", "fwd_bps", "cost_bps", *extra).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {ts_s} {kinds[ts_s]}, side int, net_bps double")


def waterfall_cap(book: DataFrame, by: str, id: str, weight: str, cap: str, passes: int = 8) -> DataFrame:
    """Weights cut at their caps by side, what is cut placed where there is room, in proportion to it."""
    kinds = dict(book.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id).reset_index(drop=True)
        w, caps = pdf[weight].to_numpy(float).copy(), pdf[cap].to_numpy(float)
        for sign in (1.0, -1.0):
            side = np.sign(w) == sign
            size = np.abs(w[side])
            kept = np.minimum(size, caps[side])
            spill = (size - kept).sum()
            for _ in range(passes):
                room = np.maximum(caps[side] - kept, 0)
                total = room.sum()
                if spill <= 0 or total <= 0:
                    break
                placed = min(spill, total)
                kept, spill = kept + placed * room / total, spill - placed
            w[side] = sign * kept
        return pdf[[by, id]].assign(weight=w)

    return book.select(by, id, weight, cap).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {id} {kinds[id]}, weight double")


def net_cap(book: DataFrame, by: str, id: str, weight: str, limit: float, least: float) -> DataFrame:
    """The heavier side scaled until |net| <= limit; positions that fall below ``least`` go, and it is looked at again."""
    kinds = dict(book.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.set_index(id)[weight].astype(float).sort_index()
        dropped = True
        while dropped:  # once no position goes, the net is at the limit
            up, down = w[w > 0].sum(), -w[w < 0].sum()
            if abs(up - down) - limit <= 1e-12:
                break
            heavy = (w > 0) if up > down else (w < 0)
            w = w.where(~heavy, w * ((min(up, down) + limit) / max(up, down)))
            small = heavy & (w.abs() + 1e-12 < least)
            w, dropped = w[~small], small.any()
        return pd.DataFrame({by: pdf[by].iloc[0], id: w.index, "weight": w.to_numpy()})

    return book.select(by, id, weight).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {id} {kinds[id]}, weight double")


def turnover_budget(trades: DataFrame, by: str, id: str, drift: str, free: str, budget: float) -> DataFrame:
    """Free trades always pass; others by largest drift while the budget lasts, those that don't fit are passed over."""
    kinds = dict(trades.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size_=pdf[drift].abs()).sort_values(["size_", id], ascending=[False, True])
        spent, keep = 0.0, []
        for is_free, size in zip(pdf[free], pdf.size_):
            ok = bool(is_free) or spent + size <= budget
            spent += 0.0 if is_free or not ok else size
            keep.append(ok)
        return pdf[keep][[by, id, drift]]

    return trades.select(by, id, drift, free).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {id} {kinds[id]}, {drift} double")


def direction_state(scores: DataFrame, key: str, ts: str, *, enter=0.4, leave=0.0, strong=0.8, gross=(0.4, 0.8, 1.0), net=(0.3, 0.6), vol_target=0.15, step=0.2) -> DataFrame:
    """Side with hysteresis and a ramped budget from score (-1 to 1) and vol.

    Neutral turns long at ``enter``; a side reverses at the opposite threshold and ends at
    ``leave``.  Gross falls at once and rises by ``step``; net follows it, and a side that no longer
    holds keeps no exposure.
    """
    kinds = dict(scores.dtypes)

    def toward(now, want):
        return now + max(-step, min(step, want - now))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, side, g, n, rows = pdf.sort_values(ts), 0, 0.0, 0.0, []
        for score, vol in zip(pdf.score, pdf.vol):
            if side == 0:
                side = 1 if score >= enter else -1 if score <= -enter else 0
            elif side * score <= -enter:
                side = -side
            elif side * score <= leave:
                side = 0
            level = 0 if side == 0 else 2 if abs(score) >= strong else 1
            scale = 1.0 if vol <= 1e-12 else min(1.0, vol_target / vol)
            want_g = gross[level] * scale
            want_n = side * net[level - 1] * scale if level else 0.0
            g = want_g if want_g < g else toward(g, want_g)
            now = want_n / want_g * g if want_g > 1e-12 else 0.0
            if abs(now) <= 1e-12:
                n = 0.0
            else:
                n = max(-g, min(g, toward(0.0 if n * now < 0 else n, now)))
            rows.append((side, g, n))
        return pdf[[key, ts]].assign(side=[r[0] for r in rows], gross=[r[1] for r in rows], net=[r[2] for r in rows])

    return scores.select(key, ts, "score", "vol").groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {ts} {kinds[ts]}, side int, gross double, net double")


def vol_target_overlay(returns: DataFrame, key: str, ts: str, r: str, target: float, cut: float, floor: float = 0.5, window: int = 8, per_year: float = 52.0) -> DataFrame:
    """Exposure min(1, target / trailing deviation), at most ``floor`` below the drawdown limit of the overlaid equity."""
    kinds = dict(returns.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, eq, peak, rows = pdf.sort_values(ts), 1.0, 1.0, []
        dev = pdf[r].rolling(window).std().shift(1).to_numpy() * math.sqrt(per_year)
        for x, v in zip(pdf[r], dev):
            e = min(1.0, target / v) if v == v and v > 0 else 1.0
            if eq / peak - 1 <= -cut:
                e = min(e, floor)
            eq *= 1 + e * x
            peak = max(peak, eq)
            rows.append((e, eq))
        return pdf[[key, ts]].assign(exposure=[a for a, _ in rows], equity=[b for _, b in rows])

    return returns.select(key, ts, r).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {ts} {kinds[ts]}, exposure double, equity double")


def session_features(bars: DataFrame, key: str, session: str, ts: str, lookback: int = 14) -> DataFrame:
    """Cumulative vwap, slot, session open, prior close and noise bands, all as windows."""
    from pyspark.sql import Window

    c = F.col
    w = Window.partitionBy(key, session).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    v = F.sum("volume").over(w)
    typical = (c("high") + c("low") + c("close")) / 3
    x = bars.withColumn("vwap", F.when(v > 0, F.sum(typical * c("volume")).over(w) / v).otherwise(c("close"))).withColumn("slot", F.row_number().over(Window.partitionBy(key, session).orderBy(ts)) - 1).withColumn("s_open", F.first("open").over(w))
    ends = bars.groupBy(key, session).agg(F.max_by("close", ts).alias("s_close"))
    ends = ends.select(key, session, F.lag("s_close").over(Window.partitionBy(key).orderBy(session)).alias("prior_close"))
    past = Window.partitionBy(key, "slot").orderBy(session).rowsBetween(-lookback, -1)
    move = F.abs(c("close") / c("s_open") - 1)
    x = x.join(ends, [key, session], "left").withColumn("noise_sigma", F.when(F.count(move).over(past) == lookback, F.avg(move).over(past)))
    return x.withColumn("noise_ub", F.greatest("s_open", "prior_close") * (1 + c("noise_sigma"))).withColumn("noise_lb", F.least("s_open", "prior_close") * (1 - c("noise_sigma")))
