"""Queries for trailing features: each column stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.windows import Trailing
from ..registry import register
from . import base

T = Trailing("asset")
col = F.col


def _clean(n, x, value):
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {value} END"


def _full(n, value):
    return f"CASE WHEN count(*) OVER w{n} = {n} THEN {value} END"


def _skew(n, x="lr"):
    m = f"avg({x}) OVER w{n}"
    return _clean(n, x, f"CASE WHEN stddev_pop({x}) OVER w{n} > 0 THEN (avg(pow({x}, 3)) OVER w{n} - 3 * {m} * avg(pow({x}, 2)) OVER w{n} + 2 * pow({m}, 3)) / pow(stddev_pop({x}) OVER w{n}, 3) END")


def _semi(n, sign):
    return _clean(n, "r1", f"sqrt(sum(CASE WHEN r1 {sign} 0 THEN r1 * r1 ELSE 0.0 END) OVER w{n})")


def _drawdown(n):
    return _full(n, f"list_reduce(list_transform(list(close) OVER w{n}, lambda v: {{'peak': v, 'worst': 0.0::DOUBLE}}), lambda a, v: {{'peak': greatest(a.peak, v.peak), 'worst': least(a.worst, v.peak / greatest(a.peak, v.peak) - 1)}}).worst")


_TAKER, _DEPTH = "(quote_volume / (volume * high))", "((2 * close - high - low) / nullif(high + low, 0.0))"


def _mean15(x):
    return T.clean(15, x, T.agg(F.avg, x, 15))


H, D = "hb", "db"
FEATURES = {
    "ret_n": (H, {f"ret_{n}h": (lambda n=n: T.ret(n), f"close / lag(close, {n}) OVER w - 1") for n in (6, 24, 72, 168)}),
    "ret_n_daily": (D, {f"ret_{n}": (lambda n=n: T.ret(n), f"close / lag(close, {n}) OVER w - 1") for n in (1, 5, 7, 21, 30, 63, 90, 126, 180, 252)}),
    "ret_skip": (D, {"ret_30_skip_7": (lambda: T.ret_skip(7, 30), "lag(close, 7) OVER w / lag(close, 30) OVER w - 1"), "ret_252_skip_21": (lambda: T.ret_skip(21, 252), "lag(close, 21) OVER w / lag(close, 252) OVER w - 1"), "ret_21_skip_5": (lambda: T.ret_skip(5, 21), "lag(close, 5) OVER w / lag(close, 21) OVER w - 1")}),
    "vol_n": (D, {f"vol_{n}": (lambda n=n: T.vol(n), _clean(n, "lr", f"stddev_samp(lr) OVER w{n} * sqrt(365.0)")) for n in (30, 90)}),
    "rv_n": (H, {f"rv_{n}h": (lambda n=n: T.vol(n, "r1", 8760.0), _clean(n, "r1", f"stddev_samp(r1) OVER w{n} * sqrt(8760.0)")) for n in (6, 24, 72, 168)}),
    "vol_pop_n": (D, {f"vol_pop_{n}": (lambda n=n: T.vol(n, "r1", 1.0, population=True), _clean(n, "r1", f"stddev_pop(r1) OVER w{n}")) for n in (15, 20, 60)}),
    "semivol": (D, {"semivol_30": (lambda: T.semivol(30), _clean(30, "lr", "sqrt(sum(pow(least(lr, 0.0), 2)) OVER w30 / 29) * sqrt(365.0)")), "downside_vol_60": (lambda: T.semivol(60, "r1", 252.0, 0), _clean(60, "r1", "sqrt(sum(pow(least(r1, 0.0), 2)) OVER w60 / 60) * sqrt(252.0)"))}),
    "semi_up_dn": (H, {"semi_up": (lambda: T.semi(24, True), _semi(24, ">")), "semi_dn": (lambda: T.semi(24, False), _semi(24, "<")), "semi_ratio": (lambda: T.semi(24, True) / (T.semi(24, False) + 1e-12), f"{_semi(24, '>')} / ({_semi(24, '<')} + 1e-12)")}),
    "skew_n": (D, {"skew_30": (lambda: T.skew(30), _skew(30)), "skew_60": (lambda: T.skew(60), _skew(60))}),
    "dist_high_low": (D, {f"dist_{k}_{n}": (lambda n=n, k=k: getattr(T, f"dist_{k}")(n), _full(n, f"close / {'max' if k == 'high' else 'min'}(close) OVER w{n} - 1")) for n in (90, 252) for k in ("high", "low")}),
    "dd_168h": (H, {"dd_168h": (lambda: T.dist_high(168), _full(168, "close / max(close) OVER w168 - 1"))}),
    "max_drawdown_126": (D, {"max_drawdown_126": (lambda: T.max_drawdown(126), _drawdown(126))}),
    "amihud_n": (D, {"amihud_30": (lambda: T.amihud(30, scale=1e6), _clean(30, "CASE WHEN quote_volume > 0 THEN abs(r1) / quote_volume END", "avg(CASE WHEN quote_volume > 0 THEN abs(r1) / quote_volume END) OVER w30 * 1e6")), "amihud_20": (lambda: T.amihud(20, scale=1e6), _clean(20, "CASE WHEN quote_volume > 0 THEN abs(r1) / quote_volume END", "avg(CASE WHEN quote_volume > 0 THEN abs(r1) / quote_volume END) OVER w20 * 1e6"))}),
    "adv_median": (H, {"adv_quote": (lambda: T.clean(20, "quote_volume", T.median(20, "quote_volume")), _clean(20, "quote_volume", "median(quote_volume) OVER w20")), "median_notional_60": (lambda: T.clean(60, "quote_volume", T.median(60, "quote_volume")), _clean(60, "quote_volume", "median(quote_volume) OVER w60"))}),
    "turnover_mean": (D, {"turnover_20": (lambda: T.clean(20, "quote_volume", T.agg(F.avg, "quote_volume", 20)), _clean(20, "quote_volume", "avg(quote_volume) OVER w20"))}),
    "range_frac_n": (D, {"range_frac_14": (lambda: T.full(14, T.agg(F.avg, (col("high") - col("low")) / col("close"), 14)), _full(14, "avg((high - low) / close) OVER w14")), "f_range": (lambda: (col("high") - col("low")) / col("close"), "(high - low) / close")}),
    "surprise_ratio": (H, {"f_volsurp": (lambda: T.surprise("quote_volume"), "CASE WHEN count(quote_volume) OVER w20 >= 10 AND median(quote_volume) OVER w20 > 0 THEN quote_volume / median(quote_volume) OVER w20 END"), "f_trsurp": (lambda: T.at_least(10, 20, "tr", F.when(T.agg(F.avg, "tr", 20) > 0, col("tr") / T.agg(F.avg, "tr", 20))), "CASE WHEN count(tr) OVER w20 >= 10 AND avg(tr) OVER w20 > 0 THEN tr / avg(tr) OVER w20 END")}),
    "trade_size_surp": (H, {"trade_size_surp": (lambda: T.surprise(col("quote_volume") / col("trades"), 168, 48), "CASE WHEN count(quote_volume / trades) OVER w168 >= 48 THEN quote_volume / trades / median(quote_volume / trades) OVER w168 END")}),
    "volume_surge": (D, {"volume_surge_20": (lambda: T.surge("quote_volume"), "CASE WHEN count(quote_volume) OVER p20 = 20 AND median(quote_volume) OVER p20 > 0 THEN quote_volume / median(quote_volume) OVER p20 END")}),
    "f_gap_accel": (D, {"f_gap": (lambda: col("open") / col("pc") - 1, "open / pc - 1"), "f_ret2": (lambda: T.ret(2), "close / lag(close, 2) OVER w - 1"), "f_ret3": (lambda: T.ret(3), "close / lag(close, 3) OVER w - 1"), "f_accel": (lambda: col("r1") - T.lag("r1"), "r1 - lag(r1) OVER w"), "f_dvol": (lambda: col("quote_volume") / T.lag("quote_volume") - 1, "quote_volume / lag(quote_volume) OVER w - 1")}),
    "eff_jump_dv": (H, {"eff_24h": (lambda: T.efficiency(24), _clean(24, "r1", "abs(close / lag(close, 24) OVER w - 1) / (sum(abs(r1)) OVER w24 + 1e-12)")), "jump_24h": (lambda: T.clean(24, "r1", T.agg(F.max, F.abs("r1"), 24)), _clean(24, "r1", "max(abs(r1)) OVER w24")), "dv_24h": (lambda: T.clean(24, "quote_volume", T.agg(F.sum, "quote_volume", 24)), _clean(24, "quote_volume", "sum(quote_volume) OVER w24"))}),
    "vol_concentration": (H, {"vol_concentration": (lambda: T.clean(24, "quote_volume", T.agg(F.max, "quote_volume", 24) / T.agg(F.sum, "quote_volume", 24)), _clean(24, "quote_volume", "max(quote_volume) OVER w24 / sum(quote_volume) OVER w24")), "trades_24h": (lambda: T.clean(24, "trades", T.agg(F.sum, "trades", 24)), _clean(24, "trades", "sum(trades) OVER w24"))}),
    "zscore_n": (H, {"volume_z_60": (lambda: T.zscore(60, "quote_volume"), _clean(60, "quote_volume", "(quote_volume - avg(quote_volume) OVER w60) / (stddev_pop(quote_volume) OVER w60 + 1e-12)")), "trades_z_60": (lambda: T.zscore(60, "trades"), _clean(60, "trades", "(trades - avg(trades) OVER w60) / (stddev_pop(trades) OVER w60 + 1e-12)"))}),
    "ratio_5_60": (H, {"volume_ratio_5_60": (lambda: T.full(60, T.agg(F.avg, "quote_volume", 5) / (T.agg(F.avg, "quote_volume", 60) + 1e-12)), _full(60, "avg(quote_volume) OVER w5 / (avg(quote_volume) OVER w60 + 1e-12)"))}),
    "vwap_dist": (H, {"vwap_dist_60": (lambda: T.vwap_dist(60, S.typical_price()), _full(60, "CASE WHEN sum(volume) OVER w60 > 1e-12 THEN ln(close / (sum((high + low + close) / 3 * volume) OVER w60 / sum(volume) OVER w60)) END"))}),
    "mom_k": (H, {f"mom_{k}": (lambda k=k: F.when(T.vol(60, "lr", 1.0, True) >= 1e-12, T.logret(k) / (T.vol(60, "lr", 1.0, True) * F.sqrt(F.lit(float(k))) + 1e-12)), f"CASE WHEN count(lr) OVER w60 = 60 AND stddev_pop(lr) OVER w60 >= 1e-12 THEN ln(close / lag(close, {k}) OVER w) / (stddev_pop(lr) OVER w60 * sqrt({k}.0) + 1e-12) END") for k in (5, 15, 30)}),
    "hl_range_vol_ratio": (H, {"hl_range": (lambda: (col("high") - col("low")) / col("close") / (T.vol(60, "lr", 1.0, True) + 1e-12), "(high - low) / close / (" + _clean(60, "lr", "stddev_pop(lr) OVER w60") + " + 1e-12)"), "vol_ratio_15_60": (lambda: T.vol(15, "lr", 1.0, True) / (T.vol(60, "lr", 1.0, True) + 1e-12), _clean(15, "lr", "stddev_pop(lr) OVER w15") + " / (" + _clean(60, "lr", "stddev_pop(lr) OVER w60") + " + 1e-12)")}),
    "mean_m15": (H, {"volume_m15": (lambda: T.clean(15, "volume", T.agg(F.avg, "volume", 15)), _clean(15, "volume", "avg(volume) OVER w15")), "range_m15": (lambda: T.clean(15, "tr", T.agg(F.avg, "tr", 15)), _clean(15, "tr", "avg(tr) OVER w15"))}),
    # Stand-ins for the shares that a tape and a book would give: the mean price against the high, and the close within the bar.
    "taker_depth_m15": (H, {"taker_ratio_m15": (lambda: _mean15(col("quote_volume") / (col("volume") * col("high"))), _clean(15, _TAKER, f"avg({_TAKER}) OVER w15")), "depth_imb_m15": (lambda: _mean15((2 * col("close") - col("high") - col("low")) / F.nullif(col("high") + col("low"), F.lit(0.0))), _clean(15, _DEPTH, f"avg({_DEPTH}) OVER w15"))}),
    "funding_x_mom": (H, {"funding_x_mom": (lambda: col("quote_volume") / 1e4 * F.signum(T.ret(15)), "quote_volume / 1e4 * sign(close / lag(close, 15) OVER w - 1)")}),
    "oi_change_60": (H, {"oi_change_60": (lambda: T.full(61, F.when((col("quote_volume") > 0) & (T.lag("quote_volume", 60) > 0), F.log(col("quote_volume") / T.lag("quote_volume", 60)))), _full(61, "CASE WHEN quote_volume > 0 AND lag(quote_volume, 60) OVER w > 0 THEN ln(quote_volume / lag(quote_volume, 60) OVER w) END"))}),
    "trend_votes": (D, {"trend_votes": (lambda: T.full(252, (F.signum(col("close") / T.agg(F.avg, "close", 50) - 1) + F.signum(T.agg(F.avg, "close", 50) / T.agg(F.avg, "close", 200) - 1) + F.signum(T.ret(63)) + F.signum(T.ret(126)) + F.signum(T.ret(251))) / 5), _full(252, "(sign(close / avg(close) OVER w50 - 1) + sign(avg(close) OVER w50 / avg(close) OVER w200 - 1) + sign(close / lag(close, 63) OVER w - 1) + sign(close / lag(close, 126) OVER w - 1) + sign(close / lag(close, 251) OVER w - 1)) / 5"))}),
    "global_risk": (D, {"es_ret_5": (lambda: T.ret(5), "close / lag(close, 5) OVER w - 1"), "es_vol_20": (lambda: T.vol(20, "r1", 252.0), _clean(20, "r1", "stddev_samp(r1) OVER w20 * sqrt(252.0)")), "es_max_drawdown_126": (lambda: T.max_drawdown(126), _drawdown(126))}),
    "micro_equity": (D, {"log_median_trades_20": (lambda: T.at_least(10, 20, "trades", F.log(T.median(20, "trades"))), "CASE WHEN count(trades) OVER w20 >= 10 THEN ln(median(trades) OVER w20) END"), "trades_surge_20": (lambda: T.surprise("trades"), "CASE WHEN count(trades) OVER w20 >= 10 THEN trades / median(trades) OVER w20 END"), "close_vs_average": (lambda: col("close") / (col("quote_volume") / col("trades")) - 1, "close / (quote_volume / trades) - 1")}),
    "borrow_features": (D, {"fee_median_20": (lambda: T.at_least(10, 20, "tr", T.median(20, "tr")), "CASE WHEN count(tr) OVER w20 >= 10 THEN median(tr) OVER w20 END"), "fee_change_5": (lambda: col("tr") - T.lag("tr", 5), "tr - lag(tr, 5) OVER w"), "fee_change_20": (lambda: col("tr") - T.lag("tr", 20), "tr - lag(tr, 20) OVER w"), "fee_max_20": (lambda: T.at_least(10, 20, "tr", T.agg(F.max, "tr", 20)), "CASE WHEN count(tr) OVER w20 >= 10 THEN max(tr) OVER w20 END")}),
    "running_drawdown": (D, {"peak": (lambda: F.max("close").over(T.upto), "max(close) OVER u"), "drawdown": (lambda: col("close") / F.max("close").over(T.upto) - 1, "close / max(close) OVER u - 1")}),
    "cumulative_series": (D, {"running": (lambda: F.sum("quote_volume").over(T.upto), "sum(quote_volume) OVER u")}),
    "factor_return_n": (D, {"factor_20": (lambda: T.clean(20, "r1", F.exp(T.agg(F.sum, F.log1p("r1"), 20)) - 1), _clean(20, "r1", "exp(sum(ln(1 + r1)) OVER w20) - 1"))}),
    "breakout_age": (D, {"breakout_age": (lambda: T.run_length(col("close") > col("open")), "CASE WHEN close > open THEN idx - coalesce(max(CASE WHEN NOT close > open THEN idx END) OVER u, 0) END")}),
    "candle_shape": (H, {"body_frac": (S.body_fraction, "abs(close - open) / (high - low + 1e-12)"), "upper_wick_frac": (S.upper_wick, "(high - greatest(open, close)) / (high - low + 1e-12)"), "lower_wick_frac": (S.lower_wick, "(least(open, close) - low) / (high - low + 1e-12)"), "clv": (S.close_location, "CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END"), "clv_signed": (lambda: S.close_location(True), "CASE WHEN high = low THEN 0.0 ELSE (2 * close - high - low) / (high - low) END")}),
    "typical_price_true_range": (H, {"typical": (S.typical_price, "(high + low + close) / 3"), "true_range": (S.true_range, "tr")}),
    "tod_encoding": (H, {"tod_sin": (lambda: S.tod_sin("ts"), "sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)"), "tod_cos": (lambda: S.tod_cos("ts"), "cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)"), "dow": (lambda: F.weekday("ts").cast("double"), "(isodow(ts) - 1)::DOUBLE")}),
    "adjusted_open": (D, {"adjusted_open": (lambda: S.adjusted_open("open", col("close") * 0.5, "close"), "open * (close * 0.5) / close")}),
    "depth_features": (H, {"depth_imb": (lambda: (col("high") - col("low")) / (col("high") + col("low") + 1e-12), "(high - low) / (high + low + 1e-12)"), "depth_log": (lambda: F.log(col("high") + col("low") + 1e-12), "ln(high + low + 1e-12)")}),
    "spread_bps": (H, {"spread_bps": (lambda: S.spread_bps("low", "high"), "CASE WHEN low > 0 AND high >= low THEN (high - low) / ((low + high) / 2) * 1e4 END")}),
    "safe_ratio_growth": (H, {"ratio": (lambda: S.safe_ratio(col("high") - col("low"), col("close") - col("open")), "CASE WHEN close - open <> 0 THEN (high - low) / (close - open) END"), "growth": (lambda: S.growth("close", "pc"), "(close - pc) / abs(pc)"), "vote": (lambda: S.sign3(col("close") - col("open")).cast("double"), "sign(close - open)::DOUBLE"), "finite": (lambda: S.finite_or_null(F.try_divide(F.lit(1.0), col("trades") - 1)), "CASE WHEN trades <> 1 THEN 1.0 / (trades - 1) END")}),
    "lookahead_diagnostic": (D, {"future_volume_7": (lambda: F.sum("quote_volume").over(T.all.rowsBetween(1, 7)), "sum(quote_volume) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)")}),
}


def _register(name, view, columns):
    @register(name, base.select_sql(view, {k: s for k, (_, s) in columns.items()}, base.HB if view == H else base.DB))
    def query(spark, sf_dir):
        bars = base.hourly_basics(spark, sf_dir) if view == H else base.daily_basics(spark, sf_dir)
        return bars.select("asset", "ts", *base.rounded({k: f() for k, (f, _) in columns.items()}))


for _name, (_view, _columns) in FEATURES.items():
    _register(_name, _view, _columns)
