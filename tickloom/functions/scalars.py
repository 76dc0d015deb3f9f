"""Column functions on one row: null rules, prices, calendars, parsing of locale text.

A null or non-finite input gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, as the texts that are read write them.
MONTHS_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS_SV = ["januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december"]


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_or_null(x) -> Column:
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_ratio(a, b) -> Column:
    """a / b; null where b is zero or the result is not finite."""
    return finite_or_null(F.when(c(b) != 0, c(a) / c(b)))


def float_ratio(a, b) -> Column:
    """a / b of doubles by IEEE rules: over zero it is infinite with a's sign, and not a number where a is zero too."""
    a, b = c(a), c(b)
    inf = F.lit(float("inf"))
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, inf).when(a < 0, -inf)).otherwise(F.try_divide(a, b))


def growth(current, prior) -> Column:
    """(current - prior) / |prior|."""
    return safe_ratio(c(current) - c(prior), F.abs(c(prior)))


def sign3(x) -> Column:
    return F.signum(c(x)).cast("int")


def typical_price(high="high", low="low", close="close") -> Column:
    return (c(high) + c(low) + c(close)) / 3


def true_range(high="high", low="low", prior="pc") -> Column:
    """Largest of the bar's range and its distances from the prior close; a first bar has its range."""
    return F.greatest(c(high) - c(low), F.coalesce(F.abs(c(high) - c(prior)), c(high) - c(low)), F.coalesce(F.abs(c(low) - c(prior)), c(high) - c(low)))


def body_fraction(eps: float = 1e-12) -> Column:
    return F.abs(c("close") - c("open")) / (c("high") - c("low") + eps)


def upper_wick(eps: float = 1e-12) -> Column:
    return (c("high") - F.greatest("open", "close")) / (c("high") - c("low") + eps)


def lower_wick(eps: float = 1e-12) -> Column:
    return (F.least("open", "close") - c("low")) / (c("high") - c("low") + eps)


def close_location(signed: bool = False) -> Column:
    """Where the close stands in the bar: 0 to 1 (0.5 if flat), or -1 to 1 (0 if flat)."""
    span = c("high") - c("low")
    if signed:
        return F.when(span == 0, 0.0).otherwise((2 * c("close") - c("high") - c("low")) / span)
    return F.when(span == 0, 0.5).otherwise((c("close") - c("low")) / span)


def adjusted_open(raw_open, adjusted_close, raw_close) -> Column:
    return safe_ratio(c(raw_open) * c(adjusted_close), raw_close)


def minute_of_day(ts) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def tod_sin(ts) -> Column:
    return F.sin(2 * F.pi() * minute_of_day(ts) / 1440)


def tod_cos(ts) -> Column:
    return F.cos(2 * F.pi() * minute_of_day(ts) / 1440)


def spread_bps(bid, ask) -> Column:
    """(ask - bid) / mid in basis points; null for a crossed or non-positive quote."""
    mid = (c(bid) + c(ask)) / 2
    return F.when((c(bid) > 0) & (c(ask) >= c(bid)), (c(ask) - c(bid)) / mid * 1e4)


def exchange_time(ts, zone: str = "America/New_York") -> Column:
    """Local wall time of a UTC instant."""
    return F.from_utc_timestamp(ts, zone)


def session_date(local) -> Column:
    """The session of a local time: the evening from 18:00 belongs to the next day."""
    return (c(local) + F.expr("INTERVAL 6 HOURS")).cast("date")


def session_segment(local) -> Column:
    """'rth' from 09:30 to 16:15, 'overnight' before it, 'post' after it."""
    m = minute_of_day(local)
    return F.when((m >= 570) & (m < 975), "rth").when((m >= 1080) | (m < 570), "overnight").otherwise("post")


def market_open(local) -> Column:
    """Closed on Saturday, until 18:00 on Sunday, from 17:00 on Friday, and from 17:00 to 18:00 each day."""
    d, h = F.weekday(local), F.hour(local)
    return ~((d == 5) | ((d == 6) & (h < 18)) | ((d == 4) & (h >= 17)) | (h == 17))


def local_close_date(ts, interval_s: int, zone: str = "Europe/Stockholm", close_minute: int = 17 * 60 + 30) -> Column:
    """The local date of a bar that is complete by the local close, else null."""
    end = F.from_utc_timestamp(c(ts) + F.expr(f"INTERVAL {interval_s} SECONDS"), zone)
    seconds = F.hour(end) * 3600 + F.minute(end) * 60 + F.second(end)
    return F.when((seconds <= close_minute * 60) & (end.cast("date") == F.from_utc_timestamp(ts, zone).cast("date")), end.cast("date"))


def isin_valid(x) -> Column:
    """Two letters, nine letters or digits, a check digit, and the Luhn sum over letters as numbers."""
    x = c(x)
    chars = F.filter(F.split(x, ""), lambda s: s != "")
    numbers = F.array_join(F.transform(chars, lambda s: F.when(s.rlike("[0-9]"), s).otherwise((F.ascii(s) - 55).cast("string"))), "")
    digits = F.transform(F.filter(F.split(F.reverse(numbers), ""), lambda s: s != ""), lambda s: s.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.coalesce(x.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0), F.lit(False))


def issuer_key(name, legal: list[str], share: list[str]) -> Column:
    """Lower-case words of a name without legal forms, and without share-class words at the end."""
    words = F.filter(F.split(F.lower(c(name)), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(legal))
    joined = F.array_join(words, " ")
    return F.trim(F.regexp_replace(joined, r"( (" + "|".join(share) + r"))+$", ""))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: later uses refer to a variable, not to a copy of the expression."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def parse_number(text) -> Column:
    """A number as written in any locale: spaces and thin spaces group, the last comma or point is the decimal mark."""
    plain = F.translate(F.regexp_replace(c(text), r"[\s\u00a0\u2009\u202f%]", ""), "\u2212", "-")

    def read(s):
        after = lambda mark: F.length(s) - F.locate(mark, F.reverse(s))
        decimal_comma = s.contains(",") & (~s.contains(".") | (after(",") > after(".")))
        return F.when(decimal_comma, F.translate(s, ",.", ".")).otherwise(F.replace(s, F.lit(","), F.lit("")))

    return bound(bound(plain, read), lambda s: F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), s.cast("double")))


def parse_date_text(text) -> Column:
    """The first '12 March 2024', else 'March 12, 2024', '12 mars 2024' or '12/03/2024' (day first) as a date; null without one that exists."""
    t = F.lower(c(text))
    names = "|".join([*MONTHS_EN, *MONTHS_SV])
    day_first, month_first, slashed = rf"(\d{{1,2}})\s+({names})\s+(\d{{4}})", rf"({names})\s+(\d{{1,2}}),?\s+(\d{{4}})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
    place = lambda name: F.greatest(*(F.array_position(F.array(*map(F.lit, m)), name) for m in (MONTHS_EN, MONTHS_SV))).cast("string")
    part = lambda p, i: F.regexp_extract(t, p, i)
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(
        F.when(t.rlike(day_first), made(part(day_first, 3), place(part(day_first, 2)), part(day_first, 1))),
        F.when(t.rlike(month_first), made(part(month_first, 3), place(part(month_first, 1)), part(month_first, 2))),
        F.when(t.rlike(slashed), made(part(slashed, 3), part(slashed, 2), part(slashed, 1))),
    )


def classify_text(text, ladder: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first pattern that a lower-cased text matches."""
    t, out = F.lower(c(text)), F.lit(other)
    for kind, pattern in reversed(ladder):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def normalize_text(text) -> Column:
    """Runs of white space within lines become one space; blank lines go."""
    t = F.regexp_replace(c(text), r"[ \t\x0b\f\r]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit(" \n"))


def pair_values(text, label: str) -> tuple[Column, Column]:
    """Current and prior value of 'label ... current (prior)'."""
    pattern = rf"(?i)(?:{label})[^0-9\n-]{{0,40}}(-?[0-9][0-9 ]*(?:[.,][0-9]+)?)\s*\((-?[0-9][0-9 ]*(?:[.,][0-9]+)?)\)"
    get = lambda i: parse_number(F.nullif(F.regexp_extract(c(text), pattern, i), F.lit("")))
    return get(1), get(2)


def signed_direction(nature, qualifies) -> Column:
    """+1 for an acquisition, -1 for a disposal, null unless the row qualifies."""
    n = F.lower(c(nature))
    return F.when(qualifies, F.when(n.contains("acqui"), 1).when(n.contains("dispos"), -1))


def quantize(x, places: int) -> Column:
    """Half-even rounding of an exact decimal."""
    return F.bround(c(x).cast("decimal(28,10)"), places).cast(f"decimal(28,{places})")


def on_grid(x, step: str) -> Column:
    """Whether an exact decimal is a multiple of ``step``."""
    return c(x).cast("decimal(28,10)") % F.lit(step).cast("decimal(28,10)") == 0


def epoch_timestamp(v) -> Column:
    """Seconds, milliseconds or microseconds since 1970 by magnitude; null out of range."""
    v = c(v)
    return F.when(v >= 10**17, None).when(v >= 10**14, F.timestamp_micros(v)).when(v >= 10**11, F.timestamp_millis(v)).when(v >= 10**8, F.timestamp_seconds(v))


def venue_symbol(asset, denied: list[str]) -> Column:
    """'kX' trades as '1000XUSDT', 'X' as 'XUSDT'; denied assets have none."""
    a = c(asset)
    return F.when(a.isin(denied), None).when(a.rlike("^k[A-Z0-9]+$"), F.concat(F.lit("1000"), F.substr(a, F.lit(2)), F.lit("USDT"))).otherwise(F.concat(a, F.lit("USDT")))


def canonical(asset) -> Column:
    return c(asset).rlike("^[A-Z0-9]{1,20}$")


def leveraged(asset) -> Column:
    a = c(asset)
    return a.endswith("UP") | a.endswith("DOWN") | a.endswith("BEAR") | a.endswith("BULL")
