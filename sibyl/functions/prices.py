"""Price and probability functions (P01-P26) as Column builders: no UDF, so they fold, prune and generate code.

Prices are American odds. An invalid price (null, or between -99 and 99) gives null, never a guess.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import norm_cdf, norm_ppf  # noqa: F401  (P20)

#: Line and total limits beyond which a quoted number is a mistake.
MAX_SPREAD, MIN_TOTAL, MAX_TOTAL = 60.0, 100.0, 400.0
#: Price bands (rungs): label and closed bounds; none lies inside +-100.
RUNGS = (
    ("-1000 or less", -1e9, -1000), ("-999 to -400", -999, -400), ("-399 to -200", -399, -200), ("-199 to -100", -199, -100),
    ("+100 to +199", 100, 199), ("+200 to +399", 200, 399), ("+400 to +999", 400, 999), ("+1000 or more", 1000, 1e9),
)


def implied(ml: Column) -> Column:
    """Implied probability."""
    ml = ml.cast("double")
    return F.when(ml >= 100, 100 / (ml + 100)).when(ml <= -100, -ml / (-ml + 100))


def decimal_payout(ml: Column) -> Column:
    """What one unit returns on a win, stake included."""
    ml = ml.cast("double")
    return F.when(ml >= 100, 1 + ml / 100).when(ml <= -100, 1 + 100 / -ml)


def devig(home_ml: Column, away_ml: Column) -> Column:
    """Proportional no-vig probability of the home side."""
    ih, ia = implied(home_ml), implied(away_ml)
    return ih / (ih + ia)


def hold(home_ml: Column, away_ml: Column) -> Column:
    """Overround of a pair."""
    return implied(home_ml) + implied(away_ml) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: an element of an array has a name, which the optimizer does not replace by its expression."""
    return F.transform(F.array(value), use)[0]


def _bisect(lo: float, hi: float, above: Callable[[Column], Column], steps: int = 60) -> Column:
    """Root of a decreasing test by halving: above(x) is true left of the root."""
    zero = F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        at = F.struct(((s["lo"] + s["hi"]) / 2).alias("mid"), s["lo"].alias("lo"), s["hi"].alias("hi"))
        return _bound(at, lambda m: F.when(above(m["mid"]), F.struct(m["mid"].alias("lo"), m["hi"].alias("hi"))).otherwise(F.struct(m["lo"].alias("lo"), m["mid"].alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def _shares(home_ml: Column, away_ml: Column) -> Column:
    """Implied probabilities h and a of a pair and their total."""
    ih, ia = implied(home_ml), implied(away_ml)
    return F.struct(ih.alias("h"), ia.alias("a"), (ih + ia).alias("total"))


def power_devig(home_ml: Column, away_ml: Column) -> Column:
    """Home probability ih^k with k so that both sides sum to 1."""

    def solved(i: Column) -> Column:
        k = _bisect(0.2, 8.0, lambda x: F.pow(i["h"], x) + F.pow(i["a"], x) > 1)
        return F.when(i["total"].isNotNull(), F.pow(i["h"], k))

    return _bound(_shares(home_ml, away_ml), solved)


def shin_devig(home_ml: Column, away_ml: Column) -> Column:
    """Home probability under Shin's insider share z; pairs without a hold fall back to P02."""

    def side(i: Column, total: Column, z: Column) -> Column:
        return (F.sqrt(z * z + 4 * (1 - z) * i * i / total) - z) / (2 * (1 - z))

    def solved(i: Column) -> Column:
        z = _bisect(0.0, 0.5, lambda x: side(i["h"], i["total"], x) + side(i["a"], i["total"], x) > 1)
        return F.when(i["total"] <= 1, i["h"] / i["total"]).when(i["total"] > 1, _bound(z, lambda x: side(i["h"], i["total"], x)))

    return _bound(_shares(home_ml, away_ml), solved)


def unit_profit(ml: Column, won: Column) -> Column:
    """Profit of one unit; null on an invalid price or an unknown result."""
    return F.when(won, decimal_payout(ml) - 1).when(~won, F.when(decimal_payout(ml).isNotNull(), F.lit(-1.0)))


def american_from_prob(p: Column) -> Column:
    """Fair price, rounded half to even."""
    return F.when((p <= 0) | (p >= 1), F.lit(None)).when(p >= 0.5, -F.bround(100 * p / (1 - p))).otherwise(F.bround(100 * (1 - p) / p))


def exchange_fee(ask: Column, rate: float = 0.07) -> Column:
    """Taker fee of one contract."""
    return rate * ask * (1 - ask)


def exchange_cost(ask: Column, rate: float = 0.07) -> Column:
    """Ask and taker fee."""
    return F.when((ask > 0) & (ask < 1), ask + exchange_fee(ask, rate))


def ats_result(margin: Column, line: Column, tolerance: float = 0.0) -> Column:
    """1 covers, 0 does not, 0.5 pushes (within the tolerance)."""
    x = margin + line
    return F.when(F.abs(x) <= tolerance, 0.5).when(x > 0, 1.0).when(x < 0, 0.0)


def ladder_rung(ml: Column, rungs: Sequence[tuple[str, float, float]] = RUNGS) -> Column:
    """Label of the closed band that holds the price; null in the gap."""
    out = F.lit(None).cast("string")
    for label, lo, hi in rungs:
        out = F.when(ml.between(lo, hi), label).otherwise(out)
    return out


def band(value: Column, bounds: Sequence[float]) -> Column:
    """P10: index of the lower-inclusive band; the last band holds its upper end too; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        upper = value <= bounds[i + 1] if i == len(bounds) - 2 else value < bounds[i + 1]
        out = F.when((value >= bounds[i]) & upper, i).otherwise(out)
    return out


def parse_american(text: Column) -> Column:
    """P11: '+120', '-110', 'EVEN'; null if no valid price."""
    t = F.upper(F.trim(text))
    v = F.when(t.isin("EVEN", "EV"), F.lit(100.0)).otherwise(F.regexp_replace(t, r"^\+", "").try_cast("double"))
    return F.when(F.abs(v) >= 100, v)


def parse_line(text: Column) -> Column:
    """P11: 'PK' is 0; beyond the plausible limit null."""
    t = F.upper(F.trim(text))
    v = F.when(t.isin("PK", "PICK", "EVEN"), F.lit(0.0)).otherwise(F.regexp_replace(t, r"^\+", "").try_cast("double"))
    return F.when(F.abs(v) <= MAX_SPREAD, v)


def parse_total(text: Column) -> Column:
    """Totals outside the plausible range are null."""
    v = F.regexp_replace(F.upper(F.trim(text)), r"^[OU]\s*", "").try_cast("double")
    return F.when(v.between(MIN_TOTAL, MAX_TOTAL), v)


def home_spread(home: Column, away: Column) -> Column:
    """One spread from both sides; null if they contradict each other."""
    return F.when(F.abs(home + away) > 1e-9, F.lit(None)).otherwise(F.coalesce(home, -away))


def main_line(a: Column, b: Column, lo: float = -135, hi: float = 115) -> Column:
    """Whether both prices of a line are near even."""
    return F.coalesce(a.between(lo, hi) & b.between(lo, hi), F.lit(False))


def pick_book(books: Column, preference: Sequence[str], own: Column | None = None) -> Column:
    """First struct (book, home, away) with a full pair, by preference; the row's own book first if given."""
    names = ([own] if own is not None else []) + [F.lit(x) for x in preference]
    return F.coalesce(*(F.try_element_at(_full_pair(books, n), F.lit(1)) for n in names))


def _full_pair(books: Column, name: Column) -> Column:
    return F.filter(books, lambda b: (b["book"] == name) & b["home"].isNotNull() & b["away"].isNotNull())


def mid_q(home_bid: Column, home_ask: Column, away_bid: Column, away_ask: Column) -> Column:
    """The home side's part of the two midpoints; null unless both sides have a bid and an ask."""
    home, away = (home_bid + home_ask) / 2, (away_bid + away_ask) / 2
    return F.when((home > 0) & (away > 0), home / (home + away))


def quoted_q(home_bid: Column, home_ask: Column, away_bid: Column, away_ask: Column) -> Column:
    """mid_q, else the home side's part of the two costs; null unless both sides have a usable ask."""
    home, away = exchange_cost(home_ask), exchange_cost(away_ask)
    return F.when(home.isNotNull() & away.isNotNull(), F.coalesce(mid_q(home_bid, home_ask, away_bid, away_ask), home / (home + away)))


def price_q(stored: Column, home_ml: Column, away_ml: Column, method: Callable[[Column, Column], Column] = devig) -> Column:
    """The stored no-vig probability, else one from the pair by any no-vig function."""
    return F.coalesce(stored, method(home_ml, away_ml))


def logit(p: Column, clip: float = 1e-6) -> Column:
    """Log odds, clipped."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.when(p.isNotNull(), F.ln(q / (1 - q)))


def shrink_p(p: Column, q: Column, w: float | Column, clip: float = 1e-6) -> Column:
    """P pulled toward q in log odds; w is the weight of p."""
    return 1 / (1 + F.exp(-(logit(q, clip) + w * (logit(p, clip) - logit(q, clip)))))


def brier(p: Column, y: Column) -> Column:
    """P19."""
    return (p - y) * (p - y)


def log_loss(p: Column, y: Column, clip: float | None = 1e-6) -> Column:
    """Clipped, or (clip None) infinite where a certainty is contradicted."""
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p)) if clip else p
    hit = F.when(y == 1, q).when(y == 0, 1 - q)
    return F.when(hit == 0, F.lit(float("inf"))).when(hit > 0, -F.ln(hit))


def lean_is_home(lean: Column, home: Column, away: Column, p: Column) -> Column:
    """The recorded side if it names a team, else p >= 0.5 (ties go home)."""
    return F.when(lean == home, True).when(lean == away, False).otherwise(p >= 0.5)


def position(p: Column, home_ml: Column, away_ml: Column) -> Column:
    """Side of positive and larger expected value, home on ties, null if neither is positive."""
    eh = p * decimal_payout(home_ml) - 1
    ea = (1 - p) * decimal_payout(away_ml) - 1
    return F.when((eh > 0) & (eh >= F.coalesce(ea, F.lit(float("-inf")))), "home").when(ea > 0, "away")


def weighted_points(stats: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum; null if any part is missing."""
    total = F.lit(0.0)
    for s, w in zip(stats, weights, strict=True):
        total = total + s * w
    return total


def mean_projection(points: Column, minutes: Column, rate: Column) -> Column:
    """Mean of two sources; the first alone without a rate."""
    return F.when(rate.isNotNull(), (points + rate * minutes) / 2).otherwise(points)


def lognormal_moments(mean: Column, variance: Column, play: Column) -> tuple[Column, Column]:
    """P25: parameters (mu, sigma) of a lognormal that, with chance `play` and 0 otherwise, has the moments given; at a mean of 0 their limits, mu
    of minus infinity and sigma infinite, 0 without a variance."""
    m = mean / play
    v = F.greatest(F.lit(0.0), (variance + mean * mean) / play - m * m)
    s2 = F.log1p(F.when(m == 0, F.when(v > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(v / F.nullif(m * m, F.lit(0.0))))
    return F.when(m == 0, F.lit(float("-inf"))).otherwise(F.ln(m)) - s2 / 2, F.sqrt(s2)


def mapped(code: Column, pairs: dict[str, str]) -> Column:
    """Code translation that passes unknown codes through."""
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)
