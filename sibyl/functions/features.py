"""Feature formulas (E01-E20): row-wise Columns over already aggregated totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normal import norm_cdf
from .prices import shrink_p
from .scalars import dot, interpolate, season_phase

#: Totals of one side: field goals and attempts, threes and attempts, free throws and attempts, rebounds at both ends, turnovers.
SIDE = ("fgm", "fga", "tpm", "tpa", "ftm", "fta", "orb", "drb", "tov")
# Fixed values of the possession estimate and of win shares.
FREE_THROW_WEIGHT, REBOUND_WEIGHT = 0.4, 1.07
ASSIST_WEIGHT, OFFENCE_SHARE, DEFENCE_SHARE, POINTS_PER_WIN = 1.14, 0.92, 1.08, 0.32


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def possessions(t: Column, o: Column) -> Column:
    """Possessions of one side from structs of its totals and its opponent's."""
    rebounded = REBOUND_WEIGHT * ratio(t["orb"], t["orb"] + o["drb"]) * (t["fga"] - t["fgm"])
    return t["fga"] + FREE_THROW_WEIGHT * t["fta"] - rebounded + t["tov"]


def mean_possessions(own: Column, opp: Column) -> Column:
    """Both sides averaged."""
    return (possessions(own, opp) + possessions(opp, own)) / 2


def eight_factors(own: Column, opp: Column, rebound_share: bool = False) -> Column:
    """Effective field goals, turnovers, offensive rebounds and free throw attempts of a team and of its opponents, in percent, with
    the sign of what they are worth to the team. Turnovers and rebounds are per possession; with rebound_share the latter are the share
    of the rebounds that were there to take."""
    p = mean_possessions(own, opp)

    def four(a: Column, b: Column) -> list[Column]:
        rebounds = ratio(a["orb"], a["orb"] + b["drb"] if rebound_share else p)
        return [ratio(a["fgm"] + 0.5 * a["tpm"], a["fga"]), ratio(a["tov"], p), rebounds, ratio(a["fta"], a["fga"])]

    signs = (1, -1, 1, 1, -1, 1, -1, -1)
    return F.array(*(100 * k * x for k, x in zip(signs, four(own, opp) + four(opp, own), strict=True)))


def regress_threes(t: Column, rate: Column) -> Column:
    """Totals with threes made at a league rate; field goals move with them."""
    made = t["tpa"] * rate
    return t.withField("fgm", t["fgm"] + made - t["tpm"]).withField("tpm", made)


def luck(own: Column, opp: Column, rate: Column, weights: Column, rebound_share: bool = False) -> Column:
    """Rise of the composite if the opponents' threes had gone in at the league's rate. weights: of each factor, over its deviation."""
    return dot(eight_factors(own, regress_threes(opp, rate), rebound_share), weights) - dot(eight_factors(own, opp, rebound_share), weights)


def game_inputs(delta: Column, home_rest: Column, away_rest: Column, date: Column, opening: Column) -> list[Column]:
    """Delta, back-to-back difference, phase, delta by phase."""
    net = (away_rest == 0).cast("double") - (home_rest == 0).cast("double")
    phase = season_phase(date, opening)
    return [delta.alias("delta"), net.alias("b2b_net"), phase.alias("phase"), (delta * phase).alias("delta_phase")]


def neutral_fill(df: DataFrame, optional: Sequence[str]) -> DataFrame:
    """Optional terms that are null or NaN become 0, with a flag; core terms stay as they are."""
    missing = F.lit(False)
    for c in optional:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    return df.withColumn("changed", missing).withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) for c in optional})


def predict(features: Column, coef: Column, intercept: Column, sigma: Column | None = None) -> Column:
    """Linear predictor through a logistic link, or through the normal one if sigma is given."""
    eta = dot(features, coef) + intercept
    return norm_cdf(eta / sigma) if sigma is not None else 1 / (1 + F.exp(-eta))


def route(report: Column, base: Column, filled: Column, tag: str) -> Column:
    """The report route if it has a forecast, else the base route, else the neutral fill, else none; with its tag."""
    pick = lambda p, name: F.struct(p.alias("p"), F.lit(name).alias("route"), F.lit(f"{name}_{tag}").alias("tag"))
    return F.when(report.isNotNull(), pick(report, "report")).when(base.isNotNull(), pick(base, "base")).when(filled.isNotNull(), pick(filled, "neutral")).otherwise(pick(F.lit(None).cast("double"), "abstain"))


def p_over(total: Column, line: Column, played: Column, early: float, late: float, few: int = 10) -> Column:
    """Chance that a total passes a line; sigma by stage."""
    return norm_cdf((total - line) / F.when(played < few, early).otherwise(late))


#: Share of regulation that an overtime lasts: a tie at the end is priced at its start.
OVERTIME = 300 / 2880


def _settled(lead: Column, share_left: Column, price) -> Column:
    over = share_left <= 0
    return F.when(over & (lead != 0), (lead > 0).cast("double")).otherwise(price(F.when(over, F.lit(OVERTIME)).otherwise(share_left)))


def live_win(lead: Column, margin: Column, share_left: Column, knots: Sequence[float], a: Column, b: Column) -> Column:
    """Chance to win from lead and expected margin with coefficients that depend on the time left; settled at the end."""
    return _settled(lead, share_left, lambda t: norm_cdf(interpolate(t, knots, a) * lead / F.sqrt(t) + interpolate(t, knots, b) * margin * F.sqrt(t)))


def brownian_win(lead: Column, margin: Column, share_left: Column, sigma: float) -> Column:
    """Brownian motion with drift: expected rest margin * tau, variance sigma^2 * tau."""
    return _settled(lead, share_left, lambda t: norm_cdf((lead + margin * t) / (sigma * F.sqrt(t))))


def win_shares(df: DataFrame, player: str, team: str, opponent: str, league: str) -> DataFrame:
    """Df with offensive and defensive win shares, from struct columns of player, team and opponent totals (SIDE with pts, minutes,
    ast, stl, blk, pf) and of the league's pts, poss, minutes and games, by the published formulas: points produced over marginal points
    for each win, and individual defensive rating. In steps, so that terms used often are computed once."""
    p, t, o, l, w = (F.col(c) for c in (player, team, opponent, league, "_w"))
    free = lambda x: 1 - (1 - ratio(x["ftm"], x["fta"])) * (1 - ratio(x["ftm"], x["fta"]))  # noqa: E731  (trips that score)
    part = lambda c: ratio(t[c], t["minutes"]) * p["minutes"] * 5 - p[c]
    step = lambda d, **terms: d.withColumn("_w", F.struct(*(["_w.*"] if "_w" in d.columns else []), *(x.alias(n) for n, x in terms.items())))
    out = step(
        df, share=ratio(p["minutes"], t["minutes"] / 5), mates=0.5 * ratio((t["pts"] - t["ftm"]) - (p["pts"] - p["ftm"]), 2 * (t["fga"] - p["fga"])) * p["ast"],
        line=F.when(p["fta"] > 0, FREE_THROW_WEIGHT * p["fta"]).otherwise(0.0), scored=free(p), scoring=t["fgm"] + free(t) * t["fta"] * FREE_THROW_WEIGHT, poss=mean_possessions(t, o),
        rebounding=ratio(t["orb"], t["orb"] + o["drb"]), boards=ratio(o["orb"], o["orb"] + t["drb"]), goals=ratio(o["fgm"], o["fga"]), each=l["pts"] / l["poss"],
    )
    out = step(
        out, play=ratio(w["scoring"], t["fga"] + t["fta"] * FREE_THROW_WEIGHT + t["tov"]), forced=ratio(w["goals"] * (1 - w["boards"]), w["goals"] * (1 - w["boards"]) + (1 - w["goals"]) * w["boards"]),
        assisted=w["share"] * ASSIST_WEIGHT * ratio(t["ast"] - p["ast"], t["fgm"]) + ratio(part("ast"), part("fgm")) * (1 - w["share"]), live=1 - REBOUND_WEIGHT * w["boards"],
        per_win=POINTS_PER_WIN * l["pts"] / l["games"] * ratio(48 * ratio(2 * w["poss"], 2 * (t["minutes"] / 5)), 48 * l["poss"] / (l["minutes"] / 5)),
    )
    out = step(
        out, weight=ratio((1 - w["rebounding"]) * w["play"], (1 - w["rebounding"]) * w["play"] + w["rebounding"] * (1 - w["play"])), shooting=1 - 0.5 * ratio(p["pts"] - p["ftm"], 2 * p["fga"]) * w["assisted"],
        own_stops=p["stl"] + p["blk"] * w["forced"] * w["live"] + p["drb"] * (1 - w["forced"]),
        shared_stops=(ratio(o["fga"] - o["fgm"] - t["blk"], t["minutes"]) * w["forced"] * w["live"] + ratio(o["tov"] - t["stl"], t["minutes"])) * p["minutes"]
        + ratio(p["pf"], t["pf"]) * FREE_THROW_WEIGHT * o["fta"] * (1 - ratio(o["ftm"], o["fta"])) * (1 - ratio(o["ftm"], o["fta"])),
    )
    out = step(out, keep=1 - ratio(t["orb"], w["scoring"]) * w["weight"] * w["play"], own_boards=p["orb"] * w["weight"] * w["play"], stops=ratio((w["own_stops"] + w["shared_stops"]) * o["minutes"], w["poss"] * p["minutes"]), rating=100 * ratio(o["pts"], w["poss"]))
    made = t["fgm"] - p["fgm"]
    used = (p["fgm"] * w["shooting"] + w["mates"] + w["scored"] * w["line"]) * w["keep"] + w["own_boards"] + (p["fga"] - p["fgm"]) * (1 - REBOUND_WEIGHT * w["rebounding"]) + (1 - w["scored"]) * w["line"] + p["tov"]
    produced = (2 * (p["fgm"] + 0.5 * p["tpm"]) * w["shooting"] + 2 * ratio(made + 0.5 * (t["tpm"] - p["tpm"]), made) * w["mates"] + p["ftm"]) * w["keep"] + w["own_boards"] * ratio(t["pts"], w["scoring"])
    rating = w["rating"] + 0.2 * (100 * ratio(o["pts"], o["fgm"] + free(o) * o["fta"] * FREE_THROW_WEIGHT) * (1 - w["stops"]) - w["rating"])
    offence = ratio(produced - OFFENCE_SHARE * w["each"] * used, w["per_win"])
    defence = ratio(ratio(p["minutes"], t["minutes"]) * w["poss"] * (DEFENCE_SHARE * w["each"] - rating / 100), w["per_win"])
    return out.withColumns({"offence": offence, "defence": defence}).drop("_w")


def above_replacement(value: Column, minutes: Column, replacement: float, prior: float = 500.0) -> Column:
    """Value shrunk to the replacement level by minutes, above that level."""
    return replacement + (value - replacement) * minutes / (minutes + prior) - replacement


def rookie_value(pick: Column, a: float, b: float, replacement: float) -> Column:
    """By the logarithm of the draft pick."""
    return a + b * F.ln(pick) - replacement


def play_chance(status: Column, rates: Column | None = None) -> Column:
    """Chance to play by listed status: fixed, or from a map of fitted rates; unlisted plays."""
    fixed = F.when(status == "Out", 0.0).when(status == "Doubtful", 0.25).when(status == "Questionable", 0.5).when(status == "Probable", 0.9).otherwise(1.0)
    return fixed if rates is None else F.coalesce(F.try_element_at(rates, status), F.lit(1.0))


def halves(f: Column, w: Column) -> list[Column]:
    """Offence, defence, their sum and product from eight gaps."""
    o, d = dot(F.slice(f, 1, 4), F.slice(w, 1, 4)), dot(F.slice(f, 5, 4), F.slice(w, 5, 4))
    return [o.alias("off"), d.alias("def"), (o + d).alias("both"), (o * d).alias("cross")]


def shape_terms(delta: Column, phase: Column, late: float = 0.5) -> list[Column]:
    """Late flag, signed square and their products with the phase."""
    square = F.signum(delta) * delta * delta
    flag = (phase >= late).cast("double")
    return [flag.alias("late"), square.alias("signed_square"), (flag * delta).alias("late_delta"), (square * phase).alias("square_phase")]


def contributions(x: Column, coef: Column) -> Column:
    """Coefficient times value of each feature."""
    return F.zip_with(coef, x, lambda c, v: c * v)


def points_left(expected: Column, share_played: Column) -> Column:
    """Sum over the quarters of what is expected times the share of the quarter still to come."""
    n = F.size(expected)
    rest = F.transform(expected, lambda e, i: e * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i + 1) - share_played * n)))
    return F.aggregate(rest, F.lit(0.0), lambda a, v: a + v)


def total_features(off_h: Column, def_a: Column, off_a: Column, def_h: Column, pace: Column, phase: Column) -> list[Column]:
    """Totals from offence against defence, pace, and pace by phase."""
    return [(off_h + def_a).alias("home_side"), (off_a + def_h).alias("away_side"), pace.alias("pace"), (pace * phase).alias("pace_phase")]


def reweighted(df: DataFrame, gaps: str, weights: DataFrame, key: str) -> DataFrame:
    """Composite of stored gaps under each fold's weights (a small table keyed by fold)."""
    return df.join(F.broadcast(weights), key).withColumn("composite", dot(F.col(gaps), F.col("weights")))


def live_terms(p_model: Column, p_line: Column, share_left: Column) -> list[Column]:
    """Disagreement of model and line, alone and by time left."""
    gap = F.ln(p_model / (1 - p_model)) - F.ln(p_line / (1 - p_line))
    return [gap.alias("gap"), (gap * share_left).alias("gap_time"), shrink_p(p_model, p_line, 0.5).alias("blend")]


def star_terms(df: DataFrame, group: Sequence[str], value: str, quantile: float = 0.9, power: float = 2.0) -> DataFrame:
    """Value above the group's quantile, rank percentile and a power of it."""
    by = Window.partitionBy(*group)
    rank = F.percent_rank().over(by.orderBy(value))
    cut = F.percentile(value, F.lit(quantile)).over(by)
    return df.withColumns({"star": F.greatest(F.col(value) - cut, F.lit(0.0)), "rank_share": rank, "rank_power": F.pow(rank, power)})
