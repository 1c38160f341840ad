"""Two-sided team effects (A28): least squares with +1 for the home team and -1 for the away team, by conjugate gradients.

Games are summed by pair of teams once. A step is then one join of the pairs with the direction, twice, and one sum by team; only
a few numbers a step (inner products) go to the driver, and teams and pairs stay tables, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _sides(pairs: DataFrame, value: Column, other: str = "team") -> DataFrame:
    """value for the home team and its negative for the away team, summed by team."""
    one = F.array(F.struct(F.col("home").alias(other), value.alias("v")), F.struct(F.col("away").alias(other), (-value).alias("v")))
    return pairs.select(F.explode(one).alias("x")).select("x.*").groupBy(other).agg(F.sum("v").alias("v"))


def team_effects(df: DataFrame, home: str, away: str, y: str, steps: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, float, float]:
    """Rows (team, effect, gradient), the intercept, and the share of y's variance that the effects explain. gradient: what the normal
    equations lack at the end, 0 at the least squares. Effects are those of least length (they sum to 0 in each connected set of teams); a game of a team
    against itself tells of the intercept alone; rows without y or a team are left out. Steps end when the gradient is `tolerance` of its first length."""
    games = df.select(F.col(home).alias("home"), F.col(away).alias("away"), F.col(y).cast("double").alias("y")).dropna()
    pairs = stored(games.groupBy("home", "away").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")), "effects-pairs")
    total = pairs.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([], "team string, effect double, gradient double"), 0.0, float("nan")
    n, mean = total["n"], total["s"] / total["n"]
    spread = total["q"] - n * mean * mean
    # home less away games of a team, and the right side X'(y - mean); the scale is a team's games, for steps of like size
    own = _sides(pairs, F.col("n")).withColumnRenamed("v", "d").join(_sides(pairs, F.col("s") - mean * F.col("n")).withColumnRenamed("v", "g"), "team")
    met = pairs.where("home <> away").select(F.explode(F.array("home", "away")).alias("team"), "n").groupBy("team").agg(F.sum("n").alias("scale"))
    own = own.join(met, "team", "left").withColumn("scale", F.coalesce("scale", F.lit(1)).cast("double"))
    state = stored(own.select("team", "d", "scale", F.lit(0.0).alias("b"), F.col("g").alias("r"), (F.col("g") / F.col("scale")).alias("p")), "effects-state")
    rz = first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("scale"))).first()[0] or 0.0
    for _ in range(steps):
        if rz <= first * tolerance * tolerance or rz == 0:
            break
        p = state.select("team", "p")
        met = pairs.join(p.withColumnsRenamed({"team": "home", "p": "ph"}), "home").join(p.withColumnsRenamed({"team": "away", "p": "pa"}), "away")
        moved = state.join(_sides(met, F.col("n") * (F.col("ph") - F.col("pa"))), "team")
        moved = stored(moved, "effects-moved")
        dp, pap = moved.agg(F.sum(F.col("d") * F.col("p")), F.sum(F.col("p") * F.col("v"))).first()
        length = pap - dp * dp / n  # the intercept takes its part
        if length <= 0:
            break
        a = rz / length
        r = F.col("r") - a * (F.col("v") - F.col("d") * (dp / n))
        state = stored(moved.select("team", "d", "scale", (F.col("b") + a * F.col("p")).alias("b"), r.alias("r"), "p"), "effects-state")
        now = state.agg(F.sum(F.col("r") * F.col("r") / F.col("scale"))).first()[0]
        state = state.withColumn("p", F.col("r") / F.col("scale") + (now / rz) * F.col("p"))
        rz = now
    b = state.select("team", "b")
    fitted = pairs.join(b.withColumnsRenamed({"team": "home", "b": "bh"}), "home").join(b.withColumnsRenamed({"team": "away", "b": "ba"}), "away").withColumn("e", F.col("bh") - F.col("ba"))
    sums = fitted.agg(F.sum(F.col("n") * F.col("e")).alias("e"), F.sum(F.col("s") * F.col("e")).alias("se"), F.sum(F.col("n") * F.col("e") * F.col("e")).alias("ee")).first()
    intercept = mean - sums["e"] / n
    left = spread - 2 * (sums["se"] - mean * sums["e"]) + sums["ee"] - sums["e"] ** 2 / n
    # the gradient anew from the games, not as the steps carried it
    gradient = _sides(fitted, F.col("s") - F.col("n") * (F.col("e") + intercept)).withColumnRenamed("v", "gradient")
    return b.withColumnRenamed("b", "effect").join(gradient, "team"), intercept, 1 - left / spread if spread > 0 else float("nan")
