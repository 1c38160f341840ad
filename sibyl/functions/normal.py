"""Normal distribution function and its inverse, as Columns and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: West (2005), rational approximation of the cumulative normal, accurate to double precision
_WEST_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_WEST_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# fixed values: Acklam, rational approximation of the inverse (central and tail parts)
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL = 0.02425


def _number(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _horner(coefs: tuple[float, ...], x: str) -> str:
    out = _number(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-({x}) * ({x}) / 2)"
    inner = f"{e} * {_horner(_WEST_TOP, a)} / {_horner(_WEST_BOTTOM, a)}"
    far = f"{e} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65e0))))) / 2.506628274631e0"
    tail = f"CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {inner} ELSE {far} END"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """With the refining step of norm_ppf; the rough value is computed once, in a list of one."""
    low = f"sqrt(-2 * ln({p}))"
    high = f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - 0.5e0)"
    r = f"({q} * {q})"
    tail = lambda t: f"({_horner(_C, t)} / ({_horner(_D, t)} * {t} + 1e0))"
    mid = f"({_horner(_A, r)} * {q} / ({_horner(_B, r)} * {r} + 1e0))"
    rough = f"(CASE WHEN ({p}) IS NULL OR ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {_TAIL} THEN {tail(low)} WHEN ({p}) > 1 - {_TAIL} THEN -{tail(high)} ELSE {mid} END)"
    step = f"(({norm_cdf_sql('z')} - ({p})) * 2.5066282746310002e0 * exp(z * z / 2))"
    return f"list_transform(list_transform([{rough}], lambda z: {{'z': z, 'u': {step}}}), lambda s: s.z - s.u / (1 + s.z * s.u / 2))[1]"


def _as_column(make, x: Column) -> Column:
    """make(x), with x evaluated once."""
    return F.transform(F.array(x.cast("double")), lambda v: make(v))[0]


def norm_cdf(x: Column) -> Column:
    """P20: cumulative normal; null in, null out."""

    def make(v: Column) -> Column:
        a = F.abs(v)
        e = F.exp(-v * v / 2)
        poly = lambda cs: _fold(cs, a)
        far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * poly(_WEST_TOP) / poly(_WEST_BOTTOM)).otherwise(far)
        return F.when(v > 0, 1 - tail).when(v <= 0, tail)

    return _as_column(make, x)


def _fold(coefs: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """P20: inverse of norm_cdf with one Halley step; null outside (0, 1)."""

    def rough(v: Column) -> Column:
        low, high = F.sqrt(-2 * F.ln(v)), F.sqrt(-2 * F.ln(1 - v))
        q = v - 0.5
        r = q * q
        tail = lambda t: _fold(_C, t) / (_fold(_D, t) * t + 1)
        mid = _fold(_A, r) * q / (_fold(_B, r) * r + 1)
        return F.when((v <= 0) | (v >= 1), F.lit(None)).when(v < _TAIL, tail(low)).when(v > 1 - _TAIL, -tail(high)).otherwise(mid)

    def refine(x: Column) -> Column:
        u = (norm_cdf(x["z"]) - x["p"]) * 2.5066282746310002 * F.exp(x["z"] * x["z"] / 2)
        return x["z"] - u / (1 + x["z"] * u / 2)

    return F.transform(F.array(F.struct(_as_column(rough, p).alias("z"), p.cast("double").alias("p"))), refine)[0]
