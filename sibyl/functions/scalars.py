"""String, date, array, map and JSON functions (T01-T16) as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTS = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşșťţțùúûüūůűýÿźžżğ"
_PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorrsssstttuuuuuuuyyzzzg"
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def norm_name(name: Column) -> Column:
    """Lower case without accents, punctuation and a generational suffix."""
    plain = F.translate(F.lower(name), _ACCENTS, _PLAIN)
    words = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.'’`]", ""), r"[^a-z0-9]+", " "))
    return F.regexp_replace(words, r" (" + "|".join(SUFFIXES) + r")$", "")


def first_last(name: Column) -> Column:
    """T02: 'Last, First' to 'First Last'; a suffix joined to the last name ('SmithJr.') is split off."""
    parts = F.split(name, r"\s*,\s*", 2)
    last = F.regexp_replace(F.element_at(parts, 1), r"(?<=[a-z])(Jr\.?|Sr\.?|III|II|IV)$", " $1")
    return F.when(F.size(parts) == 2, F.trim(F.concat_ws(" ", F.element_at(parts, 2), last))).otherwise(F.trim(name))


def unique_code(name: Column, codes: Sequence[tuple[str, str]]) -> Column:
    """The code of the only full name that ends with, or starts with, the text; null if none or several do."""
    table = F.array(*(F.struct(F.lit(n.lower()).alias("n"), F.lit(c).alias("c")) for n, c in codes))
    key = F.lower(F.trim(name))
    hits = F.array_distinct(F.transform(F.filter(table, lambda x: (F.length(key) > 0) & (x["n"].endswith(key) | x["n"].startswith(key))), lambda x: x["c"]))
    return F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1)))


def matchup(token: Column) -> Column:
    """T04: 'AWAY@HOME' to a struct of both codes."""
    away, home = F.regexp_extract(token, r"^\s*([A-Z]+)\s*@", 1), F.regexp_extract(token, r"@\s*([A-Z]+)\s*$", 1)
    return F.when((away != "") & (home != ""), F.struct(away.alias("away"), home.alias("home")))


def report_date(text: Column) -> Column:
    """MM/dd/yy or MM/dd/yyyy."""
    t = F.trim(text)
    return F.when(F.length(t) <= 8, F.try_to_date(t, "MM/dd/yy")).otherwise(F.try_to_date(t, "MM/dd/yyyy"))


def parse_utc(text: Column) -> Column:
    """ISO text to an instant; without a zone it is UTC."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))


def format_utc(ts: Column) -> Column:
    """An instant to ISO text (the session zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_seconds(text: Column) -> Column:
    """T07: 'm:ss' or seconds."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, F.element_at(parts, 1).try_cast("double") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("double")).otherwise(text.try_cast("double"))


def elapsed(period: Column, clock: Column) -> Column:
    """Seconds played, periods of 12 minutes and overtimes of 5."""
    return F.when(period <= 4, (period - 1) * 720 + (720 - clock)).otherwise(2880 + (period - 5) * 300 + (300 - clock)).cast("double")


def tau(period: Column, clock: Column) -> Column:
    """Share of regulation left; an overtime counts its own clock."""
    left = F.when(period <= 4, (4 - period) * 720 + clock).otherwise(clock)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / 2880.0))


def season_of(date: Column, first_month: int = 8) -> Column:
    """A season is named by the year in which it ends."""
    return F.year(date) + (F.month(date) >= first_month).cast("int")


def shown_slate(ts: Column, hours: int = 6) -> Column:
    """The slate shown at a time, rolling over some hours after midnight."""
    return F.to_date(ts - F.expr(f"interval {hours} hours"))


def season_phase(date: Column, opening: Column, days: float = 175.0) -> Column:
    """Share of the season gone, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(date, opening) / days))


def canonical(columns: Sequence[str]) -> Column:
    """JSON of the columns in the order of their names."""
    return F.to_json(F.struct(*sorted(columns)))


def content_id(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(columns), 256)


def position_group(text: Column) -> Column:
    """Guards, wings or bigs by the first position of a list like 'PG-SG'."""
    first = F.element_at(F.split(F.upper(text), r"[-/,\s]+"), 1)
    return F.when(first.isin("PG", "SG", "G"), "guard").when(first.isin("SF", "GF", "F"), "wing").when(first.isin("PF", "C", "FC"), "big")


def position_number(text: Column) -> Column:
    """Mean of the position numbers (PG 1 to C 5); unknown ones do not count."""
    numbers = F.create_map(*(F.lit(x) for kv in {"PG": 1.0, "SG": 2.0, "G": 1.5, "SF": 3.0, "PF": 4.0, "F": 3.5, "C": 5.0}.items() for x in kv))
    found = F.filter(F.transform(F.split(F.upper(text), r"[-/,\s]+"), lambda p: F.try_element_at(numbers, p)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def midweek(date: Column) -> Column:
    """Tuesday to Thursday."""
    return F.dayofweek(date).isin(3, 4, 5)


def sunday_monday(date: Column) -> Column:
    """T13."""
    return F.dayofweek(date).isin(1, 2)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def scaled_dot(a: Column, scale: Column, w: Column) -> Column:
    """Inner product of a / scale with w."""
    return dot(F.zip_with(a, scale, lambda x, s: x / s), w)


def hat_basis(t: Column, knots: Sequence[float]) -> Column:
    """Weights of the knots between which t lies; flat beyond the ends."""
    x = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), t))
    out = []
    for i, k in enumerate(knots):
        up = (x - knots[i - 1]) / (k - knots[i - 1]) if i else F.lit(1.0)
        down = (knots[i + 1] - x) / (knots[i + 1] - k) if i + 1 < len(knots) else F.lit(1.0)
        out.append(F.greatest(F.lit(0.0), F.least(up, down, F.lit(1.0))) if i and i + 1 < len(knots) else F.greatest(F.lit(0.0), F.least(down if not i else up, F.lit(1.0))))
    return F.array(*out)


def interpolate(t: Column, knots: Sequence[float], values: Column) -> Column:
    """Piecewise linear through (knots, values)."""
    return dot(hat_basis(t, knots), values)


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline: x, then one column for each inner knot."""
    last, before = knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    d = lambda k: (cube(k) - cube(last)) / (last - k)
    return [x, *(d(k) - d(before) for k in knots[:-2])]
