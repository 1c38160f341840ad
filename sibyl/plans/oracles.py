"""SQL of fits and resampling for the oracles, written from their definitions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from ..operators.resample import poisson_cuts


def uniform_sql(seed: int, of: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || rep || ':' || {of}), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def drawn_sql(sums: str, cluster: str, seed: int, draws: int = 200) -> str:
    """Rows of sums for every replicate with k, how often their cluster is drawn."""
    cases = " ".join(f"WHEN u < {c!r}e0 THEN {k}" for k, c in enumerate(poisson_cuts()))
    return f"(SELECT *, CASE {cases} ELSE 8 END AS k FROM (SELECT *, {uniform_sql(seed, cluster)} AS u FROM {sums}, (SELECT unnest(range(1, {draws + 1})) AS rep) reps) u)"


def _det(rows: Sequence[int], columns: Sequence[int], a: str) -> str:
    """Determinant of the symmetric matrix a over some rows and columns."""
    if not rows:
        return "1e0"
    at = lambda j: f"{a}{min(rows[0], j)}{max(rows[0], j)}"
    return "(" + " + ".join(f"{'-' if n % 2 else ''}{at(j)} * {_det(rows[1:], [c for c in columns if c != j], a)}" for n, j in enumerate(columns)) + ")"


def inverse_sql(k: int, i: int, j: int) -> str:
    """Element of the inverse of the k by k matrix h."""
    rest = lambda x: [n for n in range(k) if n != x]
    return f"{'-' if (i + j) % 2 else ''}{_det(rest(j), rest(i), 'h')} / {_det(range(k), range(k), 'h')}"


def newton_sql(source: str, x: Sequence[str], y: str, offset: str = "0e0", penalty: float = 0.0, cluster: str = "0", sandwich: bool = False, steps: int = 15) -> str:
    """CTEs that end in f: coefficients b0.. (the intercept last, without penalty) and errors se0.. of a logit fit by Newton steps."""
    k = len(x) + 1
    pairs, pen = list(combinations_with_replacement(range(k), 2)), [penalty] * (k - 1) + [0.0]
    eta = "o + " + " + ".join(f"b{i} * x{i}" for i in range(k))
    rows = lambda t: f"(SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM {t}, x) a) a"
    kept = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(k))
    hess = ", ".join(f"sum(w * x{i} * x{j}) + {pen[i] if i == j else 0.0}e0 AS h{i}{j}" for i, j in pairs)
    grad = ", ".join(f"sum(x{i} * (y - p)) - {pen[i]}e0 * any_value(b{i}) AS g{i}" for i in range(k))
    step = ", ".join(f"b{i} + " + " + ".join(f"({inverse_sql(k, i, j)}) * g{j}" for j in range(k)) for i in range(k))
    both = lambda a, i, j: f"{a}{min(i, j)}{max(i, j)}"
    error = [f"v{i}{i}" if not sandwich else " + ".join(f"{both('v', i, a)} * {both('m', a, b)} * {both('v', b, i)}" for a in range(k) for b in range(k)) for i in range(k)]
    return f"""WITH RECURSIVE x AS (SELECT {', '.join(f'{c} AS x{i}' for i, c in enumerate([*x, '1e0']))}, {offset} AS o, CAST({y} AS DOUBLE) AS y, {cluster} AS c FROM {source}),
    b AS (SELECT 0 AS i, {', '.join(f'0e0 AS b{i}' for i in range(k))} UNION ALL SELECT i + 1, {step} FROM (SELECT any_value(i) AS i, {kept}, {hess}, {grad} FROM {rows('b')}) t WHERE i < {steps}),
    z AS (SELECT * FROM b WHERE i = {steps}), h AS (SELECT {kept}, {hess} FROM {rows('z')}), v AS (SELECT *, {', '.join(f'{inverse_sql(k, i, j)} AS v{i}{j}' for i, j in pairs)} FROM h),
    m AS (SELECT {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i, j in pairs)} FROM (SELECT c, {', '.join(f'sum(x{i} * (y - p)) AS s{i}' for i in range(k))} FROM {rows('z')} GROUP BY c) t),
    f AS (SELECT {', '.join(f'b{i}, sqrt({error[i]}) AS se{i}' for i in range(k))} FROM v, m)"""


def terms_sql(names: Sequence[str]) -> str:
    """One row for each term of f."""
    return " UNION ALL ".join(f"SELECT '{n}' AS term, b{i} AS coef, se{i} AS se FROM f" for i, n in enumerate(names))
