"""The audit against a plain sum over all terms, trees against all pairs of a row, and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sibyl.llm import divergence, queries

SF = "/root/testdata/sf0.001"
_A_TO_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows: list[tuple], top: int = 200) -> set[tuple]:
    """From rows (text, lang, source)."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [t.translate(_A_TO_Z) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def chances(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        p = {s: chances(counts[lang, s]) for s in sources}
        q = chances(whole)
        for s in sources:
            parts = {
                "pair": [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s],
                "term": [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def rows_of(df) -> set[tuple]:
    rows = df.collect()
    found = {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark):
    docs = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(docs)
    assert rows_of(queries.op13_source_divergence(spark, SF)) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = con.execute(queries.OP13_SQL).df()
    assert set(got[["lang", "source", "part", "item", "value", "rank"]].itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("seed", range(5))
def test_trees(monkeypatch, seed):
    """Nodes with their ancestors add up to all pairs of all rows, with multiplicities beyond a digit and small blocks."""
    monkeypatch.setattr(divergence, "_BLOCK", 50)
    rng = random.Random(seed)
    zero = [rng.randint(1, 9) for _ in range(6)]
    rows = {tuple((g, rng.choice([zero[g], 10**9 + 1, rng.randint(1, 10**9)]), zero[g]) for g in sorted(rng.sample(range(6), rng.randint(2, 6)))): rng.choice([1, 2, 4096, 10**5, 2**40 + 7]) for _ in range(60)}
    f = lambda p, q: (p - q) ** 2 // q
    want: Counter = Counter()
    for items, times in rows.items():
        for a, p, p0 in items:
            for b, q, q0 in items:
                if a != b:
                    want[a, b] += times * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
    got: Counter = Counter()
    for a, b, v in divergence.tree_sums(iter([(list(k), rows[k]) for k in sorted(rows)]), limit=3):
        got[a, b] += v
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_odd_rows(spark):
    long = "x" * 50_000
    rows = [(None, None, None), ("a b B ÉÉ éé", "l", "s"), ("a b B ÉÉ éé", "l", "s"), ("b c a1a", "l", "t"), (f"{long} {long}", "l", "u"), (f"{long} b", "l", None), (long, "l", "u"), ("only once", "m", "s"), ("", "m", "t"), ("q", "n", "s"), ("zz zz\x00zz", "l", "é"), ("zz", "l", "é"), ("zz", "l", "z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, g int")
    assert rows_of(divergence.divergence(docs)) == plain(rows)
    assert rows_of(divergence.divergence(docs, top=1)) == plain(rows, top=1)
    assert divergence.divergence(docs.limit(0)).count() == 0
