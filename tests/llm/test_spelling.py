"""Spelling variants against brute force over the whole vocabulary, and odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from sibyl.llm import queries, spelling

SF = "/root/testdata/sf0.001"
_A_TO_Z = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted(rows: list[tuple], drop_every: int, least: int = 3) -> dict[str, int]:
    out: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(_A_TO_Z)
            h = zlib.crc32(f"{i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= least}


def grouped(n: dict[str, int]) -> dict[str, tuple]:
    """(n, n_near, form, form_n, root) of every word. Pairs are all those that a deletion from one or from both makes equal."""
    by: dict[str, set] = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(x, set()).add(w)
    out, form = {}, {}
    for w in n:
        near = {y for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for y in by[x] if one_edit(w, y)}
        best = min(near, key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(near))
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (form[w], n[form[w]] if form[w] else None, root)
    return out


def result(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = grouped(counted(rows, 97))
    assert result(queries.op11_spelling_variants(spark, SF)) == want
    assert sum(x[2] is not None for x in want.values()) > 10


@pytest.mark.parametrize("seed", range(30))
def test_scan_of_a_list(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 8))) for _ in range(200)}
    for side in "fb":
        ws = sorted(w if side == "f" else w[::-1] for w in words)
        lcp = [0, *(spelling.shared(a, b) for a, b in zip(ws, ws[1:], strict=False))]
        for q in ws:
            head = q[: spelling.begin_of(side, len(q))]
            assert [ws[i] for i in spelling.scan(ws, lcp, q, len(head))] == [w for w in ws if w.startswith(head) and one_edit(w, q)]


def test_lists_of_many_ranges(spark):
    """Words of three letters, most with one beginning, in ranges of seven words: pairs across ranges are neither lost nor counted twice."""
    rng = random.Random(8)
    words = {"ababa" * (rng.random() < 0.7) + "".join(rng.choice("abß") for _ in range(rng.randint(5, 9))) for _ in range(900)}
    n = {w: rng.choice([3, 4, 7, 20, 90]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert result(spelling.spelling_variants(df, size=60)) == grouped(n)


def test_forms_in_a_long_chain(spark):
    words = ["a" * 5 + "b" * i for i in range(30)]
    n = {w: 3 * 2**i for i, w in enumerate(words)}
    got = result(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert {x[4] for x in got.values()} == {words[-1]}


def test_odd_rows(spark):
    long = "x" * 100_000
    rows = [(1, "Houses houses h×uses", 0), (1, "Houses houses h×uses", 0), (None, f"{long} {long}", 1), (2, None, 2), (3, "", 3), (4, f"{long}y houses1housed HOUSE", 4), (5, f"{long} abcd abcd abcd", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, least_count=1).collect()}
    assert got == counted([r[:2] for r in rows], 0, least=1) and got["houses"] == 5 and got[long] == 3
    found = result(spelling.spelling_variants(spelling.vocabulary(docs, least_count=1)))
    assert found == grouped(got) and found[f"{long}y"][2] == long
    assert spelling.spelling_variants(spelling.vocabulary(docs.limit(0))).count() == 0
    ids = docs.select("text", docs["doc_id"].cast("string").alias("doc_id"))
    assert {r["word"]: r["n"] for r in spelling.vocabulary(ids, drop_every=3, least_count=1).collect()} == counted([("" if r[0] is None else r[0], r[1]) for r in rows], 3, least=1)
