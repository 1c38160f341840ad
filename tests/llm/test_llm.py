"""The text operators against the libraries, brute force and planted cases, with nulls, empty and long texts, ties, repeats,
empty tables and extra columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sibyl.llm import bpe, labelled, ngram_join, packing, pii, quality_crf, quality_rules, queries, sentencepiece_bpe, token_counts, topk_search, toxicity, url_filter
from sibyl.llm.text import Flat

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", " ", "  ", "\n", "é", "漢字", "▁", "<s>", "<0x0A>", "\u00a0", "\u3000", "🙂", "\t", "the ", "ing", "aaaa", "<|endoftext|>", "'s", "123", "\x00", "\u2009", "\u0085", "\x1c", "...", "     ", "ﬁ"]


def odd_texts(n: int = 400) -> list[str | None]:
    rng = random.Random(4)
    fixed = ["", None, " ", "  x", "a" * 3000, " " * 500 + "the end", " " * 40, "x" * 100 + " " * 33 + "y", "word " * 20000]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def documents(spark, texts, **extra):
    """Ids from 0, the last row repeated, a row without an id, and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "n", "id", "node", "h", "row", "m", "n_tokens", "score", "bucket", "rank", "sibyl_place"):
        df = df.withColumn(c, F.lit(extra.get(c, "x")))
    return df, rows


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = documents(spark, odd_texts())
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_bpe.digests(df, path).collect())
    want = []
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    again = sentencepiece_bpe.decode(sentencepiece_bpe.encode(df, path), path)
    assert again.count() == len(rows)


def test_byte_bpe_equals_library():
    b = bpe.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in odd_texts(800)]
    ids, n = b.ids(Flat(pa.array(texts)))
    at = np.cumsum(n) - n
    for k, e in enumerate(b.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k] + n[k]].tolist() == e.ids


def test_packing_encodes_distinct_words_once(monkeypatch):
    """op10: the cache of the query holds more words than the narrow one, which encodes many again; the ids are the same."""
    monkeypatch.setattr(queries, "pack_documents", lambda *a, **k: k["cache"])
    monkeypatch.setattr(queries, "table", lambda *a: None)
    wide = queries.op10_packing(None, SF)
    flat = Flat(pa.array([" ".join(f"{k:x}" for k in range(100_000, 400_000))]))
    again, ids = [], []
    for size in ((), wide):
        b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"), *size)
        encode, b.made = b.cache.encode, []
        b.cache.encode = lambda raw, a, z, b=b, encode=encode: b.made.append(len(a)) or encode(raw, a, z)
        ids += [b.ids(flat)[0], b.ids(flat)[0]]
        again.append(sum(b.made[1:]))
    assert 2 * again[1] < again[0]
    assert all((x == ids[0]).all() for x in ids)


def test_token_counts_and_cache(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    b = bpe.loaded(path)
    df, rows = documents(spark, odd_texts(60))
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(i), len((t or "").encode()), len(b.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for _ in range(2):  # the second time from the cache alone
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, path, cache).collect())
        assert got == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.token_counts(df.where("false"), path).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = bpe.loaded(path).tokenizer
    df, rows = documents(spark, odd_texts(300))
    got = packing.pack_documents(df, path, 2, 128).toPandas()
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        k = -(-len(ids) // 128)
        head = len(ids) - (k - 1) * 128
        cuts = [0, *(head + 128 * j for j in range(k))]
        want += [(str(i), j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = [("None" if pd.isna(a) else str(int(a)), *map(int, r)) for a, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(found) == sorted(want)
    g = got.sort_values(["sequence_id", "offset"])
    end = g["offset"] + g["length"]
    assert (end.groupby(g["sequence_id"]).shift(fill_value=0) == g["offset"]).all() and end.max() <= 128
    counts = np.bincount(got["length"], minlength=129)
    assert packing.lower_bound(counts, 128) <= g["sequence_id"].nunique() <= packing.lower_bound(counts, 128) * 1.02 + 1
    assert packing.pack_documents(df.where("false"), path, 2, 128).count() == 0


def test_plan_is_optimal_on_small_cases():
    def best(sizes, capacity):
        sizes = sorted(sizes, reverse=True)
        for bins in range(1, len(sizes) + 1):
            def place(k, room):
                if k == len(sizes):
                    return True
                return any(room[b] >= sizes[k] and (b == 0 or room[b] != room[b - 1]) and place(k + 1, [*room[:b], room[b] - sizes[k], *room[b + 1 :]]) for b in range(bins))
            if place(0, [capacity] * bins):
                return bins
        return 0

    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(sizes, minlength=21)
        p, _ = packing.plan(counts, 20)
        assert sum(n for n, _ in p) == best(sizes, 20)
        used = np.zeros(21, int)
        for n, filling in p:
            assert sum(s * k for s, k in filling) <= 20
            for s, k in filling:
                used[s] += n * k
        assert (used == counts).all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    f = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(f(a), f(b))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_oracles(spark, duck, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df())


def test_rules_and_joins_on_odd_texts(spark):
    con = duckdb.connect()
    texts = odd_texts(250)
    texts += ["Word one two three. " * 30] * 3 + [" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(98)) + " zz"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con.register("documents", docs)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"n": F.lit(1), "node": F.lit(2), "id": F.lit(3), "kept": F.lit(4)})
    same(quality_rules.quality_rules(df).toPandas(), con.execute(queries.ORACLES["op5_quality_rules"]).df())
    same(ngram_join.similarity_classes(df).toPandas(), con.execute(queries.ORACLES["op4_ngram_join"]).df())
    assert quality_rules.quality_rules(df.where("false")).count() == 0 and ngram_join.similarity_classes(df.where("false")).count() == 0


def test_join_of_large_groups(spark, monkeypatch):
    """Groups over the block size go through pairs of blocks; every link is found."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(40):
        w = list(base)
        w[i] = f"x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts + texts[:5]]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.similarity_classes(df).collect()}
    assert got == want
    assert ngram_join.representatives(df.withColumn("lang", F.lit("en"))).columns == ["doc_id", "text", "lang"]


def test_join_of_ids_with_two_texts(spark):
    """Two texts under one id, each with a near duplicate, and two writings of one set under one id."""
    words = lambda tag, n=60: [f"{tag}{k}" for k in range(n)]
    rows = []
    for i in range(12):
        for side in (0, 1):
            w = words(f"i{i}s{side}w")
            rows += [(i, " ".join(w)), (100 + 2 * i + side, " ".join([*w[:-1], "other"]))]
    w = words("same")
    rows += [(50, " ".join(w)), (50, "  ".join(w)), (51, " ".join([*w[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, frozenset(tuple(t.split()[k : k + 5]) for k in range(56))) for i, t in rows]
    want = sorted((i, sum(len(a & b) >= 0.8 * len(a | b) for j, (_, b) in enumerate(sets) if j != at)) for at, (i, a) in enumerate(sets))
    got = ngram_join.similarity_classes(df).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == want
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i if i < 51 else 50 if i == 51 else (i - 100) // 2 for i, _ in rows}


def brute_spans(t: str) -> list[tuple[str, int, int]]:
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, r in rx.items():
        for m in re.finditer(r, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (16 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base(spark):
    rng = random.Random(5)
    al = ["a", ".", "@", "b-c", "1", "23", " ", "+", "(", ")", "-", "é", "漢", "🙂", "255", "256", "0", "\n", "4", "4111 1111 1111 1111", "x@y.z", "+1 (886) 555-9674", "10.2.3.4", "_"]
    texts = ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["1" * 20000, "a" * 30000 + "@", None, "", "+" + "1 " * 3000, "0000000001.2.3.4 99999999999.1.1.1"]
    df, rows = documents(spark, texts)
    got = sorted((str(r["doc_id"]), r["b"]) for r in pii.personal_data(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect())
    assert got == sorted((str(i), ",".join("%s:%d:%d" % x for x in brute_spans(t or ""))) for i, t in rows)
    assert pii.personal_data(df.where("false")).count() == 0
    hidden = pii.redacted(df.where("doc_id = 5 or text = '10.2.3.4'"))
    assert hidden.columns == df.columns


def test_personal_data_discovery(spark):
    texts = [f"hello mail: user{i}@ex.com and call +1 (886) 555-{1000 + i} now" for i in range(30)] + ["hello mail: joe(at)example.com and call 886 555 1234 now", "room 886 555 1299 of bob(at)home place"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r["doc_id"]: sorted(x["kind"] for x in r["added"]) for r in pii.personal_data(df).collect() if r["added"]}
    assert added == {30: ["email", "phone"]}
    assert pii.redacted(df.where("doc_id < 31")).where("doc_id = 30").first()["text"].startswith("hello mail: [EMAIL] and call [PHONE]")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 0.3, (300, 12))
    v[50:60] = v[40]  # ties
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * 12), (902, [None] * 12), (903, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2)})
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(df, df.where("vec_id % 20 = 0"), 20).collect()}
    q = np.floor(64 * np.array([r for _, r in rows[:300]])).astype(int)
    want = {}
    for i in range(0, 300, 20):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:20]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
    assert got == want
    assert topk_search.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 20).count() == 2
    assert topk_search.top_k(df.where("false"), df.where("false"), 20).count() == 0


def brute_url(u: str | None) -> tuple[str, str, str | None]:
    if not u or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for _, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules(spark):
    rng = random.Random(7)
    parts = ["http", "://", "example", ".net", ".com", ".org", "/en/", "/fr/", "/de/", "net", "org", "?", "#", "A", "Ü", "/", ".", "x"]
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://a.example.net/en/1?x#y", "ftp://x://y.org/fr/"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("z"), "text": F.lit("z")})
    kinds = {r: k for k, r in queries.URL_RULES}
    for r in url_filter.filter_urls(df, queries.URL_RULES).collect():
        assert (r["host"], r["path"], r["rule"]) == brute_url(urls[r["page_id"]])
        assert r["verdict"] == kinds[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.where("false"), queries.URL_RULES).count() == 0


def test_url_model_reads_the_whole_url(spark):
    """Examples and undecided URLs that differ in scheme, query string and fragment alone, or have no scheme."""
    rng = random.Random(9)
    word = lambda al: "".join(rng.choice(al) for _ in range(12))
    good = [f"http://a.example.net/en/{i}?q={word('abcde')}#{word('abcde')}" for i in range(400)]
    bad = [f"http://b.other.net/en/{i}?q={word('vwxyz')}#{word('vwxyz')}" for i in range(400)]
    new = [f"http://c.example.org/p?q={word(al)}#{word(al)}" for al in ["abcde"] * 20 + ["vwxyz"] * 20] + ["abcdeabcdeabcde", "vwxyzvwxyzvwxyz", None, ""]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    rows = {r["page_id"] - 800: r for r in url_filter.filter_urls(df, queries.URL_RULES).where("page_id >= 800").collect()}
    assert [rows[i]["verdict"] for i in range(40)] == ["allow"] * 20 + ["block"] * 20
    assert rows[40]["score"] > rows[41]["score"] and rows[42]["score"] == rows[43]["score"] == 0
    assert {(rows[i]["host"], rows[i]["path"], rows[i]["rule"]) for i in range(40, 44)} == {("", "", None)}


def test_url_model_learns(spark):
    good, bad = [f"https://site{i}.org/fr/article-{i}" for i in range(200)], [f"http://win{i}.net/casino?x={i}" for i in range(200)]
    new = [f"https://page{i}.com/fr/article-{i}" for i in range(20)] + [f"http://other{i}.com/casino?x={i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    v = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    assert np.mean([v[400 + i] == "allow" for i in range(20)]) > 0.9 and np.mean([v[420 + i] == "block" for i in range(20)]) > 0.9


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op7_quality_crf", "quality")])
def test_classifiers_held_out(spark, name, label):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    crc = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (crc == got["held_out"]).all() and got["score"].between(0, 1).all()
    out = got[got["held_out"]]
    assert (out["predicted"] == out[label]).mean() > 0.97


@pytest.mark.parametrize("module", [toxicity, quality_crf])
def test_classifiers_on_odd_input(spark, module):
    df, rows = documents(spark, odd_texts(30), lang="en")
    score = toxicity.toxicity if module is toxicity else quality_crf.quality
    label = "toxic" if module is toxicity else "quality"
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert score(df, module.fit(df, none)).count() == len(rows)
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (3, None)], f"doc_id long, {label} int")
    assert score(df, module.fit(df, one)).count() == len(rows)
    few = spark.createDataFrame([(i, i % 2) for i in range(30)], f"doc_id long, {label} int")
    assert score(df, module.fit(df, few)).where("score between 0 and 1").count() == len(rows)
    assert score(df.where("false"), module.fit(df, none)).count() == 0


def test_crf_equals_enumeration():
    rng = np.random.default_rng(8)
    u, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        s = [(k >> i) & 1 for i in range(5)]
        w = np.exp(sum(np.log(labelled.sigmoid(u[i] if s[i] else -u[i])) for i in range(5)) + sum(moves[s[i], s[i + 1]] for i in range(4)))
        total += w
        good += w * np.array(s)
    got, pairs = quality_crf.forward_backward(np.append(u, 0.3), np.array([5, 0, 1]), moves)
    assert got[:5] == pytest.approx(good / total) and pairs.sum() == pytest.approx(4)


def test_pipeline_equals_stages_by_hand(spark):
    """The stages one after the other, with brute force where a stage's rule allows it."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns
        a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, kept))
        assert set(b) <= set(a)
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()}
            assert set(b) == want
        if name == "near_duplicates":
            con = duckdb.connect()
            con.register("documents", pd.DataFrame({"doc_id": list(a), "text": list(a.values())}))
            assert set(b) == {int(x) for x in con.execute(queries.ORACLES["op4_ngram_join"]).df().query("doc_id == class_id")["doc_id"]}
        if name == "pii":
            assert all(not [s for s in brute_spans(t) if s[0] != "card"] for t in b.values())
            assert all(b[i] == a[i] for i in b if not brute_spans(a[i]))
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == set(b)
    assert got.agg(F.sum("length")).first()[0] == sum(len(bpe.loaded(public_tokenizers.path("byte_bpe_50k.json")).tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in b.values())
