"""Equality, caps and odd input: words whose hashes would collide in a polynomial, long words, wide numbers, repeated ids, and fixpoints."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sibyl.llm import bpe, labelled, ngram_join, packing, pii, quality_rules, sentencepiece_bpe, text, token_counts, topk_search
from sibyl.llm.text import Flat, Spans


def twins(size: int) -> tuple[str, str]:
    """A Thue-Morse word and its mirror: equal under every polynomial hash modulo a power of two, if long enough."""
    a, b = "x", "q"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


def test_hashes_do_not_stand_for_equality():
    """Classes hold by bytes even if every hash is the same."""
    words = [b"a", b"b", b"a", b"", b"ab" * 9, b"ab" * 8 + b"ac", b"ab" * 9, b"", b"b"]
    flat = Flat(pa.array([w.decode() for w in words]))
    spans = Spans(flat.buf)
    of, first = spans.classes(np.zeros(len(words), np.uint64), flat.start, flat.end)
    assert [words.index(w) for w in words] == first[of].tolist()
    assert text.repeated(of, first, first_too=True).tolist() == [words.count(w) > 1 for w in words]


def test_a_cache_whose_hashes_collide_gives_the_right_ids(monkeypatch):
    monkeypatch.setattr(Spans, "hash", lambda self, start, end, seed=0: (end - start).astype(np.uint64) % np.uint64(3))
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat and the dog sat on the mat", "dog cat mat and sat", "mat dog"] * 2
    ids, n = b.ids(Flat(pa.array(texts)))
    assert ids.tolist() == [i for t in texts for i in b.tokenizer.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("size", [1024, 4096])
def test_twin_words(spark, size):
    import sentencepiece

    a, b = twins(size)
    tokenizer = bpe.loaded(public_tokenizers.path("byte_bpe_50k.json"))
    ids, n = tokenizer.ids(Flat(pa.array([a, b])))
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b)]
    assert ids.tolist() == want[0] + want[1]
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, n = sentencepiece_bpe.loaded(path).encode(pa.array([a, b]))
    assert ids.tolist() == sp.encode(a, add_bos=True, add_eos=True) + sp.encode(b, add_bos=True, add_eos=True)
    assert quality_rules.measure(Flat(pa.array([f"{a}\n{b}\n{a}"])))["n_dup_lines"].tolist() == [1]
    docs = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in ngram_join.similarity_classes(docs).collect()} == {0: (0, 2), 1: (1, 1), 2: (0, 2)}


@pytest.mark.parametrize("rounds", [0, 5])
def test_long_words_merge_in_rounds(monkeypatch, rounds):
    """The rounds by rank, which long words end in, against the library."""
    import sentencepiece

    monkeypatch.setattr(sentencepiece_bpe, "_ROUNDS", rounds)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.SentencePieceBpe(path), random.Random(1)
    for n in (1, 2, 3, 7, 40, 900):
        for parts in ("a", "ab", "abcdefghijklmnop", ["the", "aa", "an", "in", "ing", "=", "é", "漢"]):
            t = "".join(rng.choice(parts) for _ in range(n))
            assert model.encode(pa.array([t]))[0].tolist() == sp.encode(t, add_bos=True, add_eos=True)


def test_removed_lines_leave_the_texts(spark):
    good = "This line is a sentence that stays where it is."
    texts = ["", None, good, f"{good}\nHome | About | Contact\n{good} Again.", "Home | About | Contact", f"\n\n{good}\n", f"{good}\nshort\n\n{good} Twice.\n{good}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("row", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in quality_rules.clean_texts(docs).collect()}
    assert got == {0: "", 1: "", 2: good, 3: f"{good}\n{good} Again.", 4: "", 5: f"\n\n{good}\n", 6: f"{good}\n\n{good} Twice."}
    assert quality_rules.clean_texts(docs.limit(0)).count() == 0


def test_cache_is_compacted(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "one two"), (None, None)], "doc_id string, text string")
    first = sorted(map(str, token_counts.token_counts(docs.where("doc_id = 'a'"), path, cache).collect()))
    assert first == sorted(map(str, token_counts.token_counts(docs, path, cache).where("doc_id = 'a'").collect()))
    assert token_counts.stored_counts(docs, cache).count() == 3
    token_counts.stored_counts(docs, cache).write.mode("append").partitionBy("tokenizer").parquet(cache)  # as if two runs had appended the same
    small = token_counts.compacted(docs, cache, f"file://{tmp_path}/small")
    assert token_counts.stored_counts(docs, small).count() == 3
    assert sorted(map(str, token_counts.token_counts(docs, path, small).collect())) == sorted(map(str, token_counts.token_counts(docs, path, cache).collect()))


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "name string, text string")
    assert sorted(r["name"] for r in quality_rules.quality_rules(docs, "name").collect()) == ["a", "b"]
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 8, "name").collect()
    assert sorted(r["name"] for r in placed) == ["a", "b"]
    with pytest.raises(TypeError):
        ngram_join.similarity_classes(docs, id_col="name")


def test_wide_numbers_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 5) * (5e6 if i % 7 == 0 else 1)).tolist()) for i in range(60)]
    rows += [rows[0], rows[20], (5, [9.0] * 5), (61, [1.0, float("inf")]), (62, [None, 1.0]), (63, None), (64, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("cell", F.lit(0))
    got = topk_search.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    own: dict[int, list[int]] = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(64 * x)) for x in v]
            own[i] = min(own.get(i, q), q)
    want = []
    for q in (i for i in own if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), df, 7).count() == 0


def test_bin_completion_beats_best_fit():
    """Fillings around the largest piece that waste nothing, where best fit takes the largest piece that fits."""
    rng, better = np.random.default_rng(0), 0
    for _ in range(30):
        counts = np.bincount(rng.integers(8, 70, 60), minlength=101)
        plan, bound = packing.plan(counts, 100)
        used, fit = sum(n for n, _ in plan), sum(n for n, _ in packing.best_fit(counts, 100))
        packed = Counter()
        for n, filling in plan:
            assert sum(s * k for s, k in filling) <= 100
            packed.update({s: n * k for s, k in filling})
        assert packed == Counter({s: int(c) for s, c in enumerate(counts) if c})
        assert bound <= used <= fit
        better += used < fit
    assert better >= 3


def test_fillings_are_all_the_undominated_ones():
    rng = np.random.default_rng(2)
    for _ in range(40):
        counts = np.bincount(rng.integers(1, 12, 9), minlength=21).tolist()
        largest = max(s for s, c in enumerate(counts) if c)
        sizes = [s for s, c in enumerate(counts) for _ in range(c - (s == largest))]
        every = {tuple(sorted((s for k, s in enumerate(sizes) if m >> k & 1), reverse=True)) for m in range(1 << len(sizes))}
        every = {x for x in every if sum(x) <= 20 - largest}
        got = [tuple(x) for _, x in packing.fillings(counts, largest, 20, 20, [10**6])]
        assert len(got) == len(set(got)) and set(got) <= every

        def over(x, y):
            """Whether y dominates x: pieces of x stand together in the place of one larger or equal piece of y, the others are shared."""
            gone, new = Counter(x) - Counter(y), Counter(y) - Counter(x)
            return x != y and sum(new.values()) == 1 and sum(s * k for s, k in gone.items()) <= max(new) and (sum(gone.values()) != 1 or max(new) > max(gone))

        assert set(got) == {x for x in every if not any(over(x, y) for y in every)}
        assert {tuple(x) for _, x in packing.fillings(counts, largest, 20, 20, [10**6], True)} == every


def test_discovery_goes_on_until_nothing_is_new(spark):
    """A chain of patterns: each word brings identifiers that only the next word shares."""
    words, per, rows = ["phone", "mobile", "fax", "pager", "desk", "night"], 6, []
    number = lambda level, k: f"{5000000 + 1000 * level + k}"
    for k in range(60):
        rows.append(f"phone +1 200 {300 + k} 4{k}00 end")
    for level, word in enumerate(words):
        for k in range(per):  # identifiers of this level beside its word, and beside the next one
            rows.append(f"so {word} {number(level, k)} then")
            if level + 1 < len(words):
                rows += [f"so {words[level + 1]} {number(level, k)} then"] * 12
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.spans(docs)
    edges = pii.pattern_graph(found)
    got = {r["identifier"] for r in pii.discover(edges, pii.word_counts(docs).join(edges.select("word").distinct(), "word")).collect()}
    # the same graph in plain Python
    table = [r.asDict() for r in edges.collect()]
    occurrences = Counter(w for t in rows for w in t.lower().split())
    scores = {(e["identifier"], e["kind"]): 1.0 for e in table if e["seed"]}
    gained: dict[tuple, float] = {}
    while True:
        sums: dict[tuple, list] = {}
        for e in table:
            for (identifier, kind), s in (scores | {(i, k): s for (i, _, k), s in gained.items()}).items():
                if identifier == e["identifier"]:
                    x = sums.setdefault((e["side"], e["word"], kind), [0, 0, 0])
                    x[0], x[1], x[2] = x[0] + e["n"] * s, x[1] + 1, x[2] + e["n"]
        confident = {k: m / (max(occurrences[k[1]], n) + pii.SMOOTHING) for k, (m, support, n) in sums.items() if support >= pii.PATTERN_SUPPORT}
        miss: dict[tuple, float] = {}
        for (side, word, kind), c in confident.items():
            if c >= pii.PATTERN_CONFIDENCE:
                for i, t in {(e["identifier"], e["kind"]) for e in table if not e["seed"] and (e["side"], e["word"]) == (side, word) and kind in pii.COMPATIBLE[e["kind"]]}:
                    miss[i, t, kind] = miss.get((i, t, kind), 1.0) * (1 - min(c, 0.999))
        now = gained | {k: max(gained.get(k, 0), 1 - m) for k, m in miss.items() if 1 - m >= pii.IDENTIFIER_SCORE}
        if len(now) == len(gained):
            break
        gained = now
    assert got == {i for i, _, _ in gained}
    assert {number(level, k) for level in range(len(words)) for k in range(per)} <= got  # six rounds away


def test_long_neighbours_and_many_matches(spark):
    word = "w" * 500
    many = " ".join(f"a{k}@b{k}.org" for k in range(1500))
    docs = spark.createDataFrame([(0, f"{word} {' ' * 200} a@b.cc {word}"), (1, many), (2, None), (3, "")], "doc_id long, text string")
    found = {r["id"]: r["base"] for r in pii.spans(docs).collect()}
    assert (found[0][0]["l"], found[0][0]["r"]) == (word, word)
    assert [many[x["s"] : x["e"]] for x in found[1]] == many.split() and found[2] == [] and found[3] == []


def test_stages_with_clashing_columns(spark):
    docs = spark.createDataFrame([(0, "write to a@b.cc now"), (1, None), (None, "a@b.cc"), (0, "write to a@b.cc now")], "doc_id long, text string")
    for c in ("pii_spans", "pii_id", "pii_h", "spans", "row", "t", "h", "sibyl_h", "sibyl_copy", "copy", "f.h"):
        docs = docs.withColumn(c, F.lit("x"))
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["text"]) for r in got.collect()) == ["None", "[EMAIL]", "write to [EMAIL] now", "write to [EMAIL] now"]
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_sample_is_bounded_and_defined(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 30)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 0][:8]
    docs = spark.createDataFrame([(i, "x" * 10) for i in ids] + [(ids[0], "y" * 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(ids[1], 0), (ids[2], 1)], "doc_id long, toxic int")
    got = labelled.labelled_sample(docs, labels, "toxic", 100)
    assert got.num_rows == 3 and set(got["y"].to_pylist()) == {1} and got["weight"].to_pylist() == [7 / 3] * 3


def test_pipeline_on_odd_input(spark, tmp_path):
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choice("abdeilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(14)).capitalize() + "." for _ in range(16)]
    good, other = "\n".join(lines[:8]), "\n".join(lines[8:])
    rows = [(0, good, "en"), (1, None, None), (2, "", "en"), (3, good, "en"), (None, good + "\nOne more line stands here, and it ends well.", None), (0, good, "en"), (4, "Home | About | Contact\n" + other + "\nmail a@b.cc now.", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long")).withColumn("spans", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {0, None, 4} and len(got) == 3
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
