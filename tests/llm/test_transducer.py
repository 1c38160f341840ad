"""The transducer against the library, decoding against Python's own decoder, and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sibyl.llm import bpe_transducer, queries
from sibyl.llm.text import Flat

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe_transducer.RankedBpe(PATH, public_tokenizers.PATTERN)


def odd_texts() -> list[str]:
    rng = random.Random(5)
    out = ["", " ", "\n\n  a", "a" * 5000, "ab" * 3000, "　x y z", "it's we'll 'tis", "<|endoftext|>", "é" * 300, "漢字" * 50, "\U0001f600" * 40, "\x00\x01"]
    for _ in range(400):
        out.append("".join(rng.choice(rng.choice(["ab", "=-_", "é漢 á", "aaaa", "0123", ["the ", "in", "ing", "\n ", "\t"]])) for _ in range(rng.choice([1, 3, 10, 80]))))
    return out


def test_ids_of_the_library(own, library):
    texts = odd_texts()
    ids, n = own.ids(Flat(pa.array(texts)))
    ends = np.cumsum(n).tolist()
    for t, k, b in zip(texts, n.tolist(), ends, strict=True):
        assert ids[b - k : b].tolist() == library.encode_ordinary(t), t
        assert own.decode(ids[b - k : b], block=3) == t


def test_states_that_are_dropped_come_back(monkeypatch, library):
    monkeypatch.setattr(bpe_transducer, "STATES", 7)
    t = bpe_transducer.Transducer(ranks_of(PATH))
    for word in ("internationalisation", "aaaaaaaaaaaaa", "Straßenbahn", "xqzjk" * 40):
        assert t.encode(word.encode()) == library.encode_ordinary(word)


@pytest.mark.parametrize("seed", range(6))
def test_any_rank_file(seed):
    """Ranks that no training would give: tokens that merges never reach, and merges that make a lower rank possible later."""
    rng = random.Random(seed)
    words = {bytes([c]) for c in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    order = sorted(words, key=lambda w: (len(w) > 1, rng.random()))
    ranks = {w: i for i, w in enumerate(order)}
    library, own = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), bpe_transducer.Transducer(ranks)
    for _ in range(1500):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert own.encode(piece.encode()) == library.encode_ordinary(piece), (piece, order[256:])


@pytest.mark.parametrize("seed", range(6))
def test_any_rank_file_side_by_side(seed, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "SIDE_BY_SIDE", 12)
    monkeypatch.setattr(bpe_transducer, "BLOCK", 1000)
    rng = random.Random(seed)
    words = {bytes([c]) for c in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    order = sorted(words, key=lambda w: (len(w) > 1, rng.random()))
    ranks = {w: i for i, w in enumerate(order)}
    library, own = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), bpe_transducer.Transducer(ranks)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 16))) for _ in range(1500)] + ["c" * 3000, "", "ab"]
    ids, n = own.encode_all([p.encode() for p in pieces])
    ends = np.cumsum(n).tolist()
    assert len(ids) == ends[-1]
    for p, k, b in zip(pieces, n.tolist(), ends, strict=True):
        assert ids[b - k : b].tolist() == library.encode_ordinary(p), (p, order[256:])
    assert [x.tolist() for x in own.encode_all([])] == [[], []]


def test_words_met_once_make_no_states(own, library):
    """Over new words the determinised states were built for single use, which took most of the query's time."""
    rng = random.Random(11)
    text = " ".join("".join(rng.choice(["th", "er", "é", "ou", "q", "ing", "ä"]) for _ in range(rng.randint(2, 9))) for _ in range(5000))
    before = len(own.transducer.held)
    ids, _ = own.ids(Flat(pa.array([text])))
    assert ids.tolist() == library.encode_ordinary(text)
    assert len(own.transducer.held) == before


def test_characters_across_blocks():
    rng = random.Random(2)
    for _ in range(400):
        data = b"".join(rng.choice([b"a", "é".encode(), "漢".encode(), "\U0001f600".encode(), bytes([rng.randrange(256)]), b"\xed\xa0", b"\xf0\x9f"]) for _ in range(12))
        machine, out, i = bpe_transducer.Utf8Machine(), "", 0
        while i < len(data):
            k = rng.randint(1, 4)
            out += machine.feed(data[i : i + k])
            i += k
            assert len(machine.held) <= 3
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z"), (3, "word " * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe_transducer.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe_transducer.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe_transducer.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
