"""Line-first cleaning.

Every line of a text is judged on its own: lines that are navigation, symbol junk, shouting or boilerplate, that
are short and do not end like a sentence, or that repeat an earlier line of the text are removed; a document that loses more
than half of its characters that way is rejected. Base counts and a base test go before.

Defined results: a null text counts as empty, has no words and fails the base test; a text without line breaks is
one line; rows that repeat are judged alike; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Flat, Schema, Spans, classes, filter_slices, group_of, map_rows, map_slices, mix, per_group, repeated, repeated_windows, type_of, window_places

#: Phrases (lower case) whose lines are boilerplate.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "this work is licensed", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our", "sign up for", "lorem ipsum",
)
SYMBOLS = b"#*$%&|<>"
#: A line ends like a sentence with one of these, closing quotes and brackets included.
ENDINGS = b".!?:;\"')]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line of fewer words must end like a sentence.
MIN_SENTENCE = 20

_IN = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"symbol": SYMBOLS, "ending": ENDINGS, "pipe": b"|"}.items()}
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_SMALL = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_POINT = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "n_lines": "long", "n_bad_lines": "long", "removed_chars": "long",
}


def repeated_lines(spans: Spans, ls: np.ndarray, le: np.ndarray, text: np.ndarray, worded: np.ndarray, first_too: bool) -> np.ndarray:
    """Lines with words that their text has twice or more, compared byte by byte: all of them, or all but the first."""
    ls_, le_, of = ls[worded], le[worded], text[worded]
    key = mix(spans.hash(ls_, le_) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(ls), bool)
    out[worded] = repeated(*classes(key, lambda i, j: (of[i] == of[j]) & spans.same(ls_[i], le_[i], spans, ls_[j], le_[j])), first_too)
    return out


def judge_lines(flat: Flat) -> dict[str, np.ndarray]:
    """Per line: bounds, words, code points in words, whether it repeats an earlier line of its text, and whether it is removed."""
    ls, le, per_text = flat.lines()
    ws, we, _ = flat.words()
    spans = Spans(flat.buf)
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    words = last - first
    worded = words > 0
    seps = flat.tally(_POINT[flat.buf])
    chars = np.concatenate([[0], np.cumsum(seps[we] - seps[ws])])
    chars = chars[last] - chars[first]

    def count(mask: np.ndarray) -> np.ndarray:
        t = flat.tally(mask[flat.buf])
        return t[le] - t[ls]

    symbols, pipes, upper, small = (count(x) for x in (_IN["symbol"], _IN["pipe"], _UPPER, _SMALL))
    again = repeated_lines(spans, ls, le, group_of(per_text), worded, first_too=False)
    ending = np.zeros(len(ls), bool)
    ending[worded] = _IN["ending"][flat.buf[we[last[worded] - 1] - 1]]
    phrase = np.zeros(len(ls), bool)
    low = flat.lowered().buf.tobytes()
    for p in BOILERPLATE:
        at = low.find(p.encode())
        while at >= 0:
            phrase[np.searchsorted(ls, at, "right") - 1] = True
            at = low.find(p.encode(), at + 1)
    navigation = (pipes >= 2) & (5 * pipes >= words)
    junk = 10 * symbols > 3 * words
    shouting = (upper >= 5) & (upper > small)
    bad = worded & (navigation | junk | shouting | phrase | (~ending & (words < MIN_SENTENCE)) | again)
    return {"start": ls, "end": le, "per_text": per_text, "words": words, "chars": chars, "symbols": symbols, "again": again, "bad": bad}


def repeat_words(flat: Flat, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its words, and those inside a run of `size` words that the text has twice or more."""
    ws, we, counts = flat.words()
    spans = Spans(flat.buf)
    place, text = window_places(counts, size)
    twice = repeated_windows(spans.classes(spans.hash(ws, we), ws, we)[0], place, text, size)
    cover = np.zeros(len(ws) + size, bool)
    for k in range(size):
        cover[place[twice] + k] = True
    return counts, per_group(cover[: len(ws)], counts)


def measure(flat: Flat) -> dict[str, np.ndarray]:
    line = judge_lines(flat)
    n_words, n_repeat = repeat_words(flat)
    per = line["per_text"]
    word_chars, removed = per_group(line["chars"], per), per_group(line["chars"] * line["bad"], per)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": per_group(line["symbols"], per), "n_dup_lines": per_group(line["again"], per), "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & (2 * removed <= word_chars), "n_lines": per_group(line["words"] > 0, per), "n_bad_lines": per_group(line["bad"], per), "removed_chars": removed,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts per row of docs. No shuffle: every text is judged where it is read."""
    return map_slices(docs, [id_col, text_col], text_col, lambda part, flat: {id_col: part.column(id_col)} | measure(flat), Schema(**{id_col: type_of(docs, id_col)}, **MEASURES))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all columns."""
    return filter_slices(docs, text_col, lambda part, flat: measure(flat)["kept"])


def without_lines(flat: Flat, line: dict[str, np.ndarray]) -> pa.Array:
    """The texts without their removed lines."""
    edges = np.zeros(len(flat.buf) + 1, np.int64)
    bad = line["bad"]
    np.add.at(edges, line["start"][bad], 1)
    np.add.at(edges, line["end"][bad] + 1, -1)  # with its newline
    kept = np.cumsum(edges)[:-1] == 0
    of = group_of(line["per_text"])[~bad]
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    kept[line["end"][~bad][last]] = False  # no newline after the last line
    offsets = np.concatenate([[0], np.cumsum(kept)])[flat.offsets]
    return pa.Array.from_buffers(pa.large_binary(), flat.n, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(flat.buf[kept].tobytes())]).cast(pa.large_string())


def clean_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the removed lines taken out of the text column; other columns stay. A null text becomes an empty one."""

    def clean(part: pa.RecordBatch, flat: Flat) -> pa.RecordBatch:
        at = part.schema.get_field_index(text_col)
        return part.set_column(at, part.schema.field(at), without_lines(flat, judge_lines(flat)).cast(part.schema.field(at).type))

    return map_rows(docs, text_col, clean)
