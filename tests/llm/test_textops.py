import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import textops as T

TEXTS = [None, "", "  ", "a b", "A b\n\tc  ", "é ü\x0bx", "日本 語", "x" * 700_000, "w " * 200_000, "a-b_c 9!Z", "　a\xa0b"]
WS = re.compile(r"[^\x20\x09-\x0D]+")
AL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check(texts, member, pattern, lower):
    data, off = T.buffers(pa.array(texts, pa.string()))
    got = T.scan(data, off, member, lower)
    want = [pattern.findall(_lower(t) if lower else t or "") for t in texts]
    assert got.counts().tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    raw = bytes(data)
    for w, s, e in zip(flat, got.start.tolist(), got.end.tolist()):
        have = raw[s:e].decode()
        assert (_lower(have) if lower else have) == w
    by = {}
    for w, h in zip(flat, got.hash.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    return got, want


def test_scan_words():
    check(TEXTS, T.SPACED, WS, True)
    check(TEXTS, T.SPACED, WS, False)
    check([_lower(t) for t in TEXTS], T.ALNUM, AL, True)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té日!", max_size=30), max_size=8))
def test_scan_random(texts):
    got, want = check(texts, T.SPACED, WS, True)
    for k in (1, 2, 4):
        h, docs, first = T.windows(got, k)
        n = [max(0, len(w) - k + 1) for w in want]
        assert np.bincount(docs, minlength=len(texts)).tolist() == n if texts else not len(h)


def test_empty_array():
    data, off = T.buffers(pa.array([], pa.string()))
    assert len(T.scan(data, off).hash) == 0


def test_count_bytes_and_pieces():
    texts = pa.array(TEXTS, pa.string())
    data, off = T.buffers(texts)
    assert T.count_bytes(data, off, T.CODE_POINTS).tolist() == [len(t or "") for t in TEXTS]
    seen = [x for _, part in T.pieces(texts, 1000) for x in part.to_pylist()]
    assert seen == TEXTS
