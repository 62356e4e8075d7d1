import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cartweave.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZ0é文 \t\n\r\x0b\x0c\x1f\x85 .-", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 10, 1000]))
def test_words_are_those_of_the_pattern(texts, limit):
    for of, pattern, lower in ((T.EXACT, r"[^\x20\x09-\x0D]+", False), (T.FOLDED, r"[^\x20\x09-\x0D]+", True), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s) if lower else s  # noqa: B023, E731
        want = [re.findall(pattern, fold(t or "")) for t in texts]
        got, hashes = [], {}
        for i, j, data, offsets in T.chunks(pa.array(texts, pa.string()), limit):
            w = T.words(data, offsets, of)
            for d in range(j - i):
                own = range(w.first[d], w.first[d + 1])
                got.append([fold(data[w.start[k] : w.end[k]].tobytes().decode()) for k in own])
                for k, word in zip(own, got[-1], strict=True):
                    assert hashes.setdefault(word, w.hash[k]) == w.hash[k]
        assert got == want
        assert len(set(hashes.values())) == len(hashes)


def test_rolled():
    h = np.arange(1, 30, dtype=np.uint64)
    assert len(T.rolled(h, 30)) == 0
    a = T.rolled(h, 5)
    assert len(a) == 25 and len(set(a.tolist())) == 25
    assert (T.rolled(h[3:], 5) == a[3:]).all()


def test_long_words_are_told_apart():
    """Bytes that are 65,536 places apart, exchanged."""
    a = bytearray(b"x" * 140_000)
    a[10], a[10 + 65_536] = ord("a"), ord("b")
    b = bytearray(a)
    b[10], b[10 + 65_536] = ord("b"), ord("a")
    hashes = [T.words(np.frombuffer(bytes(x), np.uint8), np.array([0, len(x)]), T.EXACT).hash[0] for x in (a, b)]
    assert hashes[0] != hashes[1]
