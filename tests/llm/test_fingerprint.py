import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartweave.llm import fingerprint as fp
from cartweave.llm import text as T


def one(text):
    return next(x for _, _, data, offsets in T.chunks(pa.array([text])) for x in fp.chunk_sets(data, offsets))


def ends(text):
    """Boundaries of the chunks, a byte at a time."""
    out, h, start = [], 0, 0
    data = text.encode()
    for i, b in enumerate(data):
        h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        mask = fp.HARD if size < fp.NORMAL else fp.EASY
        if i + 1 < len(data) and size >= fp.LEAST and (h & int(mask) == 0 or size == fp.MOST) or i + 1 == len(data):
            out.append(i + 1)
            start = i + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=600), st.builds(lambda s, n: s * n, st.text(min_size=1, max_size=9), st.integers(1, 200))))
def test_boundaries(text):
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data):
        assert fp.boundaries(fp.gear(data)) == ends(text)


def slow_print(text):
    raw, at, out = text.encode(), 0, {}
    for e in ends(text) if text else []:
        part = np.frombuffer(raw[at:e], np.uint8)
        digest = int(T.mix(((part.astype(np.uint64) + np.uint64(1)) * fp._POWER[: len(part)]).sum(keepdims=True))[0] >> np.uint64(16))
        out[digest] = e - at
        at = e
    return ",".join(f"{d:012x}:{n}" for d, n in sorted(out.items()))


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    r = random.Random(3)
    return rows + [(100 + i, prose(i, r.choice([0, 1, 3, 60, 300])) + "é文" * (i % 3)) for i in range(120)] + [(500 + i, prose(3, 60)) for i in range(5)]


def like(a, b):
    x, y = (dict(p.split(":") for p in s.split(",")) if s else {} for s in (a, b))
    size = lambda z: sum(map(int, z.values()))
    if not min(size(x), size(y)):
        return 1.0 if not x and not y else 0.0
    return min(1.0, sum(int(n) for d, n in x.items() if d in y) / min(size(x), size(y)))


@pytest.mark.parametrize("buckets", [1, 7])
def test_as_brute_force(frame, corpus, with_clashes, buckets):
    order = sorted(corpus, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = slow_print(t), slow_print(edited), slow_print(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    got = [tuple(r) for r in fp.report(with_clashes(frame(corpus)), buckets).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_without_id(frame, odd_rows):
    got = fp.report(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_small_tables(frame):
    assert fp.report(frame([])).collect() == []
    (r,) = fp.report(frame([(1, "abcdef")])).collect()
    assert r["n_chars"] == 6 and r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0


def test_shifts_leave_most_chunks(prose):
    base = prose(1, 2000)
    moved = one("some words in front " + base[:3000] + " and within " + base[3000:])
    assert fp.likeness(one(base), moved) > 0.9 and fp.likeness(one(base), one(base[4000:9000])) > 0.9
    assert fp.likeness(one(base), one(prose(2, 2000))) < 0.05


def test_written_and_read(prose):
    a = one(prose(5, 100))
    b = fp.read(fp.written(a))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(fp.read("")[0]) == 0


def test_columns_pass(frame, odd_rows, with_clashes, own_columns):
    rows = own_columns(fp.fingerprints(with_clashes(frame(odd_rows))), but={"fingerprint"})
    assert {r["fingerprint"] for r in rows if not r["text"]} == {""}


def test_ranges_split_one_key():
    """Most rows have one key: its rows come into several ranges, in order of hash, and all ranges are in order."""
    r = np.random.default_rng(1)
    key = np.where(r.random(5000) < 0.6, 7, r.integers(-50, 50, 5000))
    hash_ = r.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    ranges = fp.Ranges(np.quantile(key, np.arange(1, 20) / 20, method="nearest").astype(np.int64))
    of = ranges.of(key, hash_)
    assert np.bincount(of, minlength=20).max() < 700 and len(np.unique(of[key == 7])) > 8
    order = np.lexsort((hash_, -key))
    assert (np.diff(of[order]) >= 0).all()


def test_rows_without_doc_id(spark, frame, prose):
    """Rows of one key are a chain by hash across ranges."""
    from pyspark.sql import functions as F

    rows = [(None, prose(i, 30)) for i in range(120)] + [(i, prose(1000 + i, 30)) for i in range(30)]
    docs = frame(rows)
    order = [r["text"] for r in docs.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text").collect()]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(order))
    for buckets in (1, 16):
        assert sorted(r["edited_sha256"] for r in fp.report(docs, buckets).collect()) == want
