import hashlib
import random
import re

import numpy as np
import pytest

from cartweave.llm import substrings


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=50):
    """For each row (doc_id, n_words, n_removed, kept words)."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    r = random.Random(6)
    passages = [prose(900 + i, n) for i, n in enumerate([49, 50, 51, 60, 120, 300])] + ["same " * 130, "a b c " * 60]
    rows = list(odd_rows)
    for i in range(160):
        parts = []
        for _ in range(r.choice([1, 2, 3])):
            parts.append(prose(r.randrange(10**9), r.choice([0, 5, 30, 90])))
            if r.random() < 0.6:
                p = r.choice(passages).split()
                a = r.randrange(max(1, len(p) - 45))
                parts.append(r.choice([" ", "\n"]).join(p[a : a + r.choice([48, 50, 70, 400])]))
        rows.append((1000 - i, " ".join(parts)))
    return rows


def result(out):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)


def test_tree():
    """Sorted suffixes and common prefixes are those of plain sorting, and deep nodes those of equal windows."""
    r = np.random.default_rng(4)
    words = r.integers(0, 3, 400).astype(np.uint32)
    words[200:260] = words[50:110]
    start, depth = np.arange(0, 380, dtype=np.int64), 20
    order, common = substrings.tree(words, start, depth)
    text = [tuple(words[k : k + depth].tolist()) for k in order.tolist()]
    assert sorted(order.tolist()) == start.tolist() and text == sorted(text)
    want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), depth) for a, b in zip(text, text[1:], strict=False)]
    assert common.tolist() == want
    node = substrings.deep_nodes(common, depth)
    assert [node[i] == node[i - 1] for i in range(1, len(node))] == [text[i] == text[i - 1] for i in range(1, len(text))]
    assert [x.tolist() for x in substrings.tree(words[:0], start[:0], depth)] == [[], []]


@pytest.mark.parametrize("hot", [1000, 3])
def test_as_brute_force(frame, corpus, with_clashes, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    want = brute(corpus)
    assert sum(r[2] > 0 for r in want) > 60 and sum(0 < r[2] < r[1] for r in want) > 40
    assert result(substrings.without_repeats(with_clashes(frame(corpus)))) == want


@pytest.mark.parametrize("piece", [1, 5000])
def test_small_pieces_and_windows(frame, corpus, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    some = [(i, t[:2000] if t else t) for i, t in corpus]
    assert result(substrings.without_repeats(frame(some), window=7, prefix=3)) == brute(some, 7)


def test_report(frame, corpus):
    got = {tuple(r) for r in substrings.report(frame(corpus)).collect()}
    assert got == {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(corpus)}


def test_columns_pass(frame, corpus, with_clashes, own_columns):
    rows = own_columns(substrings.without_repeats(with_clashes(frame(corpus[:40]))), but={"n_words", "kept_text"})
    assert len(rows) == 40


def test_empty_table(frame):
    assert substrings.report(frame([])).collect() == []
