import hashlib
import random
import re

import numpy as np
import pytest

from cartweave.llm import decontaminate
from cartweave.llm.fmindex import FMIndex, WaveletTree, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for k in range(max(len(w) - n, 0) + 1 if w else 0):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark_rows(prose):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([40, 13, 14, 5, 1, 2, 100, 20, 60, 30])]
    return [*items, (20, None), (21, ""), (22, " ?! "), (23, items[0][1]), (None, prose(999, 30))]


@pytest.fixture(scope="module")
def corpus(prose, benchmark_rows, odd_rows):
    r, rows = random.Random(4), list(odd_rows)
    for i in range(150):
        text = prose(2000 + i, r.choice([3, 50, 400]))
        for _ in range(r.choice([0, 0, 1, 2])):
            part = (r.choice(benchmark_rows[:10])[1]).split()
            a = r.randrange(max(1, len(part) - 12))
            part = " ".join(part[a : a + r.choice([12, 13, 20, 100])])
            at = r.randrange(len(text))
            text = text[:at] + f" {part.title() if r.random() < 0.5 else part.replace(' ', ' -- ')} " + text[at:]
        rows.append((100 + i, text))
    return rows


def result(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in out.collect()), key=str)


def test_as_brute_force(spark, frame, corpus, benchmark_rows, with_clashes):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = brute(corpus, benchmark_rows)
    assert sum(r[-1] for r in want) > 20
    assert result(decontaminate.report(with_clashes(frame(corpus)), items)) == want


def test_blocks_of_items(spark, frame, corpus, benchmark_rows, with_clashes, own_columns, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert result(decontaminate.report(frame(corpus), items)) == brute(corpus, benchmark_rows)
    own_columns(decontaminate.find(with_clashes(frame(corpus[:30])), items), but={"found"})


def test_small_shards(spark, frame, corpus, benchmark_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3000)
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    docs = frame(corpus).sortWithinPartitions("doc_id")
    assert result(decontaminate.report(docs, items)) == brute(corpus, benchmark_rows)


def test_nothing(spark, frame, corpus, benchmark_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert decontaminate.report(frame([]), items).collect() == []
    assert all(r[2] == r[3] == 0 for r in result(decontaminate.report(frame(corpus[:20]), none)))


def test_passages_are_cut_out(spark, frame, prose, with_clashes, own_columns):
    item = prose(1, 20)
    rows = [(1, f"é before, {item.upper()}! after"), (2, prose(2, 30)), (3, None)]
    docs = with_clashes(frame(rows))
    out = decontaminate.without_spans(decontaminate.find(docs, spark.createDataFrame([("q", item)], "item_id string, text string")))
    got = {r["doc_id"]: r["text"] for r in own_columns(out, but={"found"})}
    assert got == {1: "é before, ! after", 2: rows[1][1], 3: None}


def test_index():
    random_ = np.random.default_rng(0)
    for size, n in ((3, 60), (9, 400), (700, 900)):
        t = random_.integers(1, size, n)
        text = t.tolist()
        order = suffix_array(np.append(t, 0), size)
        full = [*text, 0]
        assert order.tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        index = FMIndex(t, size, rate=5)
        lengths = random_.integers(1, 5, 80)
        patterns = random_.integers(1, size, (80, 5))
        for row in range(40):
            at = random_.integers(0, n - 5)
            patterns[row, : lengths[row]] = t[at : at + lengths[row]]
        low, high = index.search(patterns, lengths)
        for p, k, a, b in zip(patterns.tolist(), lengths.tolist(), low.tolist(), high.tolist(), strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - k + 1) if text[i : i + k] == p[:k]]
        tree = WaveletTree(t, size)
        symbols, places = random_.integers(0, size, 50), random_.integers(0, n + 1, 50)
        assert tree.rank(symbols, places).tolist() == [text[:i].count(s) for s, i in zip(symbols.tolist(), places.tolist(), strict=True)]
