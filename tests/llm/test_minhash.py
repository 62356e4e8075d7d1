import random
import re

import numpy as np
import pytest

from cartweave.llm import minhash, shared
from cartweave.llm.shared import components


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """{doc_id: (n, component)} over rows of different ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for i in sorted(sets):
        if sets[i]:
            root[i] = first.setdefault(frozenset(sets[i]), i)
    ids = sorted(first.values())
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def corpus(vocabulary, prose):
    """Groups of copies with some words changed, of texts of every size; chains of links; case and white space."""
    r, rows = random.Random(9), []
    for g in range(60):
        base = prose(100 + g, r.choice([1, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200, 500, 1500])).split()
        for _ in range(r.choice([1, 2, 2, 3, 6])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            sep = r.choice([" ", "  ", "\n", "\t "])
            text = sep.join(words)
            rows.append(text.upper() if r.random() < 0.2 else text)
    chain = prose(7, 300).split()
    for _ in range(12):  # the ends are far apart
        chain = chain[6:] + r.choices(vocabulary, k=6)
        rows.append(" ".join(chain))
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def test_as_brute_force(frame, corpus):
    want = brute(corpus)
    assert result(minhash.near_duplicates(frame(corpus))) == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_lower_threshold(frame, corpus):
    want = brute(corpus, 80)
    assert want != brute(corpus) and result(minhash.near_duplicates(frame(corpus), percent=80)) == want


def test_recall_of_bands():
    """At any threshold a pair that just reaches it is as good as never missed."""
    assert minhash.band_counts(0.85) == (6, 40) and minhash.band_counts(0.8) == (15, 53)
    for percent in (70, 80, 85, 90, 95):
        bands = minhash.band_counts(percent / 100)[1]
        assert (1 - (percent / 100) ** (minhash.REGISTERS // bands)) ** bands <= minhash.MISS


def test_large_group(frame, vocabulary, prose, monkeypatch):
    """More near copies than a block holds, some too far from the centre for a link with it, in several components."""
    r, base, rows = random.Random(3), prose(77, 120).split(), []
    monkeypatch.setattr(minhash, "BLOCK", 300)
    for i in range(1200):
        words = list(base)
        words[i % 120] = vocabulary[i % 7]
        if i % 3 == 0:
            words[(i * 7 + 40) % 120] = r.choice(vocabulary)
        if i % 12 == 0:
            words[(i * 11 + 80) % 120] = r.choice(vocabulary)
        rows.append((i + 1, " ".join(words)))
    rows += [(5000 + i, " ".join(base)) for i in range(800)]
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 20
    assert result(minhash.near_duplicates(frame(rows))) == want


def test_odd_rows(frame, odd_rows, with_clashes):
    got = minhash.near_duplicates(with_clashes(frame(odd_rows))).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for row in got:
        by.setdefault(row["doc_id"], []).append(row)
    for i in (1, 2, 3):
        assert [(x["n_shingles"], x["component_id"], x["kept"]) for x in by[i]] == [(0, i, True)]
    assert by[4][0]["n_shingles"] == 1 and [x["component_id"] for x in by[5]] == [5, 5] and by[6][0]["component_id"] == 5 and not by[6][0]["kept"]
    assert [x["component_id"] for x in by[7]] == [7, 7]
    assert all(x["component_id"] is None and x["kept"] for x in by[None])
    assert by[10][0]["component_id"] == 9 and by[8][0]["component_id"] == 8


def test_empty_table(frame):
    out = minhash.near_duplicates(frame([]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.collect() == []


def test_registers_estimate(vocabulary):
    random_ = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        common = random_.integers(0, 2**64, 20000, np.uint64)
        cut = int(20000 * share)
        a, b = np.unique(common), np.unique(np.concatenate([common[:cut], random_.integers(0, 2**64, 20000 - cut, np.uint64)]))
        x, y = minhash.registers(a), minhash.registers(b)
        alike, filled = ((x == y) & (x != 0)).sum(), ((x != 0) | (y != 0)).sum()
        chance = minhash.collisions(np.array([len(a)]), np.array([len(b)]))[0] * minhash.REGISTERS
        estimate = (alike - chance * (1 - alike / filled)) / filled
        assert abs(estimate - cut / (40000 - cut)) < 0.1
    one, two = (minhash.registers(np.unique(random_.integers(0, 2**64, 5000, np.uint64))) for _ in range(2))
    chance = minhash.collisions(np.array([5000]), np.array([5000]))[0] * minhash.REGISTERS
    assert ((one == two) & (one != 0)).sum() <= chance + 6 * np.sqrt(chance + 1)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(4000, 4200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lonely = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in root if x not in lonely}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_files(spark, frame, prose, monkeypatch):
    """What is cut has a file for several shuffle partitions, with the same results, where these are many and small."""
    seen, rows = [], [(i, prose(i // 2, 60)) for i in range(40)]
    want = sorted(map(tuple, minhash.near_duplicates(frame(rows)).collect()))
    monkeypatch.setattr(shared, "FILES_PER_CORE", 0)
    for module in (minhash, shared):
        monkeypatch.setattr(module, "cut", lambda f, cut=module.cut: seen.append(out := cut(f)) or out)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, minhash.near_duplicates(frame(rows)).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(seen) > 8 and max(x.rdd.getNumPartitions() for x in seen) <= 24 // shared.PARTITIONS_PER_FILE
