import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cartweave.llm import pseudolikelihood as P
from cartweave.llm import text as T


@pytest.fixture(scope="module")
def corpus(odd_rows):
    r = random.Random(7)
    subjects, verbs, objects = "cat dog bird fish".split(), "sees likes hears".split(), "milk bone seed water".split()
    sentence = lambda: f"the {r.choice(subjects)} {r.choice(verbs)} the {r.choice(objects)} ."
    return [*odd_rows, *((100 + i, " ".join(sentence() for _ in range(40))) for i in range(150))]


def test_probabilities_sum_to_one():
    """Over all numbers, for any window; and a token isn't an input of its own probability."""
    random_ = np.random.default_rng(0)
    m = {k: random_.standard_normal(v.shape).astype(np.float32) for k, v in P.start().items()}
    x = np.repeat(random_.integers(0, P.SIZE + 1, (1, 2 * P.SIDE)), P.SIZE, 0)
    p = P.log_probabilities(m, np.arange(P.SIZE), x)
    assert np.exp(p).sum() == pytest.approx(1, abs=1e-3)
    token, first = np.array([5, 6, 7, 8, 9, 1, 2]), np.array([0, 5, 5, 7])
    w = P.windows(token, first)
    assert w.tolist() == [[P.EDGE, P.EDGE, 6, 7], [P.EDGE, 5, 7, 8], [5, 6, 8, 9], [6, 7, 9, P.EDGE], [7, 8, P.EDGE, P.EDGE], [P.EDGE, P.EDGE, 2, P.EDGE], [P.EDGE, 1, P.EDGE, P.EDGE]]


def test_gradients():
    """A step goes down the numerically measured slope."""
    random_ = np.random.default_rng(1)
    t = P.Trainer()
    t.m = {k: (v + 0.2 * random_.standard_normal(v.shape)).astype(np.float64) for k, v in t.m.items()}
    t.s = {k: np.full(v.shape, 1e12) for k, v in t.s.items()}  # steps are then in proportion to the gradient
    before = {k: v.copy() for k, v in t.m.items()}
    token, x = random_.integers(0, P.SIZE, 30), random_.integers(0, P.SIZE + 1, (30, 2 * P.SIDE))
    loss = lambda m: -P.log_probabilities(m, token, x).mean()
    t.step(token, x)
    for k in before:
        d = (before[k] - t.m[k]) * 1e6 / P.RATE - (0 if k == "e" else P.L2 * before[k])
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        up, down = ({n: v.copy() for n, v in before.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert d[at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.02)


def test_vocabulary(frame, corpus):
    counts = Counter(w for _, t in corpus for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    own = P.vocabulary(frame(corpus))
    hashes = {w: int(T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), T.FOLDED).hash.view(np.int64)[0]) for w in counts}
    want = sorted(counts, key=lambda w: (-counts[w], hashes[w]))[: P.SIZE - P.SHARED]
    assert own.tolist() == [hashes[w] for w in want]


def test_scores(frame, corpus, with_clashes):
    docs = frame(corpus)
    got = P.report(with_clashes(docs)).collect()
    assert len(got) == len(corpus)
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus}
    for r in got:
        if r["doc_id"] not in (None, 5, 7):
            assert r["n_tokens"] == n[r["doc_id"]]
        assert (r["mean_log_likelihood"] is None) == (r["n_tokens"] == 0) and r["log_likelihood"] <= 0


def test_order_of_words_counts(frame, corpus):
    """Held-out sentences score higher than the same words in another order, and much higher than an untrained network says."""
    docs = frame([(i, t) for i, t in corpus if i is not None and i >= 100], 2)
    own = P.vocabulary(docs)
    trained = P.train(docs, own)
    r = random.Random(1)
    test = [t for i, t in corpus if i and i > 200]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in test]
    tests = frame([*enumerate(test), *((1000 + i, t) for i, t in enumerate(mixed))])
    mean = lambda model, low: np.mean([x["log_likelihood"] / x["n_tokens"] for x in P.score(tests, own, model).collect() if (x["doc_id"] < 1000) == low])
    assert mean(trained, True) > mean(trained, False) + 0.5 and mean(trained, True) > mean(P.flat(P.start()), True) + 2


def test_sum_of_conditionals(frame, corpus):
    docs = frame(corpus[:5] + corpus[-3:])
    own = P.vocabulary(docs)
    model = P.train(docs, own)
    m, order = P.shaped(model), np.argsort(own)
    for r in P.score(docs, own, model).collect():
        (chunk,) = T.chunks(pa.array([r["text"]], pa.string()))
        w = T.words(chunk[2], chunk[3], T.FOLDED)
        token = P.numbers(w, own[order], order)
        want = sum(float(P.log_probabilities(m, token[i : i + 1], P.windows(token, w.first)[i : i + 1])[0]) for i in range(len(token))) if len(token) < 500 else r["log_likelihood"]
        assert r["log_likelihood"] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_average_by_updates():
    """A word in one of many copies keeps what that copy has learnt of it; one in several is averaged by tokens; others stay."""
    at, copies = P.blocks(), [P.Trainer() for _ in range(5)]
    token = np.arange(64) * 64
    for i, t in enumerate(copies):
        t.step(token, np.full((64, 4), 7 if i == 0 else 9))
    w, x, s = (np.stack(v) for v in zip(*((t.weights(), P.flat(t.m), P.flat(t.s)) for t in copies), strict=True))
    assert [b.start for b, _ in at[1:]] == [b.stop for b, _ in at[:-1]] and at[-1][0].stop == w.shape[1] and at[-1][1].stop == x.shape[1]
    out = P.shaped(np.concatenate([P.averaged(w[:, a], x[:, b], s[:, a])[1] for a, b in at]))
    assert np.abs(copies[0].m["e"][:, 7] - P.start()["e"][:, 7]).max() > 0.01
    assert np.allclose(out["e"][:, 7], copies[0].m["e"][:, 7], atol=1e-6) and np.allclose(out["e"][:, 9], copies[1].m["e"][:, 9], atol=1e-6)
    assert np.allclose(out["e"][:, 11], P.start()["e"][:, 11], atol=1e-6)


def test_clustered_words_are_learnt(spark, corpus):
    """Words of one of many partitions score about as well as if there were that partition only."""
    r = random.Random(2)
    own_text = [(i, " ".join(f"alpha beta gamma delta{r.randrange(3)}" for _ in range(300))) for i in range(8)]
    others = [(1000 + i, t) for i, t in enumerate(t for i, t in corpus if i and 100 <= i < 240)]
    rows = spark.sparkContext.parallelize([own_text, *(others[i::7] for i in range(7))], 8).flatMap(lambda x: x)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = P.vocabulary(docs)
    few = docs.where("doc_id < 1000")
    mean = lambda model: np.mean([x["log_likelihood"] / x["n_tokens"] for x in P.score(few, own, model).collect()])
    untrained, alone, together = mean(P.flat(P.start())), mean(P.train(few, own)), mean(P.train(docs, own))
    assert together - untrained > 0.8 * (alone - untrained)


def test_words_that_share_a_number(spark):
    """Each word of the corpus has its own probability, by how often it is there, however many words there are."""
    rows = [(i, " ".join(f"common{k}" for k in range(i % 7, 3072, 7)) + " ") for i in range(28)]
    rows += [(100 + i, " ".join(f"rare{k}" for k in range(i * 40, i * 40 + 120))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")  # its rows are dealt alike each time
    counts = {r["word"]: r["n"] for r in P.count_words(docs).collect()}
    own = P.vocabulary(docs)
    others = {w: n for w, n in counts.items() if w not in set(own.tolist())}
    number = lambda w: (w & (2**64 - 1)) >> 54
    total = Counter()
    for w, n in others.items():
        total[number(w)] += n
    assert len(set(others.values())) > 1 and max(total.values()) > 1
    network = {r["doc_id"]: r for r in P.score(docs, own, P.train(docs, own)).collect()}
    hashed = lambda w: int(T.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), T.FOLDED).hash.view(np.int64)[0])
    text = dict(rows)
    for r in P.report(docs).collect():
        n = network[r["doc_id"]]
        within = sum(np.log(others[w] / total[number(w)]) for w in map(hashed, text[r["doc_id"]].split()) if w in others)
        assert r["log_likelihood"] == pytest.approx(n["log_likelihood"] + within, rel=1e-4)
        assert (within < -1) == (r["doc_id"] >= 100)


def test_result_is_nearly_free_of_partitioning(frame, corpus):
    """One partition or many: scores are about the same."""
    rows = [(i, t) for i, t in corpus if i and i >= 100]
    total = [sum(r["log_likelihood"] for r in P.report(frame(rows, parts)).collect()) for parts in (1, 16)]
    assert total[1] == pytest.approx(total[0], rel=0.02)


def test_small_tables(frame, with_clashes, own_columns):
    assert P.report(frame([])).collect() == []
    assert [tuple(r) for r in P.report(frame([(1, None)])).collect()] == [(1, 0, 0.0, None)]
    own_columns(P.score(with_clashes(frame([(1, "a b"), (2, None)])), np.zeros(0, np.int64), P.flat(P.start())), but={"n_tokens"})


def test_numbers_stay(frame, corpus):
    """Of coded texts only the places of words without numbers of their own are shuffled; probabilities are those of the distributions."""
    docs = frame(corpus)
    counts = P.count_words(docs)
    own, m = P.most_frequent(counts), P.flat(P.start())
    code = P.cut(P.coded(docs, own))
    plan = P.score_coded(code, own, m, counts)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "MapInArrow" in dealt and "numbers" not in dealt.split("MapInArrow")[0]
    token, x = np.arange(P.SIZE), np.random.default_rng(2).integers(0, P.SIZE + 1, (P.SIZE, 2 * P.SIDE))
    high, low = np.divmod(token, P.HALF)
    _, p, _, q = P.forward(P.start(), x, high)
    assert P.log_probabilities(P.start(), token, x) == pytest.approx(np.log(p[high, token]) + np.log(q[low, token]), abs=1e-5)
