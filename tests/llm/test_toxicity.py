import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartweave.llm import toxicity


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    r, rows, labels = random.Random(4), list(odd_rows), []
    for i in range(600):
        toxic, words = i % 6 == 0, prose(i, r.choice([15, 40, 120])).split()
        for _ in range(4 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["you vile fool", "shut up idiot", "vile idiot"]))
        if not toxic and r.random() < 0.3:
            words.insert(0, "shut the door")
        rows.append((100 + i, " ".join(words)))
        labels.append((100 + i, int(toxic)))
    return rows, [*labels, (None, 1), (100, None), (99999, 1), (101, 0)]


@pytest.fixture
def tables(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id long, text string").repartition(4), spark.createDataFrame(corpus[1], "doc_id long, toxic int")


def test_held_out_accuracy(tables, with_clashes):
    docs, labels = tables
    out = toxicity.report(with_clashes(docs), labels)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    held = out.where("held_out").join(labels.where("toxic is not null"), "doc_id").select("toxic", "predicted").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in held)
    assert len(held) > 150 and hit >= 0.9 * sum(r["toxic"] for r in held) and hit >= 0.9 * sum(r["predicted"] for r in held)


def test_labels_of_the_fold_are_not_used(tables):
    docs, labels = tables
    before = {tuple(r) for r in toxicity.report(docs, labels).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {tuple(r) for r in toxicity.report(docs, turned).collect()} == before
    assert {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()} == {r["doc_id"] for r in docs.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}


def test_scores_as_row_by_row(tables, corpus):
    docs, labels = tables
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    weight = np.zeros(1 << toxicity.BITS)
    weight[model["place"]] = model["weight"]
    assert 0 < len(model["place"]) < 5000
    got = {r["text"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    for text in got:
        (x,) = toxicity._rows(pa.array([text], pa.string()))
        assert got[text] == pytest.approx(1 / (1 + np.exp(-np.clip(weight[x].sum() + model["bias"], -30, 30))))


def test_fit_as_coordinate_by_coordinate():
    """FTRL-proximal as published: one coordinate at a time, in a dictionary."""
    r = random.Random(9)
    rows = [np.unique(np.array([r.randrange(40) for _ in range(r.randrange(12))], np.uint32)) for _ in range(120)]
    labels = np.array([float(any(x in (3, 7) for x in row) or r.random() < 0.05) for row in rows])
    share, l1 = labels.mean(), toxicity.L1 * len(rows) ** 0.5
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2)

    def learnt(z, n, g, w):
        return z + g - ((n + g * g) ** 0.5 - n**0.5) / toxicity.ALPHA * w, n + g * g

    order = np.random.default_rng(1)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            own = {x: weight(z.get(x, 0.0), n.get(x, 0.0), l1) for x in rows[k].tolist()}
            b = weight(*bias, 0.0)
            p = 1 / (1 + np.exp(-np.clip(sum(own.values()) + b, -30, 30)))
            g = (p - labels[k]) * (0.5 / share if labels[k] else 0.5 / (1 - share))
            for x, w in own.items():
                z[x], n[x] = learnt(z.get(x, 0.0), n.get(x, 0.0), g, w)
            bias = learnt(*bias, g, b)
    got, b = toxicity.fit(rows, labels)
    assert [got[x] for x in range(40)] == pytest.approx([weight(z.get(x, 0.0), n.get(x, 0.0), l1) for x in range(40)]) and b == pytest.approx(weight(*bias, 0.0))
    assert np.count_nonzero(got) < 40 and got[[3, 7]].min() > 0.5


def test_one_text_for_each_doc_id(spark, tables):
    """Any number of rows with a doc_id teach as one row does."""
    docs, labels = tables
    some = docs.where("doc_id >= 100").orderBy("doc_id").limit(200)
    again = some.union(some).union(some.where("doc_id = 100")).union(some.where("doc_id = 101").withColumn("text", F.concat("text", F.lit(" zzz"))))
    one, more = toxicity.learn(some.where("doc_id <> 101"), labels), toxicity.learn(again.where("doc_id <> 101"), labels)
    assert one["place"].tolist() == more["place"].tolist() and one["weight"].tolist() == more["weight"].tolist()


def test_features_are_words_pairs_and_skips():
    rows = list(toxicity._rows(pa.array(["one two three", "One, TWO; three!", "three", None, "one three"])))
    assert len(rows[0]) == 3 + 2 + 1 and (rows[0] == rows[1]).all() and len(rows[2]) == 1 and len(rows[3]) == 0 and len(rows[4]) == 3
    assert len(np.intersect1d(rows[0], rows[4])) == 2  # a skip-gram is no pair of neighbours


def test_missing_parts(spark, tables, odd_rows):
    docs, labels = tables
    assert toxicity.report(docs.limit(0), labels).collect() == []
    none = toxicity.report(docs, labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {0}
    one_class = toxicity.report(docs, labels.where("toxic = 1"))
    assert {r["predicted"] for r in one_class.collect()} == {1}


def test_columns_pass(tables, with_clashes, own_columns):
    own_columns(toxicity.score(with_clashes(tables[0].limit(5)), {"place": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": 0.0}), but={"toxicity"})
