import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import toxicity
from pagegrain.llm.wordhash import Words, chunks

LABEL = "doc_id long, toxic int"


def corpus(n, share=0.15, seed=1):
    """Documents of random words; toxic ones hold words of a stem."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(5, 80)).tolist()
        bad = rng.random() < share
        if bad:
            for _ in range(rng.integers(1, 4)):
                words[rng.integers(len(words))] = "grumpf" + rng.choice(["", "er", "ling", "ig"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_from_few_labels(spark):
    docs, labels = corpus(3000)
    known = [x for x in labels if x[0] % 2]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), dict(labels)
    model = toxicity.train(d, spark.createDataFrame(known, LABEL))
    rows = toxicity.with_toxicity(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hidden = [r for r in rows if r.held]
    right = [(r.toxicity >= 0.5) == bool(y[r.doc_id]) for r in hidden]
    assert sum(right) >= 0.97 * len(hidden)
    caught = [r.toxicity >= 0.5 for r in hidden if y[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = [(i, 1 - y if i in held else y) for i, y in labels]
    a = toxicity.train(d, spark.createDataFrame(labels, LABEL))
    b = toxicity.train(d, spark.createDataFrame(turned, LABEL))
    assert a.bias == b.bias and (a.buckets == b.buckets).all() and (a.weights == b.weights).all()


def slow_model(docs, labels):
    """The same learning in one process, over dense rows of plain sets."""
    fold = lambda i: i is None or zlib.crc32(str(i).encode()) % toxicity.FOLDS == 0
    bad = {i for i, y in labels if y == 1 and not fold(i)}
    sets = [(i in bad, set(toxicity.features(t).tolist())) for i, t in docs if not fold(i)]
    n, m = sum(b for b, _ in sets), len(sets)
    count = lambda rows: {f: sum(f in s for _, s in rows) for f in set().union(*(s for _, s in rows))}
    u, p = count(sets), count([r for r in sets if r[0]])
    kept = sorted(f for f in p if p[f] >= 3 and p[f] - u[f] * n / m >= 3 * np.sqrt(u[f] * n / m + 1))
    ratio = {f: u[f] / m / (p[f] / n) for f in kept}
    prior = ratio[min(kept, key=lambda f: ratio[f] * (1 + 2 * np.sqrt(1 / p[f] + 1 / u[f])))]
    prior = min(max(prior, 1e-4), 0.9)
    x = np.array([[f in s for f in kept] + [True] for _, s in sets], float)
    toxic = np.array([b for b, _ in sets])
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - prior))
    first = second = np.zeros(len(w))
    turned = 0
    for step in range(1, toxicity.EPOCHS + 1):
        z = x @ w
        # the operator sums whole numbers of 2 ** -24
        as_clean, probable = (np.rint(v * 2**24) / 2**24 for v in (np.log1p(np.exp(z)), 1 / (1 + np.exp(-z))))
        risk_clean = as_clean.mean() - prior * as_clean[toxic].mean()
        slope_u, slope_p = (probable[:, None] * x).mean(0), (probable[:, None] * x)[toxic].mean(0)
        if risk_clean >= 0:
            # -log sigmoid as toxic: its slope is probable - 1
            slope = prior * ((probable - 1)[:, None] * x)[toxic].mean(0) + slope_u - prior * slope_p
            slope[:-1] += toxicity.DECAY * w[:-1]
        else:
            slope = prior * slope_p - slope_u
            turned += 1
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - toxicity.RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return prior, kept, w, turned


@pytest.mark.parametrize("seed, share", [(1, 0.15), (5, 0.4)])
def test_training_matches_a_slow_version(spark, seed, share):
    docs, labels = corpus(500, share, seed)
    docs += docs[:40] + [(None, "grumpf w1"), (9001, None), (9001, "")]
    prior, kept, w, _ = slow_model(docs, labels)
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, LABEL))
    assert model.buckets.tolist() == kept
    assert model.weights == pytest.approx(w[:-1], abs=1e-3) and model.bias == pytest.approx(w[-1], abs=1e-3)
    assert share / 2 < prior < 2 * share


def test_order_and_partitions_change_nothing(spark):
    docs, labels = corpus(700)
    y = spark.createDataFrame(labels, LABEL)
    made = [toxicity.train(spark.createDataFrame(d, "doc_id long, text string").repartition(p), y) for d, p in ((docs, 1), (docs[::-1], 7))]
    assert made[0].bias == made[1].bias and (made[0].weights == made[1].weights).all()


def test_risk_step_back_keeps_the_fit_finite():
    # a prior far too large makes the corrected risk negative
    rng = np.random.default_rng(0)
    texts = [rng.choice(300, 40, replace=False) for _ in range(340)]
    flat = lambda rows: (np.concatenate(rows), np.array([len(r) for r in rows]))
    sums = lambda w, bias: np.array([toxicity.partial_sums(*flat(rows), w, bias) for rows in (texts[:40], texts)])
    bias, w = toxicity.fit(sums, np.bincount(np.concatenate(texts[:40]), minlength=300), 40, 340, 0.9)
    assert np.isfinite(w).all() and np.isfinite(bias)


def test_the_querys_held_out_quality(spark, sf):
    from pagegrain.llm.queries import op6_toxicity

    large = f"{os.path.dirname(sf)}/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, large).collect() if r.held_out and truth.get(r.doc_id) is not None]
    right = [r.predicted == truth[r.doc_id] for r in rows]
    caught = [r.predicted == 1 for r in rows if truth[r.doc_id]]
    assert sum(right) >= 0.95 * len(right) and sum(caught) >= 0.7 * len(caught) > 0


def test_long_texts_and_clashing_names(spark):
    docs, labels = corpus(300)
    docs += [(7001, "word " * 400_000), (7002, "z" * 500_000)]
    d = spark.createDataFrame([(i, t, 1, 1.0, "k") for i, t in docs], "doc_id long, text string, toxic int, toxicity double, k string")
    rows = toxicity.with_toxicity(d, toxicity.train(d, spark.createDataFrame(labels, LABEL))).collect()
    assert len(rows) == len(docs) and all(0 <= r.toxicity <= 1 and r.toxic == 1 and r.k == "k" for r in rows)


def test_word_hashes_do_not_depend_on_place():
    for data in (b"one two  three-four, 5", b"x" * 200_000 + b" y"):
        found = [h for c in chunks(data) for h in Words(c).hashes().tolist()]
        if len(data) < 100:
            alone = [Words(np.frombuffer(w, np.uint8)).hashes()[0] for w in (b"one", b"two", b"three", b"four", b"5")]
            assert found == alone
        assert len(Words(np.empty(0, np.uint8)).hashes()) == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(None, 1), (7, None)]])
def test_nothing_to_learn_from(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (3, "a b"), (3, "a b")], "doc_id long, text string")
    rows = toxicity.with_toxicity(d, toxicity.train(d, spark.createDataFrame(labels, LABEL)), out="text_score").collect()
    assert len(rows) == 5 and all(0 <= r.text_score < 0.5 for r in rows)
    empty = d.limit(0)
    assert toxicity.with_toxicity(empty, toxicity.train(empty, spark.createDataFrame(labels, LABEL))).count() == 0
