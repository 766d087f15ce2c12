"""The network's gradients against differences, its scores against window by window, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import toxicity


def corpus(count=240, seed=0):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for n in range(count):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 120]))]
        if n % 3 == 0:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(["vile!", "Nasty", "rotten,"])
        texts.append(" ".join(words).encode())
        labels.append(int(n % 3 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    return toxicity.train(*corpus())


def test_held_out(net):
    texts, labels = corpus(150, seed=1)
    assert np.mean((toxicity.scores(net, texts) >= 0.5) == np.array(labels)) > 0.95


def test_toxic_words_anywhere_in_a_long_text(net):
    calm = b"lorn ader " * 4000
    at = len(calm) // 2 // 10 * 10
    assert toxicity.scores(net, [calm])[0] < 0.5 < toxicity.scores(net, [calm[:at] + b"vile nasty rotten " + calm[at:]])[0]


def test_score_is_the_highest_window(net):
    texts = corpus(30, seed=2)[0] + [b"", None, b"one"]
    cache = {}
    for text, score in zip(texts, toxicity.scores(net, texts, cache), strict=True):
        words = toxicity.words_of(text)
        each = []
        for start in toxicity.windows(len(words)):
            part = words[start:start + toxicity.WINDOW]
            x = np.zeros((1, toxicity.WINDOW, toxicity.INPUTS), np.float32)
            if part:
                x[0, :len(part)] = net.inputs(part)
            each.append(toxicity.run(net, x, np.arange(toxicity.WINDOW)[None] < len(part))[0])
        assert score == pytest.approx(float(toxicity.sigmoid(max(each))), abs=1e-4)


@pytest.mark.parametrize("count", [0, 1, 32, 33, 56, 57, 1000])
def test_windows_cover_and_overlap(count):
    starts = toxicity.windows(count)
    assert starts[0] == 0 and (count <= toxicity.WINDOW or starts[-1] == count - toxicity.WINDOW)
    assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_gradients():
    rng = np.random.default_rng(3)
    net = toxicity.train(*corpus(60), epochs=1, steps=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x = rng.normal(size=(3, toxicity.WINDOW, toxicity.INPUTS))
    real = np.arange(toxicity.WINDOW) < np.array([[32], [5], [17]])
    x[~real] = 0
    target = np.array([1.0, 0.0, 1.0])
    g, dx, _ = toxicity.gradients(net, x, real, target)
    for name in ("x0", "u0", "b1", "u1", "query", "out", "bias"):
        place = tuple(rng.integers(s) for s in g[name].shape)
        loss = []
        for sign in (1, -1):
            net.weights[name][place] += sign * 1e-2
            loss.append(toxicity.gradients(net, x, real, target)[2])
            net.weights[name][place] -= sign * 1e-2
        assert g[name][place] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3, rel=0.05)
    assert not dx[~real].any()


def test_one_class_or_none():
    assert toxicity.train([], []).constant == 0.0
    assert toxicity.train([b"a"], [1]).constant == 1.0
    assert toxicity.scores(toxicity.train([], []), [b"x", None]).tolist() == [0.0, 0.0]


def test_sample_is_bounded_and_clean(spark):
    docs = spark.createDataFrame([(n, f"text {n}", 1) for n in range(50)] + [(None, "x", 1), (3, None, 1), (60, "y" * 9000, 1), (4, "text 4", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(n, n % 2) for n in range(61)] + [(5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    texts, marks = toxicity.training_sample(docs, labels, F.col("doc_id") % 5 != 0, sample=5)
    assert marks.count(1) == 5 and marks.count(0) == 15 and len(set(texts)) == 20
    assert all(int(t.split()[1]) % 5 and int(t.split()[1]) % 2 == y for t, y in zip(texts, marks, strict=True))


def test_query(spark):
    from equiloom.llm.queries import op10_toxicity

    directory = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    found = op10_toxicity(spark, directory).collect()
    assert len(found) == spark.read.parquet(f"{directory}/documents.parquet").count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
