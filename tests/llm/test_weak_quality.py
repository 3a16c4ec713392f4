"""Weak-label classifier: held-out accuracy on the label table, EM, and edge cases."""

import random

import numpy as np

from tessera.llm import weak_quality as wq
from tests.conftest import SF


def test_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth")
    got = wq.classify(docs).join(labels, "doc_id").toPandas()
    good, bad = got[got.truth == 1], got[got.truth == 0]
    assert good.kept.mean() >= 0.99 and 1 - bad.kept.mean() >= 0.9


def test_expectation_maximisation_recovers_labellers():
    rng = np.random.default_rng(1)
    k, n = len(wq.LABELLERS), 40_000
    bad = rng.random(n) < 0.2
    rates = np.where(bad[:, None], [0.1, 0.7, 0.2], [0.8, 0.05, 0.15])
    pick = rng.random((n, k))
    votes = np.where(pick < rates[:, :1], wq.GOOD, np.where(pick < rates[:, :2].sum(1, keepdims=True), wq.BAD, wq.NOTHING))
    pattern, count = np.unique(votes @ 3 ** np.arange(k), return_counts=True)
    post, share, found = wq.expectation_maximisation(dict(zip(pattern.tolist(), count.tolist())))
    assert abs(share - bad.mean()) < 0.02
    assert np.abs(found[1].mean(axis=0) - [0.1, 0.7, 0.2]).max() < 0.03
    assert ((post[votes @ 3 ** np.arange(k)] > 0.5) == bad).mean() > 0.98


def test_nulls_empty_long_repeats_and_extra_columns(docs):
    clean = "The thing is that anyone can read these words in order, and they end well."
    rnd = random.Random(1)
    long_ = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9))) for _ in range(20000))
    rows = [(i, f"{clean} Number {chr(97 + i % 26)} of the lot.") for i in range(60)]
    rows += [(100 + i, "BUY!! NOW!! " * 30) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, clean), (203, long_), (1, rows[1][1])]
    df = docs(rows).selectExpr("*", "1 AS quality", "'x' AS kept")
    got = wq.keep_good(df)
    assert got.columns == df.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([*range(60), 1, None, 203], key=str)


def test_empty_table(docs):
    assert wq.classify(docs([])).collect() == []


def plain_quality(texts):
    """The whole method over all texts in plain Python: measures, votes, EM text by text, dense regression."""
    import math
    import re

    import xxhash
    bucket = lambda s, seed: 8 + xxhash.xxh3_64_intdigest(s.encode(), seed) % (wq.BUCKETS - 8)

    def measure(t):
        w = t.split()
        wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
        lines = [x for x in t.split("\n") if x]
        letters = [sum(c.isalpha() for c in x) for x in w]
        share = lambda f: sum(map(f, w)) / len(w)
        return [share(lambda x: bool(re.search("[#*$%&|<>]", x))),
                sum(n > 1 and x.upper() == x for x, n in zip(w, letters)) / len(w), share(lambda x: x == "|"),
                share(lambda x: x.endswith("!!")), sum(a == b for a, b in zip(w, w[1:])) / len(w),
                1 - len(set(wins)) / len(wins), 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
                (sum(letters) + 5) / (sum(map(len, w)) + 6)]

    def vote(m):
        out = []
        for name, bad, good in wq.LABELLERS.values():
            x = m[wq.MEASURES.index(name)] * (1 if bad > good else -1)
            bad, good = (bad, good) if bad > good else (-bad, -good)
            out.append(wq.GOOD if x <= good else wq.BAD if x >= bad else wq.NOTHING)
        return out

    used = [t for t in texts if t and t.split()]
    measures = [measure(t) for t in used]
    votes = [vote(m) for m in measures]
    post, before = [0.7 if wq.BAD in v else 0.05 for v in votes], math.inf
    for _ in range(200):
        share = (sum(post) + 1) / (len(post) + 2)
        rate = {}
        for c in (0, 1):
            of = [p if c else 1 - p for p in post]
            for l in range(8):
                for k in range(3):
                    rate[c, l, k] = (sum(p for p, v in zip(of, votes) if v[l] == k) + 0.1) / (sum(of) + 0.3)
        both = [[math.log(share if c else 1 - share) + sum(math.log(rate[c, l, k]) for l, k in enumerate(v))
                 for c in (0, 1)] for v in votes]
        total = [max(a, b) + math.log1p(math.exp(-abs(a - b))) for a, b in both]
        post = [math.exp(b - t) for (_, b), t in zip(both, total)]
        if abs(sum(total) - before) <= 1e-9 * max(1.0, abs(sum(total))):
            break
        before = sum(total)
    x = np.zeros((len(used), wq.BUCKETS))
    for row, (t, m) in enumerate(zip(used, measures)):
        w = t.split()
        x[row, :8] = m
        for word in w:
            x[row, bucket(word, 0)] += 1 / len(w)
            x[row, bucket(wq.shape(word), 1)] += 1 / len(w)
    label, weights, at = 1 - np.array(post), np.zeros(wq.BUCKETS), np.zeros(wq.BUCKETS)
    intercept = at_i = 0.0
    speed, step = 1.0, 4 / ((x ** 2).sum(axis=1).max() + 1)
    for _ in range(150):
        gap = 1 / (1 + np.exp(-(x @ at + at_i))) - label
        new, new_i = at - step * (x.T @ gap / len(used) + 1e-4 * at), at_i - step * gap.mean()
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        at, at_i = new + (speed - 1) / faster * (new - weights), new_i + (speed - 1) / faster * (new_i - intercept)
        weights, intercept, speed = new, new_i, faster
    score = dict(zip(used, 1 / (1 + np.exp(-(x @ weights + intercept)))))
    return [score.get(t, 0.0) for t in texts]


def test_scores_equal_the_method_in_plain_python(docs):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 8)))
    texts = [" ".join(word() for _ in range(rnd.randint(3, 60))).capitalize() + "." for _ in range(50)]
    texts += ["BUY!! NOW!! $$$ " * rnd.randint(1, 9) for _ in range(8)] + ["home | about | login | home"] * 3
    texts += ["same line\n" * 6 + word(), "again again again " * 4, "12 34 56 ## ** 78", None, "", " \n", "Ünï | ñ!! ß"]
    got = {r.doc_id: r for r in wq.classify(docs(list(enumerate(texts)))).collect()}
    want = plain_quality(texts)
    assert all(abs(got[i].quality - q) < 1e-4 and got[i].kept == (got[i].quality >= 0.3) for i, q in enumerate(want))
    assert {got[i].kept for i in range(len(texts))} == {True, False}
