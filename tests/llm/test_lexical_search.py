"""Ranked search against a plain one over all documents, and the defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexical_search
from tessera.llm.lexical_search import Bucket, Query, ranked, terms

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    return [lower(w) for w in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """(item, rank, doc, score) of lists of (id, text)."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                    ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in ranked(d, q, **kw).select("item_id", "rank", "doc_id", "score").collect())


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.9)) % 400}" for _ in range(3000)] + ["Ünï", "中文", "A1", "b"]
    text = lambda size: " ".join(rng.choice(vocabulary) for _ in range(size))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(n)]
    items = [(i, text(rng.choice([1, 4, 20]))) for i in range(15)]
    docs += [(n + i, f"{text(20)}. {t}") for i, (_, t) in enumerate(items)]
    return docs, items


def test_terms_are_those_of_the_pattern():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x500), 0x4E2D, 0x1F600]))
                       for _ in range(40))
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("seed, bucket", [(1, 7), (2, 64), (3, 2048)])
def test_equals_scoring_every_document(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", bucket)
    docs, items = corpus(400, seed)
    assert found(spark, docs, items) == plain(docs, items)


def test_passes_over_few_queries_give_the_same(spark):
    docs, items = corpus(60, 4)
    assert found(spark, docs, items, query_bytes=700, k=3) == plain(docs, items, 3)


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(i, "same text here") for i in range(30, 0, -1)] + [(7, "same text here"), (None, "same only null"),
            (90, None), (91, ""), (92, " .,;"), (93, "long " * 150_000 + "text"), (94, "SAME Same same")]
    items = [(1, "same text"), (1, "same text"), (None, "long"), (2, None), (3, ""), (4, "nowhere"), (5, "null here")]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked(d, q).collect()]
    want = []
    for item in items:
        want += plain(docs, [item])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_clashing_columns_and_empty_tables(spark):
    docs, items = corpus(40, 6)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    for c in ["id", "no", "n", "terms", "tfs", "norm", "part", "score", "rank", "m", "item"]:
        d, q = d.withColumn(c, F.lit("x")), q.withColumn(c, F.lit("x"))
    assert sorted(tuple(r) for r in ranked(d, q).collect()) == plain(docs, items)
    assert ranked(d.where("false"), q).collect() == [] and ranked(d, q.where("false")).collect() == []


def test_bounds_leave_work_out():
    """A threshold shortens the work; what scores at or above it survives."""
    rng = np.random.default_rng(8)
    size = rng.integers(1, 40, 500)
    term = np.concatenate([rng.choice(300, s, replace=False) for s in size]).astype(np.int64)
    impact = rng.integers(1, 1_000_000, len(term))
    norm = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, np.cumsum(size) - size))
    bucket = Bucket(np.arange(500), norm, term, impact, size)
    q = Query(0, np.arange(0, 300, 15), rng.integers(1, 9000, 20), 0, 10)
    dense = np.zeros(300, np.int64)
    scores = bucket.scores(q, np.arange(500), dense)
    q.least = int(np.sort(scores)[-10])
    rows = bucket.survivors(q)
    assert set(np.flatnonzero(scores >= q.least)) <= set(rows)
    assert len(rows) < (scores > 0).sum() / 2
