"""Rows of keys met in two documents, against a count in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import shared_keys
from tessera.llm.shared_keys import PACKED, packed, shared_rows

SCHEMA = {"key": "long", "doc_id": "long", "at": "int", "gone": "boolean"}


def shared(spark, rows):
    """``shared_rows`` over rows dealt to four tasks."""
    def run(batches):
        for b in batches:
            yield [b.column(c).to_numpy(zero_copy_only=False) for c in SCHEMA]
    df = spark.createDataFrame(rows, "key long, doc_id long, at int, gone boolean").repartition(4)
    return shared_rows(df.mapInArrow(lambda b: packed(run(b)), PACKED), SCHEMA)


@pytest.mark.parametrize("at_once", [50, 200_000])
def test_rows_of_keys_met_in_two_documents(spark, monkeypatch, at_once):
    monkeypatch.setattr(shared_keys, "ROWS_AT_ONCE", at_once)
    rnd = random.Random(5)
    rows = [(rnd.randint(-400, 400), rnd.choice([-2**40, *range(300)]), n, n % 3 == 0) for n in range(900)]
    rows += [(2**62, n % 90, n, False) for n in range(500)]         # a key of many documents
    rows += [(-2**62, 7, n, True) for n in range(500)]              # and one of a single document
    rows += rows[:20]
    docs = defaultdict(set)
    for key, doc, *_ in rows:
        docs[key].add(doc)
    want = sorted(r for r in rows if len(docs[r[0]]) > 1)
    got = shared(spark, rows)
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(rows)
    assert got.columns == list(SCHEMA)


def test_no_rows(spark):
    assert shared(spark, []).collect() == []


def test_a_hot_bucket_is_worked_on_in_parts(monkeypatch):
    """Few buckets: rows that met nothing wait, and those that come later still find them."""
    monkeypatch.setattr(shared_keys, "BUCKETS", 2)
    monkeypatch.setattr(shared_keys, "PACK_ROWS", 40)
    monkeypatch.setattr(shared_keys, "ROWS_AT_ONCE", 100)
    key = np.r_[np.arange(1000), np.arange(0, 1000, 7), np.full(300, -5)]
    doc = np.r_[np.zeros(1000, np.int64), np.ones(len(key) - 1300, np.int64), np.arange(300)]
    parts = [[key[n:n + 10], doc[n:n + 10]] for n in range(0, len(key), 10)]
    packs = pa.Table.from_batches(packed(parts)).sort_by("bucket").to_batches(3)
    out = list(shared_keys._shared(packs, [np.dtype(np.int64)] * 2))
    got = sorted((int(k), int(d)) for k_, d_ in out for k, d in zip(k_, d_))
    assert got == sorted([(k, d) for k in range(0, 1000, 7) for d in (0, 1)] + [(-5, d) for d in range(300)])
    assert len(out) > 3 and sum(len(k) for k, _ in out) == len(got)
