"""Mixing against a plain computation of targets and of the histogram thresholds."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, left = 1.5 * sum(size.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * size[s]}
        if not over:
            return target | share
        target.update({s: 2.0 * size[s] for s in over})
        left -= over
    return target


def corpus(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["a", "b", "b", "b", "c", "d", None])
        rows.append((i, " ".join(["w"] * rnd.randint(0, 40)), source))
    return rows + [(9000, None, "a"), (9001, "", "e"), (None, "x y z", "a"), (9002, "w\x0bw w", "c")]


@pytest.mark.parametrize("limit", [mixing.BROADCAST_BYTES, 0])
def test_targets_and_taken(docs, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
    rows = corpus(1)
    got = mixing.mix_table(docs(rows)).collect()
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    target = brute_targets(size)
    source_of = {d: s for d, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix_table(docs(list(reversed(rows)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_threshold_is_a_prefix_of_places(docs):
    rows = corpus(2)
    got = {r.doc_id: r for r in mixing.mix_table(docs(rows)).collect()}
    for source in ("a", "b", "c", "d"):
        places = sorted((hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()[:9], got[d].copies)
                        for d, t, s in rows if s == source)
        copies = [c for _, c in places]
        assert copies == sorted(copies, reverse=True)


def test_mix_repeats_rows_and_keeps_columns(docs):
    rows = corpus(3)
    df = docs(rows).selectExpr("*", "1 AS size", "2 AS taken", "3 AS copies")
    out = mixing.mix(df)
    assert out.columns == df.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    assert times == {r.doc_id: r.copies for r in mixing.mix_table(df).collect() if r.copies}


def test_empty_and_all_empty(docs):
    assert mixing.mix_table(docs([])).collect() == []
    got = mixing.mix_table(docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_equal_rows_come_near_the_target(docs):
    """A thousand equal rows, alone or as a third of a source: taken within one document of the target."""
    for rows in ([(7, "one two three", "a")] * 1000, [(7, "one two three", "a")] * 300 + corpus(5)):
        got = mixing.mix_table(docs(rows)).collect()
        by_source = defaultdict(list)
        for r in got:
            by_source[r.source_size].append(r)
        for same in by_source.values():
            assert abs(sum(r.taken for r in same) - same[0].target) <= max(1, max(r.size for r in same))
    rows = [(7, "one two three", "a")] * 1000 + [(8, "x " * 5000, "b")]
    taken = sum(r.size * r.copies for r in mixing.mix_table(docs(rows)).collect() if r.doc_id == 7)
    df = docs(rows)
    assert abs(mixing.mix(df).where("doc_id = 7").count() * 3 - taken) <= 300
