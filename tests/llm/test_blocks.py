"""Pairs and intersections of units of work, against plain loops."""

import numpy as np

from tessera.llm import blocks, shingles


def test_pairs_and_intersections(monkeypatch):
    rnd = np.random.default_rng(1)
    for at_once in (50, 1_000_000):
        monkeypatch.setattr(blocks, "VALUES_AT_ONCE", at_once)
        for n in range(30):
            size = [*rnd.integers(1, 7, n).tolist(), *[30] * (n % 3 == 0)]
            unit = np.repeat(np.arange(len(size)), size)
            diagonal = np.repeat(rnd.integers(0, 2, len(size)).astype(bool), size)
            block = rnd.integers(4, 6, len(unit))
            sets = [np.unique(rnd.integers(0, 12, rnd.integers(0, 9)).astype(np.uint64)) for _ in unit]
            i, j = blocks.pairs(unit, block, diagonal)
            want = sorted((a, b) for a in range(len(unit)) for b in range(len(unit)) if unit[a] == unit[b] and (
                a < b if diagonal[a] else block[a] < block[b]))
            assert sorted(zip(i.tolist(), j.tolist())) == want
            assert blocks.unit_intersections(sets, unit, i, j).tolist() == [
                len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]


def test_shingle_sets_of_many_texts():
    texts = [b"", b"a", b"a b c", b"a b c d e", b"a b c d e a b c d e a b", b" ", b"x x x x x x x x"]
    for some in (texts, texts[:1], [], texts[2:]):
        assert [s.tolist() for s in shingles.shingle_sets(some, 5)] == [shingles.shingle_set(t, 5).tolist() for t in some]
