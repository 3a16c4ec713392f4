"""The join against brute force over all pairs."""

import random
from collections import defaultdict

from tessera.llm.components import components
from tessera.llm.ngram_jaccard import forest_recall, keep_one, near_duplicates, shallowest


def grams(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, near = defaultdict(int), defaultdict(set)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    near[i].add(j)
    comp = {}
    for i in range(len(rows)):
        if i in comp:
            continue
        todo, seen = [i], {i}
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        comp.update({k: low for k in seen})
    return sorted((rows[i][0], links[i], comp[i]) for i in range(len(rows)) if rows[i][0] is not None)


def near_copies(rnd, copies, words=120, edits=3):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 9999)}"
        out.append(" ".join(t))
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    texts = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(1, 150))) for _ in range(60)]
    for _ in range(12):
        texts += near_copies(rnd, rnd.randint(2, 5))
    texts += near_copies(rnd, 40, edits=2)
    texts += [texts[0]] * 4 + ["", "  \n", "a b", "a b", "a b c", "long " * 5000]
    rows = list(enumerate(texts, 100))
    rnd.shuffle(rows)
    return rows


def result(df):
    return sorted((r.doc_id, r.n_links, r.component_id) for r in df.collect() if r.doc_id is not None)


def test_equals_brute_force(docs):
    rows = corpus()
    assert result(near_duplicates(docs(rows))) == brute(rows)


def test_small_blocks_and_null_ids_and_repeats(docs):
    rows = corpus(4) + [(None, "a b"), (None, None), (7, None), (8, "a b"), (8, "a b")]
    found = near_duplicates(docs(rows), block_rows=8)
    assert result(found) == brute(rows)
    assert [(r.class_id, r.n_links) for r in found.collect() if r.doc_id is None] == [(None, 0)] * 2


def test_keep_one_keeps_columns_and_one_of_each_group(docs):
    rows = corpus(5) + [(None, "x"), (None, "x"), (9, "q r s"), (9, "q r s"), (9, "other text")]
    df = docs(rows).selectExpr("*", "1 AS key", "'u' AS unit", "2 AS kept")
    got = keep_one(df)
    assert got.columns == df.columns
    want = {c for _, _, c in brute(rows)}
    ids = [r.doc_id for r in got.collect()]
    assert set(ids) - {None, 9} == want - {9} and ids.count(9) == 2 and ids.count(None) == 2


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_recall_of_prefix_lengths():
    d = shallowest(0.8, 0.99)
    assert forest_recall(0.8, d) >= 0.99 > forest_recall(0.8, d + 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (900, 500), (3, 3), (None, 4), (7, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 500}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
