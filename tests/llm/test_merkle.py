"""The manifest against a plain one built with hashlib, and the defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.merkle import COLUMNS, folded, manifest, manifest_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    entry = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[entry(row[c]) for c in COLUMNS])


def climb(nodes, k):
    """Root and each node's siblings, level by level, as (before, after)."""
    at, found = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for n, i in enumerate(at):
            a = i - i % k
            found[n].append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + k])))
        nodes, at = [H(*nodes[a:a + k]) for a in range(0, len(nodes), k)], [i // k for i in at]
    return nodes[0], found


def plain(rows, k=2):
    """Sorted (doc_id, leaf, subroot, root, proof, folded) of rows given as dicts."""
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs.append(climb([leaf(r) for r in groups[g]], k))
    root, upper = climb([s[0] for s in subs], k)
    out = []
    for g, (sub, found), high in zip(order, subs, upper):
        for r, own in zip(groups[g], found):
            path = own + high
            t = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf({**r, "n_chars": r["n_chars"] + 1} if t and r["n_chars"] is not None else r)
            for a, b in path:
                node = H(a, node, b)
            out.append((r["doc_id"], leaf(r), sub, root, H(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def rows(n, seed=3):
    rng = random.Random(seed)
    made = [{"doc_id": i, "text": " ".join(rng.choice(["ä", "b", "中文", "d"]) for _ in range(rng.randrange(9))),
             "lang": rng.choice(["en", "en", "en", "de", "zé", None]), "source": rng.choice(["s", None]),
             "n_chars": rng.choice([None, 4, 70])} for i in range(n)]
    return made


def frame(spark, made):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in made], SCHEMA)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 77])
def test_equals_a_plain_manifest(spark, n):
    made = rows(n)
    assert result(manifest_table(frame(spark, made))) == (plain(made) if made else [])


def test_ties_repeats_nulls_and_long_texts(spark):
    made = rows(9) + rows(9)[:4] + [
        {"doc_id": 3, "text": None, "lang": "en", "source": "x", "n_chars": 1},
        {"doc_id": None, "text": "", "lang": None, "source": None, "n_chars": None},
        {"doc_id": None, "text": "word " * 60_000, "lang": "en", "source": "", "n_chars": 300_000}]
    assert result(manifest_table(frame(spark, made))) == plain(made)


def test_other_columns_take_no_part(spark):
    made = rows(20)
    names = ["grp", "idx", "size", "hash", "left", "right", "path", "_at", "_part", "key", "leaf", "root", "changed"]
    extra = frame(spark, made).withColumns({c: F.lit(n) for n, c in enumerate(names)})
    assert result(manifest_table(extra)) == plain(made)


def test_larger_fanout_and_folding(spark):
    made = rows(64)
    got = manifest(frame(spark, made), fanout=3).withColumn("end", folded(F.col("leaf"), F.col("path"))).collect()
    want = {r[:4] for r in plain(made, 3)}
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in got} == want
    assert all(r["end"] == r["root"] for r in got)
    with pytest.raises(ValueError):
        manifest(frame(spark, made), fanout=1)


def test_many_groups(spark):
    made = [{"doc_id": i, "text": str(i), "lang": f"l{i % 23}", "source": "s", "n_chars": i} for i in range(60)]
    assert result(manifest_table(frame(spark, made))) == plain(made)
