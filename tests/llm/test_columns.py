"""Operators that pass columns on, with input columns named like everything they use inside."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, mixing, ngram_jaccard, shuffle_shards, substring_dedup, weak_quality

NAMES = ["_s", "_h", "_source", "_hash", "_cut", "_cut_id", "_id", "_nd_key", "_nd_text", "_nd_id", "_nd_hash", "_quality",
         "_row", "_nth", "_bucket", "_place", "_size", "_crc", "shard", "slot", "ids", "decoded", "quality", "key", "size",
         "_times", "_one", "_mix_cut", "place", "a b", "c.d", "tick`", "src_slot", "__column0__"]


def text(i):
    return " ".join(f"word{i}x{j}" for j in range(30)) + ". The next line of it says something else.\nAnd it ends here."


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, text(i % 9), "en", f"s{i % 2}", 5) for i in range(12)] + [(None, text(3), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(f"v{n}"))
    return df


def values(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


KEEP = {"op1": ngram_jaccard.keep_one, "op4": mixing.mix, "op6": weak_quality.keep_good, "op9": substring_dedup.remove_repeats}


@pytest.mark.parametrize("name", KEEP)
def test_filters_pass_clashing_columns_on(spark, wide, name):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = values(KEEP[name](wide.select(*own)), own)
    out = KEEP[name](wide)
    assert out.columns == wide.columns
    assert values(out, own) == plain and plain
    assert {tuple(r[c] for c in NAMES) for r in out.collect()} == {tuple(f"v{n}" for n in range(len(NAMES)))}


def test_added_columns_do_not_replace_those_of_the_input(spark, wide):
    both = byte_bpe.decode(byte_bpe.encode(wide, ids="ids"), ids="ids", out="decoded").collect()
    assert all(bytes(r["decoded"]).decode() == r["text"] for r in both)
    assert {(r["src_ids"], r["src_decoded"], r["_s"]) for r in both} == {
        (f"v{NAMES.index('ids')}", f"v{NAMES.index('decoded')}", "v0")}
    shuffled = shuffle_shards.shuffled_table(wide.drop("src_slot"), shards=3).collect()
    assert sorted(r["slot"] * 3 + r["shard"] for r in shuffled) == list(range(13))
    assert {(r["src_slot"], r["src_shard"], r["src__size"], r["_bucket"]) for r in shuffled} == {
        tuple(f"v{NAMES.index(c)}" for c in ("slot", "shard", "_size", "_bucket"))}


def test_quality_model_without_ids_learns_from_the_texts(spark):
    rows = [(None, text(i) if i % 2 else "buy $$$ ### now !!! " * 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    with_ids = df.withColumn("doc_id", F.monotonically_increasing_id())
    rated = [{(r["quality"] > 0.5) for r in weak_quality.classify(d).collect()} for d in (df, with_ids)]
    assert rated[0] == rated[1] and weak_quality.fit(df).trained_on > 0
