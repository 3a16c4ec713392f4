"""Counts against the libraries, and the cache."""

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts as tc

TEXTS = ["Hello world, it's fine.", "", "a <|endoftext|> b", "naïve Straße 漢字 🙂 \x00 \t\n  x", "word " * 30000,
         "Hello world, it's fine."]


def rows():
    return [*enumerate(TEXTS), (None, "no id"), (7, None), (0, TEXTS[0])]


def want(count, limit=1024):
    return sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > limit) for d, t in rows()), key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, name):
    if name.endswith(".json"):
        tokenizer = Tokenizer.from_file(P.path(name))
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(model.encode(t))
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS n_tokens")
    assert sorted(map(tuple, tc.count_tokens(df, tokenizer=P.path(name)).collect()), key=str) == want(count)


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    first = sorted(map(tuple, tc.count_tokens(df, cache=cache).collect()), key=str)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows()})
    # a stored count is used, not made again
    more = spark.createDataFrame(rows() + [(50, "one new text")], "doc_id long, text string")
    again = sorted(map(tuple, tc.count_tokens(more, cache=cache).collect()), key=str)
    assert set(first) < set(again) and spark.read.parquet(cache).count() == stored.count() + 1
    # another tokenizer has its own counts
    tc.count_tokens(df, cache=cache, tokenizer=P.path("word_bpe_49k.json")).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(df).collect() == []
