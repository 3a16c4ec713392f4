"""Byte-level BPE against the public library on the same rank file."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import byte_bpe
from tessera.llm.byte_bpe import ByteBpe, parse_ranks

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(DATA), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(DATA, P.PATTERN)


def test_random_texts_match_the_library_and_round_trip(bpe):
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "22", "!", " the", "'s", "'ll", "漢字", "🙂",
             "\x00", "\x85", "\x1c", "\xa0", "_", "x" * 40, "<|endoftext|>", "²", "Ⅷ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(1500)]
    texts += ["", " ", "   ", "\n\n", "a" * 1500, " " * 300, "ab" * 1200 + " x", " lead", "trail ", "a  b"]
    got = bpe.encode(texts)
    assert [g.tolist() for g in got] == [LIB.encode_ordinary(t) for t in texts]
    assert bpe.decode(got) == [t.encode() for t in texts]


def test_heap_contraction_equals_the_recursive_query(bpe):
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"etaoin shrdlu") for _ in range(rnd.randint(2, 60))) for _ in range(300)]
    assert [bpe._contract(w) for w in words] == [LIB._encode_single_piece(w) for w in words]


def test_memo_can_be_cleared_between_batches(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    texts = ["one two three four five", "two three", "", "six one"]
    for _ in range(3):
        assert [g.tolist() for g in bpe.encode(texts)] == [LIB.encode_ordinary(t) for t in texts]


def test_operator_round_trip_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Hello world, it's  fine.\n", "x"), (1, "Hello world, it's  fine.\n", "x"),
            (None, "no id", "y"), (3, None, None), (4, "", "z"), (5, "word " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.round_trip(df).collect()), key=str)
    want = []
    for doc, text, _ in rows:
        ids = LIB.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = byte_bpe.decode(byte_bpe.encode(df, ids="token_ids"), "token_ids").collect()
    assert {(r.doc_id, r.ids, bytes(r.decoded)) for r in both} == {(d, i, (t or "").encode()) for d, t, i in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(df).collect() == []


def test_words_come_to_the_query_as_lists_of_tokens_and_pair_ranks(bpe):
    words = ["zq", "xqzv", "é漢", "jjjjjjj", "the", "qq" * 700]
    bpe._encode_words([w.encode() for w in words])
    rows = dict(bpe.db.sql("SELECT w, (l, k) FROM words").fetchall())
    for w, (tokens, ranks) in rows.items():
        assert tokens == [bpe.ranks[bytes([b])] for b in words[w].encode()]
        assert ranks == [bpe.merge.get(p, byte_bpe.NO_PAIR) for p in zip(tokens, tokens[1:])]
    got = dict(bpe.db.sql("SELECT w, l FROM ids").fetchall())
    assert [got[n] for n in range(len(words))] == [LIB._encode_single_piece(w.encode()) for w in words]
    bpe._encode_words([b"the"])                    # no word to contract
    assert bpe.db.sql("SELECT w FROM words").fetchall() == []


def test_each_piece_is_looked_up_once(bpe, monkeypatch):
    """A piece gets its place at its one look into the memo; a failed group leaves no place without ids."""
    texts = ["qzone a qzone b", "b qzone\tc", "é qzone  d", " qzone", "qzone\n e"]
    bpe.clear()
    want = [LIB.encode_ordinary(t) for t in texts]
    with monkeypatch.context() as m:
        m.setattr(bpe, "_learn", lambda pieces: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            bpe.encode(texts)
    assert not bpe.known
    for _ in range(2):
        assert [g.tolist() for g in bpe.encode(texts)] == want
    assert len(bpe.known) == len(bpe.ids_of) == len(bpe.text_of) and not bpe.known.new


@pytest.mark.parametrize("text", ["a b", " a", "a ", "a  b", "a\n b", "a \x1cb", "a\x1f b", "a\tb c", "é b", "é\x85 b", "é  b"])
def test_spaces_beside_white_space(text):
    assert byte_bpe.space_beside_space(text, text.split(" ")) == bool(byte_bpe.SPACE_BESIDE_SPACE(text))
