"""The pipeline against plain computations of its stages on a small corpus."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tessera.llm.byte_bpe import parse_ranks
from tests.llm.test_ngram_jaccard import brute, near_copies
from tests.llm.test_substring_dedup import prose


def rows(seed=1):
    rnd = random.Random(seed)
    letters = str.maketrans("0123456789", "aeioustrnl")        # words without digits are clean
    texts = [prose(rnd, 9).translate(letters) for _ in range(80)]
    passage = prose(rnd, 10).translate(letters)
    texts[3] += " " + passage
    texts[9] = passage + "\n" + texts[9]
    copies = [t.translate(letters) + "." for t in near_copies(rnd, 4)] + [texts[0]] * 2
    junk = [" ".join(["SALE!!"] * 40)] * 8 + [" ".join(f"x{i}%%% &&&" for i in range(40))] * 6
    full = [*texts, *copies, *junk, "", None]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(full)], passage


def test_stages_and_run(spark, tmp_path):
    data, passage = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns
        seen.append({r.doc_id: r for r in docs.collect()})
    good, single, cut, mix = seen
    assert set(good) == set(range(86))
    groups = {c for _, _, c in brute([(d, r.text) for d, r in sorted(good.items())])}
    assert set(single) == groups
    inner = passage.split(". ")[4]
    assert sum(inner in r.text for r in single.values()) == 2 and sum(inner in r.text for r in cut.values()) == 1
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert {d for d in cut if cut[d].text != single[d].text} == {9}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()))
    want = Counter()
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    size = defaultdict(int)
    for r in mix.values():
        size[r.source] += 1
    assert set(size) == {"s0", "s1", "s2", "s3"}
