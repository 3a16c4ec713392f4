"""Measures against plain definitions, line rules by example, edge cases."""

import random
import re
from collections import Counter

from tessera.llm import line_rules as lr
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if count[w] > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_definitions():
    rnd = random.Random(1)
    parts = ["a", "bb", "c.", "ü", "漢", "|", "##", "\n", "\n\n", " ", "\t", "\x0b", "\x85", "\xa0", "\x1c", "🙂", "d!!"]
    for _ in range(800):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert tuple(lr.measure(text)[0][:5]) == plain(text)


def test_line_rules():
    def fails(line):
        return lr.line_fails(line, lr.words_of(line))
    good = ["A plain sentence.", "He said “stop.” and left", "The MIT License.", "Ça va ? Oui!", "Costs 5% of all that we had here."]
    bad = ["Home | About | Contact.", "no end here", "One%%% two### three.", "BUY!! NOW!! OK!!",
           "This site uses cookies.", "Click here. Now."]
    assert not any(map(fails, good)) and all(map(fails, bad))
    long_ = "He wrote a privacy policy " + "and so on " * 12 + "at last."
    assert not fails(long_)


def test_clean_removes_lines_and_rejects(docs):
    rnd = random.Random(2)
    body = "\n".join(" ".join(f"w{rnd.randint(0, 999)}" for _ in range(12)) + "." for i in range(8))
    rows = [(1, body), (2, f"Home | News | Sport\n{body}\nAll rights reserved."), (3, "Home | News | Sport\n" * 9),
            (4, None), (5, ""), (None, body), (6, "one two three."), (7, body), (8, f"{body}\n\n{body}"),
            (9, " ".join(f"w{i}" for i in range(50000)) + ".")]
    df = docs(rows).selectExpr("*", "1 AS n_words", "true AS kept", "'r' AS row")
    got = lr.clean(df)
    assert got.columns == df.columns
    out = sorted(((r.doc_id or 0), r.text) for r in got.collect())
    assert out == sorted([(1, body), (2, body), (0, body), (7, body), (9, rows[-1][1])])
    table = {r.doc_id: r for r in lr.quality_table(df).collect()}
    assert table[8].base_failed and table[8].n_dup_lines == 8 and table[4].n_words == 0 and table[4].base_failed


def test_labelled_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = lr.quality_table(spark.read.parquet(f"{sf}/documents.parquet")).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = got[(got.quality == 1) & (got.n_words >= 10)]
    assert good.kept.mean() >= 0.99 and got[got.quality == 0].kept.mean() <= 0.2


def test_empty_table(docs):
    assert lr.quality_table(docs([])).collect() == [] and lr.clean(docs([])).collect() == []
