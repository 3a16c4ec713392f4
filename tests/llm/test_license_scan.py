"""Families of written notices, decoys, the corpus' own notices, edge cases."""

import random
import re

import pytest

from tessera.llm import license_scan as ls
from tests.conftest import SF

PROSE = "Thwhing onwh haheble of oneawhwh the tintible in to, thon on the anshtion than re the erhe of eringti."


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(corpus):
    return ls.fit(corpus)


def test_every_template_and_decoy_holds_an_anchor():
    for t in [*ls.DECOYS, *(t for ts in ls.TEMPLATES.values() for t in ts)]:
        assert re.search(ls.ANCHORS, t.lower()) or "WITHOUT WARRANTIES" in t, t


def test_held_out_and_unseen_wordings(spark, model):
    assert model.held_out_accuracy >= 0.97
    want = [("Licensed under the Apache License, Version 2.0. " + PROSE, "Apache"),
            (PROSE + " Released under the MIT License.", "MIT"),
            ("This work is licensed under the GNU General Public License, version 2.", "GPL"),
            ("Licensed under CC BY-NC 3.0. " + PROSE * 4, "CC-BY-NC"), ("Licensed under CC BY 3.0.", "CC-BY"),
            ("Licensed under CC BY-SA 2.0", "CC-BY-SA"),
            ("Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that these conditions are met", "BSD"),
            ("My uncle got a new driving license yesterday.", "unknown"), ("All licenses were revoked in spring.", "unknown"),
            ("Permission is needed for photographs. " + PROSE, "unknown")]
    rows = spark.createDataFrame(want, "paragraph string, want string")
    got = ls.classified(rows, model).collect()
    assert {(r.want, r.family if r.verdict == "confirmed" else "unknown") for r in got} == {(w, w) for _, w in want}


def test_notices_of_the_corpus(corpus, model):
    got = {r.doc_id: r for r in ls.scan(corpus, model=model).collect()}
    forms = {"Apache": r"Licensed under the Apache License", "CC-BY-NC": r"Licensed under CC BY-NC",
             "GPL": r"licensed under the GNU General Public", "MIT": r"Released under the MIT License"}
    for r in corpus.collect():
        want = ",".join(f for f, p in forms.items() if re.search(p, r.text or ""))
        assert got[r.doc_id].families == want and (got[r.doc_id].verdict == "confirmed") == bool(want)


def test_nulls_repeats_long_texts_and_extra_columns(docs):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (None, mit), (3, mit), (3, mit), (4, PROSE), (5, f"{PROSE}\n" * 3000 + mit),
            (6, "A license to fish."), (7, f"{mit}\nLicensed under CC BY 4.0.")]
    rows += [(100 + i, f"{PROSE} {i} of the tintible erhe onwh number {i}.") for i in range(60)]
    got = ls.scan(docs(rows).selectExpr("*", "1 AS family", "2 AS words", "3 AS row")).collect()
    assert len(got) == len(rows)
    by = sorted((str(r.doc_id), r.verdict, r.families) for r in got if r.doc_id is None or r.doc_id < 50)
    assert by == sorted([("1", "none", ""), ("2", "none", ""), ("None", "confirmed", "MIT"), ("3", "confirmed", "MIT"),
                         ("3", "confirmed", "MIT"), ("4", "none", ""), ("5", "confirmed", "MIT"),
                         ("6", "unknown", ""), ("7", "confirmed", "CC-BY,MIT")])


def test_wrapped_notices(docs, model):
    import textwrap
    notices = {"GPL": ls.TEMPLATES["GPL"][1], "MIT": ls.TEMPLATES["MIT"][2] + ", including the rights to use and sell copies",
               "BSD": ls.TEMPLATES["BSD"][0]}
    rows, want = [], {}
    for n, (family, notice) in enumerate(notices.items()):
        wrapped = textwrap.wrap(notice, 60)
        rows += [(n, f"{PROSE}\n\n" + "\n".join(wrapped) + f"\n\n{PROSE}"),
                 (10 + n, "# Copyright\n#\n" + "\n".join("# " + w for w in wrapped) + "\n#\nimport os"), (20 + n, notice)]
        want.update({n: (family, 1), 10 + n: (family, 1), 20 + n: (family, 1)})
    got = {r.doc_id: (r.families, r.n_confirmed) for r in ls.scan(docs(rows), model=model).collect()}
    assert got == want


def test_reworded_notices_without_an_anchor_are_candidates(docs, model):
    rows = [(1, "This article is available under CC BY-SA 4.0."), (2, "Available under CC BY 4.0."),
            (3, "Released under the MIT terms."), (4, "Er kam mit dem Zug by the sea."), (5, PROSE)]
    got = {r.doc_id: r for r in ls.scan(docs(rows), model=model).collect()}
    assert (got[1].families, got[2].families) == ("CC-BY-SA", "CC-BY")
    assert got[3].verdict != "none" and got[4].verdict == got[5].verdict == "none"


def test_the_gate_passes_what_coverage_confirms():
    rnd = random.Random(1)
    for t in (t for ts in ls.TEMPLATES.values() for t in ts):
        words = t.lower().split()
        for _ in range(200):
            a = rnd.randrange(len(words))
            part = words[a:a + rnd.randint(1, len(words))]
            own, every = [set(zip(w, w[1:], w[2:])) for w in (
                [re.sub("^[0-9].*", "0", w) for w in re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", " ".join(x))]
                for x in (part, words))]
            if len(own) >= 0.6 * len(every):
                assert re.search(ls.GATE, " ".join(part)), part


def test_empty_table(docs):
    assert ls.scan(docs([])).collect() == []
