"""Repeated passages against planted truth and a brute-force unit comparison."""

import random
from collections import defaultdict

from tessera.llm.substring_dedup import remove_repeats, repeated_units, repeats, unit_key, units


def sentence(rnd, n):
    return " ".join(f"w{rnd.randint(0, 30000)}" for _ in range(n)).capitalize() + "."


def prose(rnd, sentences):
    return " ".join(sentence(rnd, rnd.randint(2, 14)) for _ in range(sentences))


def brute(rows, min_words=20):
    """Exact repeats by unit text: rows (doc, start, removed) in long enough runs."""
    all_units = [(d, *u, unit_key(w[u[2]:u[3]])) for d, t in rows for f, w in [units((t or "").encode())] for u in f]
    by_key = defaultdict(list)
    for d, start, stop, a, b, key in all_units:
        by_key[key].append((d, start, stop, b - a))
    hits = {}
    for places in by_key.values():
        if len({p[0] for p in places}) > 1:
            first = min(places)[:2]
            hits.update({p[:2]: (p[2], p[3], p[:2] != first) for p in places})
    out, runs = [], defaultdict(list)
    for (d, start), (stop, words, removed) in sorted(hits.items()):
        if not runs[d] or runs[d][-1][-1][1] != start:
            runs[d].append([])
        runs[d][-1].append((start, stop, words, removed))
    for d, some in runs.items():
        for run in some:
            if sum(u[2] for u in run) >= min_words:
                out += [(d, u[0], u[3]) for u in run]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    passages = [prose(rnd, 9) for _ in range(6)]
    line = sentence(rnd, 12)
    rows, planted = [], []
    for doc in range(1, 90):
        text = prose(rnd, rnd.randint(3, 12))
        if doc % 3 == 0:
            words = text.split(" ")
            k = rnd.randrange(len(words))
            text = " ".join(words[:k] + [passages[doc % 6]] + words[k:])
            planted.append(doc)
        if doc % 4 == 0:
            text += "\n" + line
        rows.append((doc, text))
    return rows, planted, passages


def test_equals_brute_force_and_finds_planted_passages(docs):
    rows, planted, _ = corpus(1)
    got = repeated_units(docs(rows)).collect()
    assert sorted((r.doc_id, r.start, r.removed) for r in got) == brute(rows)
    assert {r.doc_id for r in got} == set(planted)
    assert all(r.passage_words >= 20 and r.kept_doc_id <= r.doc_id for r in got)


def test_removal_leaves_one_copy_and_clean_documents_alone(docs):
    rows, planted, passages = corpus(2)
    df = docs(rows).selectExpr("*", "1 AS band", "'x' AS unit", "'y' AS words")
    got = remove_repeats(df)
    assert got.columns == df.columns
    text = {r.doc_id: r.text for r in got.collect()}
    for doc, old in rows:
        if doc not in planted:
            assert text[doc] == old
    inner = [p.split(". ")[4] for p in passages]
    assert all(sum(s in t for t in text.values()) <= 1 for s in inner)


def test_near_repeats_are_verified_and_removed(docs):
    rnd = random.Random(8)
    long_ = [f"w{rnd.randint(0, 9999)}" for _ in range(80)]
    near, far = list(long_), list(long_)
    near[-1] = "other"
    for k in range(0, 80, 8):
        far[k] = f"x{k}"
    rows = [(1, " ".join(long_) + "."), (2, " ".join(near) + ". And its own words go on."), (3, " ".join(far) + ".")]
    got = {(r.doc_id, r.kept_doc_id, r.removed) for r in repeated_units(docs(rows)).collect()}
    assert got == {(1, 1, False), (2, 1, True)}


def test_nulls_repeats_inside_one_document_and_long_texts(docs):
    rnd = random.Random(3)
    p = prose(rnd, 12)
    rows = [(1, None), (2, ""), (None, p), (None, p), (3, f"{p} {p}"), (4, " \n "), (5, prose(rnd, 4000)),
            (6, p), (6, p)]
    df = docs(rows)
    assert {r.doc_id for r in repeated_units(df).collect()} == {3, 6}
    out = sorted((r.doc_id or 0, r.text or "") for r in remove_repeats(df).collect())
    assert [d for d, _ in out] == [0, 0, 1, 2, 3, 4, 5]


def test_a_hot_unit_in_blocks(docs, monkeypatch):
    from tessera.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "BLOCK_ROWS", 8)
    rnd = random.Random(4)
    p = prose(rnd, 8)
    rows = [(d, f"{sentence(rnd, 9)} {p}") for d in range(1, 61)]
    got = repeated_units(docs(rows)).collect()
    assert sorted((r.doc_id, r.start, r.removed) for r in got) == brute(rows)


def edited(rnd, sentences):
    """A paragraph of 15-word sentences, and a near copy with a word changed in two of them."""
    one = [[f"w{rnd.randint(0, 30000)}" for _ in range(15)] for _ in range(sentences)]
    two = [list(s) for s in one]
    two[1][7], two[sentences - 2][7] = "edited", "also"
    return tuple(" ".join(" ".join(s) + "." for s in p) for p in (one, two))


def test_near_paragraphs_go_whole_and_nothing_else(docs):
    rnd = random.Random(11)
    one, two = edited(rnd, 8)
    own = [prose(rnd, 6) for _ in range(5)]
    wrapped = one.replace(". ", ".\n")
    only = one.split(". ")[1] + ". " + prose(rnd, 12)        # shares what the near copy had edited
    rows = [(1, f"{own[0]}\n{one}"), (2, f"{own[1]}\n{two}\n{own[2]}"), (3, f"{own[3]}\n\n{wrapped}\n\n{own[4]}"),
            (4, only)]
    got = {r.doc_id: r.text for r in remove_repeats(docs(rows)).collect()}
    assert got[1] == rows[0][1] and got[4] == only
    assert got[2].split("\n") == [own[1], own[2]]
    assert [p for p in got[3].split("\n") if p] == [own[3], own[4]]


def test_a_unit_is_not_kept_in_a_paragraph_that_goes(docs):
    rnd = random.Random(12)
    one, two = edited(rnd, 16)
    long_ = " ".join(f"x{rnd.randint(0, 30000)}" for _ in range(21)) + "."
    # document 2 adds a sentence to its near copy, which document 3 has too
    rows = [(1, one), (2, f"{two} {long_}"), (3, f"{prose(rnd, 30)} {long_}")]
    got = {r.doc_id: r.text for r in remove_repeats(docs(rows)).collect()}
    assert sorted(got) == [1, 3] and long_ in got[3]


def test_exact_passages_go_to_the_word(docs):
    rnd = random.Random(13)
    def some(n):
        return " ".join(f"w{rnd.randint(0, 30000)}" for _ in range(n))
    plain = [some(n) for n in (20, 27, 55)]                   # no marks inside
    marked = f"{some(9)}. {some(12)}? {some(14)}"
    rows, want = [], {}
    for k, p in enumerate([*plain, marked]):
        for d in range(3):
            head, tail = some(30 + d), some(31 + k)
            rows.append((10 * k + d, f"{head} {p} {tail}."))
            want[10 * k + d] = rows[-1][1] if d == 0 else f"{head} {tail}."
    rows.append((90, f"{some(40)} {' '.join(plain[2].split()[:19])} {some(40)}"))    # too short
    want[90] = rows[-1][1]
    assert {r.doc_id: r.text for r in remove_repeats(docs(rows)).collect()} == want
    got = [r for r in repeats(docs(rows)).collect() if r.doc_id // 10 == 2 and r.n_words == 55]
    assert sorted((r.doc_id, r.removed, r.kept_doc_id) for r in got) == [(20, False, 20), (21, True, 20), (22, True, 20)]


def test_empty_table(docs):
    assert repeated_units(docs([])).collect() == [] and remove_repeats(docs([])).collect() == []


def test_scratch_tables_and_shuffles_go(docs, spark, monkeypatch):
    from pathlib import Path

    from tessera.llm import store
    from tessera.session import ensure_checkpoint_dir
    freed = []
    monkeypatch.setattr(store, "drop_shuffles", freed.append)
    rows, _, _ = corpus(5)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    got = repeats(docs(rows))
    there = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert freed and got.count()
    assert "repeat-found" in there and not there & {"repeat-bands", "repeat-blocks", "repeat-links", "repeat-runs"}


def test_units_by_the_plain_definition():
    """Cuts, units and lines as one loop over the matches finds them."""
    import re

    from tessera.llm.substring_dedup import CLOSING_WORDS, INNER, UNIT, _pieces
    cut = re.compile(rb"[.!?][\"')\]]*[ \t\r]+|\n+")

    def plain(text):
        out, lines, count, start, at, first, line, line_first = [], [[]], 0, 0, 0, 0, 0, 0
        for end in sorted({m.end() for m in cut.finditer(text)} | {len(text)}):
            here = len(text[at:end].split())
            count, at = count + here, end
            if here >= CLOSING_WORDS:
                out.append((start, end, first, count, UNIT))
                start, first = end, count
            if text.endswith(b"\n", 0, end) or end == len(text):
                if count > line_first:
                    lines[-1].append((line, end, line_first, count))
                if lines[-1] and (count == line_first or text.endswith(b"\n\n", 0, end)):
                    lines.append([])
                line, line_first = end, count
        if count > first:
            out.append((start, at, first, count, UNIT))
        blocks = [b for b in lines if b]
        for b in blocks:
            whole = len(blocks) > 1 and len(b) > 1
            out += [(*x, INNER if whole else 2) for x in b]
            out += [(b[0][0], b[-1][1], b[0][2], b[-1][3], 2)] * whole
        return sorted(out)

    rnd = random.Random(6)
    texts = [bytes(rnd.choices(b"ab. \n\t.!?\"')\r\x0b\x0c  \n\x00\xc3", k=rnd.choice([0, 1, 9, 60, 300]))) for _ in range(400)]
    spans, base, _, words, _, _ = _pieces(texts)
    before = 0
    for n, text in enumerate(texts):
        mine = spans[spans[:, 0] == n, 1:] - [base[n], base[n], before, before, 0]
        assert sorted(map(tuple, mine.tolist())) == plain(text), text
        before += len(text.split())
    assert before == len(words)


def test_only_the_ends_of_a_chain_look_at_the_texts(docs, monkeypatch):
    """Runs that go on in the same first copy need no words on their sides."""
    from tessera.llm import substring_dedup
    rnd, seen, with_sides = random.Random(21), [], substring_dedup._with_sides

    def counted(df, wanted, *more):
        seen.append(wanted.distinct().count())
        return with_sides(df, wanted, *more)

    def some(n):
        return " ".join(f"w{rnd.randint(0, 30000)}" for _ in range(n))
    monkeypatch.setattr(substring_dedup, "_with_sides", counted)
    passage = some(100)
    rows = [(d, f"{some(150 + d)} {passage} {some(160)}") for d in range(3)] + [(2, None)]
    got = [r for r in repeats(docs(rows)).collect() if r.n_words == 100]
    assert sorted((r.doc_id, r.removed, r.kept_doc_id) for r in got) == [(0, False, 0), (1, True, 0), (2, True, 0)]
    assert all(rows[r.doc_id][1].encode()[r.start:r.stop].decode().rstrip() == passage for r in got)
    assert len(seen) == 1 and 6 <= seen[0] <= 8      # both ends in the two later copies, and their places in the first one
