"""Substring dedup: paragraph MinHash banding, exact verification, removal by components.

Method
1. Texts are cut into *units*: sentences and lines, where a sentence of fewer
   than ``CLOSING_WORDS`` words is joined to the next one.  The cuts depend on
   the words at the cut alone, so a passage has the same inner units wherever it
   stands, also in the middle of a line.
2. Banding with one min-hash per band (``BANDS`` bands, recall 0.992 for a pair
   at similarity 0.8) over five-word shingles.  Units with too few shingles to
   be similar without being equal get one band, the hash of their words.  Only
   bands met in two documents go on.
3. Units of equal words are one class.  Classes that collide in a band are
   joined block by block (a band that holds a third of all units is spread over
   many tasks) and verified by exact Jaccard similarity of their shingle sets.
4. Verified links give components; the first unit (by document id and place) of
   a component met in two documents is kept, the others are removals.
5. A removal takes effect only in a run of adjacent repeated units of at least
   ``min_words`` words: short common phrases and lines stay where they are.
6. Paragraphs of ``min_words`` words or more (lines, and blocks of several lines
   between blank lines) are banded, verified and removed whole in the same way,
   before the units: what stands in a removed paragraph is never the one kept.
7. Exact passages wherever they begin and end: runs of words are chosen by their
   content (winnowing: the least hash of every few adjacent runs), so that every
   passage of ``min_words`` words that two documents share has a chosen run in
   common, with or without sentence marks.  Runs that go on in the same first copy
   are one chain, whose ends are compared word by word with that copy; what
   touches is one passage.  Words go only for
   an equal place before them that no paragraph or unit takes.

Places are byte offsets into the UTF-8 text.  Defined results: null, empty and
word-less texts have no units; rows with a null id are neither compared nor
changed; rows that repeat id and text count as one document; passages repeated
only inside one document stay; an empty table gives an empty table; other
columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import shingles
from tessera.llm.blocks import dealt, in_units, pairs, roots, unit_intersections, unit_rows
from tessera.llm.columns import apart
from tessera.llm.components import components
from tessera.llm.shared_keys import PACKED, packed, shared_rows
from tessera.llm.store import Scratch, drop_shuffles, written

SHINGLE, BANDS, CLOSING_WORDS = 5, 3, 4
#: With fewer shingles than this, a similarity of 0.8 or more means equal sets.
LEAST_SHINGLES = 4
BLOCK_ROWS = 512
#: Levels: units, paragraphs in another paragraph, paragraphs in no other one.
UNIT, INNER, OUTER = 0, 1, 2
#: Tells keys and bands of paragraphs from those of units.
PARAGRAPH = 0x5DEECE66D1CE4E5B
_BAND_SEED = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def _among(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_SPACE, _MARK, _CLOSER, _BLANK, _TRAIL = map(_among, (b" \t\n\r\x0b\x0c", b".!?", b"\"')]", b" \t\r", b" \t"))
#: Between texts that are cut together: ends a word and belongs to no cut.
_BETWEEN = b"\x0b"


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in an array of bytes."""
    space = np.r_[True, _SPACE[data], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _past(those: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First place from each of ``at`` on where ``those`` does not hold (its length, if none)."""
    places = np.flatnonzero(those)
    if not len(places):
        return at
    apart_ = places[1:] != places[:-1] + 1
    first, end = places[np.r_[True, apart_]], places[np.r_[apart_, True]] + 1
    run = np.searchsorted(first, at, "right") - 1
    return np.where(run >= 0, np.maximum(at, end[run]), at)


def _merged(length: int, *places: np.ndarray) -> np.ndarray:
    """Distinct places up to ``length`` in order."""
    there = np.zeros(length + 1, bool)
    for some in places:
        there[some] = True
    return np.flatnonzero(there)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the matches of ``[.!?]["')\\]]*[ \\t\\r]+`` and ``\\n+``."""
    after = np.flatnonzero(_MARK[data]) + 1
    after = _past(_CLOSER[data], after)
    after = after[after < len(data)]
    after = _past(_BLANK[data], after[_BLANK[data[after]]])
    line = np.r_[data == 10, False]
    return _merged(len(data), after, np.flatnonzero(line[:-1] & ~line[1:]) + 1)


def _pieces(texts: list[bytes]):
    """Spans of units and paragraphs, words and places of words of many texts.

    A span is ``(text, start, stop, first word, end word, level)``; places are those
    in the texts with one byte between them, words are numbered through all texts.
    A unit reaches to the start of the next one, so adjacent units touch.
    """
    joined = _BETWEEN.join(texts)
    data = np.frombuffer(joined, np.uint8)
    final = np.cumsum([len(x) + 1 for x in texts]) - 1
    base = np.r_[0, final[:-1] + 1]
    begin, finish = word_places(data)
    cut = _merged(len(data), _cuts(data), final)
    text = np.searchsorted(final, cut)
    count = np.searchsorted(begin, cut)
    ahead = np.searchsorted(begin, base)
    last = cut == final[text]

    def since(at):
        """Place and words before the cut ahead of each of ``at``, among these of its text."""
        same = np.r_[False, text[at][1:] == text[at][:-1]]
        before = np.r_[at[:1], at[:-1]]
        return np.where(same, cut[before], base[text[at]]), np.where(same, count[before], ahead[text[at]])

    closing = count - since(np.arange(len(cut)))[1] >= CLOSING_WORDS
    closed = np.maximum(np.maximum.accumulate(np.where(closing, count, 0)), ahead[text])
    at = np.flatnonzero(closing | last & (count > closed))
    start, first = since(at)
    spans = [np.column_stack([text[at], start, cut[at], first, count[at], np.full(len(at), UNIT)])]

    def newline(back):
        return (cut - back >= base[text]) & (data[np.maximum(cut - back, 0)] == 10) if len(data) else np.zeros(len(cut), bool)

    at = np.flatnonzero(newline(1) | last)
    start, first = since(at)
    filled = count[at] > first
    # a line without words or a blank line after it ends a block of lines
    ends = ~filled | (newline(1) & newline(2))[at] | last[at]
    block = (np.cumsum(ends) - ends)[filled]
    line = np.column_stack([text[at], start, cut[at], first, count[at]])[filled]
    if len(line):
        to = np.flatnonzero(np.r_[block[1:] != block[:-1], True])
        of = np.r_[0, to[:-1] + 1]
        several = np.bincount(line[of, 0], minlength=len(texts))[line[of, 0]] > 1
        whole = several & (to > of)
        level = np.where(np.repeat(whole, to - of + 1), INNER, OUTER)
        spans.append(np.column_stack([line, level]))
        a, b = of[whole], to[whole]
        spans.append(np.column_stack([line[a, 0], line[a, 1], line[b, 2], line[a, 3], line[b, 4], np.full(len(a), OUTER)]))
    return np.concatenate(spans), base, joined, joined.split(), begin, finish


def units(text: bytes) -> tuple[list[tuple[int, int, int, int]], list[bytes]]:
    """``(start, stop, first word, end word)`` of each unit, and the words of the text."""
    spans, _, _, words, _, _ = _pieces([text])
    return [tuple(s) for s in spans[spans[:, 5] == UNIT, 1:5].tolist()], words


def unit_key(words: list[bytes]) -> int:
    """First half of the unit's 128-bit hash, as a signed number."""
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)


def is_key(words: list[bytes], key: int) -> bool:
    """Whether ``key`` is that of a unit or paragraph of these words."""
    return key in ((own := unit_key(words)), own ^ PARAGRAPH)


def _banded(texts: list[bytes], min_words: int):
    """Arrays of row, start, stop, words, level, key and band for the units and paragraphs of many texts."""
    span, base, joined, every, begin, finish = _pieces(texts)
    span = span[(span[:, 5] == UNIT) | (span[:, 4] - span[:, 3] >= min_words)]
    if not len(span):
        return [np.empty(0, np.int64)] * 7
    # words with one space between them stand in the text as they are hashed
    plain = (begin[1:] - finish[:-1] == 1) & (np.frombuffer(joined, np.uint8)[finish[:-1]] == 32)
    odd = np.r_[0, np.cumsum(~plain)]
    first, end = span[:, 3], span[:, 4]
    digest = [xxhash.xxh3_128_digest(joined[x:y] if z else b" ".join(every[a:b])) for a, b, x, y, z in zip(
        first.tolist(), end.tolist(), begin[first].tolist(), finish[end - 1].tolist(),
        (odd[end - 1] == odd[first]).tolist())]
    row, level = span[:, 0], span[:, 5]
    span = np.column_stack([span[:, 1:3] - base[row][:, None], first, end])
    key, exact = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2).T
    size = end - first
    salt = np.where(level == UNIT, np.uint64(0), np.uint64(PARAGRAPH))
    key, exact = key ^ salt, exact ^ salt
    many = np.flatnonzero(size - SHINGLE + 1 >= LEAST_SHINGLES)
    few = np.flatnonzero(size - SHINGLE + 1 < LEAST_SHINGLES)
    take, band = [few], [exact[few]]
    if len(many):
        win = np.r_[shingles.windows(shingles.hash_words(every), SHINGLE), np.zeros(1, np.uint64)]
        for j in range(BANDS):
            mixed = shingles.mix(win ^ _BAND_SEED[j])
            for some in (many[level[many] == UNIT], many[level[many] == INNER], many[level[many] == OUTER]):
                # places of one level go up, as reduceat needs them
                some = some[np.argsort(span[some, 2], kind="stable")]
                if len(some):
                    edges = np.column_stack([span[some, 2], span[some, 3] - SHINGLE + 1]).ravel()
                    least = np.minimum.reduceat(mixed, edges)[::2]
                    take.append(some)
                    band.append(shingles.mix(least + np.uint64(j)) ^ salt[some])
    at = np.concatenate(take)
    return (row[at], span[at, 0], span[at, 1], size[at], level[at], key[at].view(np.int64),
            np.concatenate(band).view(np.int64))


_BANDED = {"band": "long", "doc_id": "long", "start": "int", "stop": "int", "words": "int", "level": "byte", "key": "long"}


def banded_units(docs: DataFrame, id_col: str, text: str, min_words: int = 20) -> DataFrame:
    """``(band, doc_id, start, stop, words, level, key)`` of every unit and paragraph with a band met in two documents."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
                      ).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def rows_of(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy()
            for part in shingles.groups(texts):
                row, start, stop, words, level, key, band = _banded(texts[part], min_words)
                yield [band, ids[part][row], start.astype(np.int32), stop.astype(np.int32), words.astype(np.int32),
                       level.astype(np.int8), key]

    return shared_rows(src.mapInArrow(lambda batches: packed(rows_of(batches)), PACKED), _BANDED)


def _unit_words(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(key, words)`` of wanted ``(key, doc_id, start, stop)`` units, read from their documents."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "stop")).alias("at"))

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for text_, at in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                for place in at:
                    words = (text_ or b"")[place["start"]:place["stop"]].split()
                    if is_key(words, place["key"]):
                        keys.append(place["key"])
                        found.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())],
                                             names=["key", "words"])

    return (src.join(by_doc, "doc_id").select("text", "at").mapInArrow(run, "key long, words binary")
            .groupBy("key").agg(F.first("words").alias("words")))


def _verified(work: DataFrame, threshold: float) -> DataFrame:
    """``(key, other)``: a spanning forest of the similar classes of each unit of work."""
    columns = ["unit", "block", "diagonal", "key", "words"]

    def run(batches):
        for table in unit_rows(batches, columns):
            # a class stands in several units
            _, one, of = np.unique(table.column("key").to_numpy(), return_index=True, return_inverse=True)
            distinct = shingles.shingle_sets(table.column("words").take(pa.array(one)).to_pylist(), SHINGLE)
            sets = [distinct[k] for k in of.tolist()]
            size = np.array([len(s) for s in sets])
            unit, key = table.column("unit").to_numpy(), table.column("key").to_numpy()
            i, j = pairs(unit, table.column("block").to_numpy(), table.column("diagonal").to_numpy())
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            both = unit_intersections(sets, unit, i, j)
            link = both >= threshold * (size[i] + size[j] - both) - 1e-9
            root = roots(len(sets), i[link], j[link])
            out = np.flatnonzero(root != np.arange(len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(key[root[out]])],
                                             names=["key", "other"])

    return work.mapInArrow(run, "key long, other long")


def _decided(rows: DataFrame, may_stay) -> DataFrame:
    """Rows of components met in two documents, with the place ``first`` that stays and ``removed``.

    The first row that ``may_stay`` and is not ``gone`` stays; components without one are left out.
    """
    place = F.struct("doc_id", "start", (-F.col("stop")).alias("end"))
    kept = (rows.groupBy("cluster").agg(
        F.min(F.when(~F.col("gone") & may_stay, place)).alias("first"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi AND first IS NOT NULL").drop("lo", "hi"))
    # a paragraph in the one that stays stays with it
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") < -F.col("first.end")) & (
        F.col("stop") > F.col("first.start"))
    return rows.join(kept, "cluster").withColumn("removed", ~F.col("gone") & ~stays)


def _inside(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``rows`` with ``gone``: whether a removed paragraph around the row (or across its end) takes it."""
    ends = paragraphs.where("removed").select("doc_id", "start", "stop").withColumn("_cut", F.lit(True))
    both = rows.drop("gone").withColumn("_cut", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    key = Window.partitionBy("doc_id").orderBy("start", F.col("stop").desc(), F.col("_cut").desc())
    before, after = key.rowsBetween(Window.unboundedPreceding, -1), key.rowsBetween(1, Window.unboundedFollowing)
    upto = F.max(F.when(F.col("_cut"), F.col("stop"))).over(before)
    then = F.min(F.when(F.col("_cut"), F.col("start"))).over(after)
    gone = F.coalesce((upto > F.col("start")) | (then < F.col("stop")), F.lit(False))
    return both.withColumn("gone", gone).where("NOT _cut").drop("_cut")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, threshold: float = 0.8,
                   min_words: int = 20) -> DataFrame:
    """Repeated paragraphs, and repeated units in runs of ``min_words`` words or more.

    ``doc_id, start, stop, n_words, passage_words, kept_doc_id, kept_start, removed,
    key``; ``removed`` is false for the one unit or paragraph of its component that
    stays.  Units of a removed paragraph have no rows of their own.
    """
    with Scratch() as own:
        hot = own.written(banded_units(docs, id_col, text, min_words), "repeat-bands")

        # classes that share a band with another class, in blocks
        classes = hot.groupBy("band", "key").agg(F.min(F.struct("doc_id", "start", "stop")).alias("at"))
        blocks = own.written(dealt(classes, ["band"], "key", BLOCK_ROWS).drop("band"), "repeat-blocks")
        wanted = blocks.groupBy("key").agg(F.min("at").alias("at")).select("key", "at.*")
        words = _unit_words(docs, wanted, id_col, text)
        work = in_units(blocks.drop("at").join(words, "key"))
        root = components(own.written(_verified(work, threshold), "repeat-links"), "key", "other")

        found = (hot.select("doc_id", "start", "stop", "words", "level", "key").distinct()
                 .join(root.withColumnRenamed("node", "key"), "key", "left")
                 .withColumn("cluster", F.coalesce("root", "key")).drop("root"))
        found = written(found, "repeat-units")
    large = found.where(F.col("level") > UNIT).withColumn("gone", F.lit(False))
    outer = written(_decided(large, F.col("level") == OUTER), "repeat-paragraphs")
    # components of paragraphs inside others only: none stays in a paragraph that goes
    inner = large.join(outer.select("cluster").distinct(), "cluster", "left_anti").where(F.col("level") == INNER)
    inner = _decided(_inside(inner, outer.where(F.col("level") == OUTER)), F.lit(True))
    paragraphs = written(outer.unionByName(inner, allowMissingColumns=True), "repeat-paragraphs")
    all_units = _decided(_inside(found.where(F.col("level") == UNIT), paragraphs), F.lit(True))
    place = Window.partitionBy("doc_id").orderBy("start", "stop")
    gap = (F.col("start") != F.coalesce(F.lag("stop").over(place), F.lit(-1))).cast("int")
    run_ = Window.partitionBy("doc_id", "run")
    some = (all_units.withColumn("gap", gap).withColumn("run", F.sum("gap").over(place))
            .withColumn("passage_words", F.sum("words").over(run_))
            .where((F.col("passage_words") >= min_words) & ~F.col("gone")).drop("gap", "run"))
    some = some.unionByName(paragraphs.where("NOT gone").withColumn("passage_words", F.col("words").cast("long")))
    return some.select("doc_id", "start", "stop", F.col("words").cast("long").alias("n_words"), "passage_words",
                       F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
                       "removed", "key")


def _winnow(min_words: int) -> tuple[int, int]:
    """Words of a run, and adjacent runs of which one is chosen: any ``min_words`` equal words share a choice."""
    size = max(1, 3 * min_words // 5)
    return size, max(1, min_words - size + 1)


def _cut_words(joined: bytes, base: np.ndarray, begin: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Text, first and end words of the parts that found rows (text, start, stop, key) remove."""
    text, start, stop, key = cuts
    final = np.r_[base[1:] - 1, len(joined)][text]
    order = np.lexsort((-stop, start, text))
    text, key = text[order], key[order]
    start, stop = (np.minimum(x[order] + base[text], final[order]) for x in (start, stop))
    parts, of, at = [], -1, 0
    for t, a, b, k, first, end in zip(*[x.tolist() for x in (
            text, start, stop, key, np.searchsorted(begin, start), np.searchsorted(begin, stop))]):
        if t != of:
            of, at, last = t, 0, 0
        if b > at and is_key(joined[a:b].split(), k):
            first, at, last = max(first, last), b, end
            if parts and parts[-1][0] == t and parts[-1][2] == first:
                first = parts.pop()[1]
            parts.append((t, first, end))
    return parts


def _chosen(texts: list[bytes], cuts: list[np.ndarray], min_words: int):
    """Row, first word and its place, hash and ``gone`` of the chosen runs of words of many texts.

    ``gone`` runs touch what found rows remove; those more than ``min_words`` deep in it are left out.
    """
    size, among = _winnow(min_words)
    joined = _BETWEEN.join(texts)
    begin, _ = word_places(np.frombuffer(joined, np.uint8))
    if len(begin) < min_words:
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64), np.empty(0, bool)]
    base = np.r_[0, np.cumsum([len(x) + 1 for x in texts])[:-1]]
    row, offset = np.searchsorted(base, begin, "right") - 1, np.searchsorted(begin, base)
    win = shingles.windows(shingles.hash_words(joined.split()), size)
    # the last of the least
    last = np.lib.stride_tricks.sliding_window_view(win, among)[:, ::-1].argmin(axis=1)
    at = np.arange(len(last))
    whole = row[at] == row[at + among + size - 2]
    touched, deep = np.zeros(len(row), bool), np.zeros(len(row), bool)
    for t, a, b in _cut_words(joined, base, begin, cuts):
        touched[max(int(offset[t]), a - size + 1):b] = True
        if b - a >= 2 * min_words + size:
            deep[a + min_words:b - min_words - size + 1] = True
    at = (at + among - 1 - last)[whole]  # never goes back
    at = at[np.r_[True, at[1:] != at[:-1]][:len(at)]]
    at = at[~deep[at]]
    return row[at], at - offset[row[at]], begin[at] - base[row[at]], win[at], touched[at]


_CHOSEN = {"run": "long", "doc_id": "long", "text_hash": "long", "at": "int", "start": "int", "gone": "boolean"}


def chosen_runs(docs: DataFrame, found: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """``(run, doc_id, text_hash, at, start, gone)``: hash, first word and place of the chosen runs met in two documents."""
    cuts = (found.where("removed").groupBy(F.col("doc_id").alias("_cut_id"))
            .agg(F.collect_list(F.struct("start", "stop", "key")).alias("cut")))
    src = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.xxhash64(text).alias("text_hash")).where("doc_id IS NOT NULL AND text IS NOT NULL")
           .join(cuts, F.col("doc_id") == F.col("_cut_id"), "left").select("doc_id", "text", "text_hash", "cut"))

    def rows_of(batches):
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy()
            hashes = batch.column("text_hash").to_numpy()
            of, cut = _flat(batch.column("cut"), ("start", "stop", "key"))
            for part in shingles.groups(texts):
                a, b = np.searchsorted(of, (part.start, part.stop))
                row, at, start, win, gone = _chosen(texts[part], [of[a:b] - part.start, *[c[a:b] for c in cut]], min_words)
                yield [win.view(np.int64), ids[part][row], hashes[part][row], at.astype(np.int32), start.astype(np.int32), gone]

    return shared_rows(src.mapInArrow(lambda batches: packed(rows_of(batches)), PACKED), _CHOSEN)


def _flat(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and fields of all structs in a column of lists."""
    size = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    return np.repeat(np.arange(len(size)), size), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


_SIDES = "doc_id long, text_hash long, at int, after boolean, words array<long>, places array<int>"


def _sides(texts: list[bytes], row: np.ndarray, at: np.ndarray, after: np.ndarray, min_words: int):
    """Sizes of the sides of runs, hashes of their words, and places of the run's edge and of the words' far edges."""
    size, among = _winnow(min_words)
    joined = _BETWEEN.join(texts)
    data = np.frombuffer(joined, np.uint8)
    begin, finish = word_places(data)
    # the spaces and tabs after a word belong to it
    finish = _past(_TRAIL[data], finish)
    base = np.r_[0, np.cumsum([len(x) + 1 for x in texts])[:-1]]
    offset = np.r_[np.searchsorted(begin, base), len(begin)]
    # a passage goes on less than this to each side of its first and last chosen run
    count = np.minimum(among, np.where(after, offset[row + 1] - offset[row] - at - size, at))
    edge = offset[row] + at + np.where(after, size - 1, 0)
    step = np.where(after, 1, -1)

    def along(n, ahead):
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ahead
        return np.repeat(edge, n) + np.repeat(step, n) * k

    every, far = joined.split(), along(count + 1, 0)
    hashes = shingles.hash_words([every[k] for k in along(count, 1).tolist()])
    places = np.where(np.repeat(after, count + 1), finish[far], begin[far]) - np.repeat(base[row], count + 1)
    return count, hashes, places


def _with_sides(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """Wanted ``(doc_id, text_hash, at, after)`` sides of runs: hashes and places of the words before or after."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"),
                      F.xxhash64(text).alias("text_hash"))
    by_doc = wanted.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "after")).alias("ats"))
    names = [c.split()[0] for c in _SIDES.split(", ")]

    def listed(count, values):
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(values))

    def run(batches):
        for batch in batches:
            doc, own = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            # rows that come twice stand together after the join
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])][:len(doc)])
            batch, doc, own = batch.take(pa.array(new)), doc[new], own[new]
            texts = batch.column("text").to_pylist()
            of, (at, after) = _flat(batch.column("ats"), ("at", "after"))
            for part in shingles.groups(texts):
                a, b = np.searchsorted(of, (part.start, part.stop))
                row = of[a:b]
                count, hashes, places = _sides(texts[part], row - part.start, at[a:b], after[a:b], min_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row]), pa.array(own[row]), pa.array(at[a:b]), pa.array(after[a:b]),
                     listed(count, hashes.view(np.int64)), listed(count + 1, places.astype(np.int32))], names=names)

    return src.join(by_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "ats").mapInArrow(run, _SIDES)


def _alike(a: str, b: str):
    """Number of equal values at the start of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def _touching(spans: DataFrame, *more) -> DataFrame:
    """Spans of words that overlap or touch as one: ``doc_id, text_hash, start, stop, passage_words``."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("a", "b")
    new = (F.col("a") > F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    return (spans.withColumn("_new", new.cast("int")).withColumn("_passage", F.sum("_new").over(order))
            .groupBy("doc_id", "text_hash", "_passage")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                 (F.max("b") - F.min("a")).cast("long").alias("passage_words"), *more).drop("_passage"))


def _chains(runs: DataFrame, size: int) -> DataFrame:
    """Runs of words that repeat a first copy, those that go on in the same copy as one row.

    A chain's runs overlap or touch, so its words are equal from the first word of its
    first run to the last word of its last one, and only its ends need a look at the texts.
    """
    kept = runs.where("NOT gone").groupBy("run").agg(F.min(F.struct("doc_id", "start", "text_hash", "at")).alias("first"))
    later = F.struct("doc_id", "start", "text_hash") > F.struct("first.doc_id", "first.start", "first.text_hash")
    repeat = runs.join(kept, "run").where(later).select(
        "doc_id", "text_hash", "at", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"),
        F.col("first.at").alias("first_at"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    step, first_step = (F.col(c) - F.lag(c).over(order) for c in ("at", "first_at"))
    same = (F.lag("first_id").over(order) == F.col("first_id")) & (F.lag("first_hash").over(order) == F.col("first_hash"))
    goes_on = F.coalesce(same & (step == first_step) & (step <= size), F.lit(False))
    return (repeat.withColumn("new", (~goes_on).cast("int")).withColumn("chain", F.sum("new").over(order))
            .groupBy("doc_id", "text_hash", "chain", "first_id", "first_hash")
            .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("first_at").alias("first_low"),
                 F.max("first_at").alias("first_high")))


def repeated_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str = "text", *,
                      min_words: int = 20) -> DataFrame:
    """Exact repeats of ``min_words`` words or more, in the columns of ``repeated_units``.

    ``found`` are the repeated units.  A passage is one row with the hash of its
    document's text as key; its copy that stays is a row too.
    """
    size, _ = _winnow(min_words)
    with Scratch() as own:
        runs = own.written(chosen_runs(docs, found, id_col, text, min_words), "repeat-runs")
        chains = own.written(_chains(runs, size), "repeat-chains")
        ends = chains.select("doc_id", "text_hash", "chain", "first_id", "first_hash", F.inline(F.array(
            F.struct(F.lit(False).alias("after"), F.col("low").alias("at"), F.col("first_low").alias("first_at")),
            F.struct(F.lit(True).alias("after"), F.col("high").alias("at"), F.col("first_high").alias("first_at")))))
        theirs = {"first_id": "doc_id", "first_hash": "text_hash", "first_at": "at"}
        wanted = ends.select("doc_id", "text_hash", "at", "after").unionByName(
            ends.select(*[F.col(a).alias(b) for a, b in theirs.items()], "after"))
        sides = own.written(_with_sides(docs, wanted, id_col, text, min_words), "repeat-sides")
        both = (ends.join(sides, ["doc_id", "text_hash", "at", "after"])
                .join(sides.withColumnsRenamed({b: a for a, b in theirs.items()} | {"words": "first_words", "places": "first_places"}),
                      [*theirs, "after"])
                .withColumn("n", _alike("words", "first_words")))

        def edge(at, places):
            """Places and words of both ends of a chain, as far as both texts go on alike."""
            before, after = ~F.col("after"), F.col("after")
            return [F.min(F.when(before, F.get(places, "n"))).alias("start"), F.max(F.when(after, F.get(places, "n"))).alias("stop"),
                    F.min(F.when(before, F.col(at) - F.col("n"))).alias("a"),
                    F.max(F.when(after, F.col(at) + size + F.col("n"))).alias("b")]

        names = ["start", "stop", "a", "b"]
        spans = (both.groupBy("doc_id", "text_hash", "chain", "first_id", "first_hash")
                 .agg(F.min("at").alias("at"), F.struct(*edge("at", "places")).alias("own"),
                      F.struct(*edge("first_at", "first_places")).alias("theirs"))
                 .select("doc_id", "text_hash", *[F.col(f"own.{c}") for c in names], F.struct(
                     "at", F.col("first_id").alias("doc_id"), F.col("first_hash").alias("text_hash"),
                     *[F.col(f"theirs.{c}") for c in names]).alias("from")))
        gone = written(_touching(spans, F.min("from").alias("first"), F.collect_set("from").alias("every"))
                       .where(F.col("passage_words") >= min_words), "repeat-passages")
    stay = _touching(gone.select(F.inline("every")).drop("at").distinct())
    return (gone.select("doc_id", "start", "stop", F.col("passage_words").alias("n_words"), "passage_words",
                        F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
                        F.lit(True).alias("removed"), F.col("text_hash").alias("key"))
            .unionByName(stay.select("doc_id", "start", "stop", F.col("passage_words").alias("n_words"), "passage_words",
                                     F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start"),
                                     F.lit(False).alias("removed"), F.col("text_hash").alias("key"))))


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, threshold: float = 0.8,
            min_words: int = 20) -> DataFrame:
    """Repeated paragraphs and units, and the exact passages that reach beyond them."""
    found = written(repeated_units(docs, id_col, text, threshold=threshold, min_words=min_words), "repeat-found")
    drop_shuffles(docs.sparkSession)
    return found.unionByName(repeated_passages(docs, found, id_col, text, min_words=min_words))


@apart()
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, threshold: float = 0.8,
                   min_words: int = 20) -> DataFrame:
    """``docs`` without the removed paragraphs, units and passages; a document of which no word is left goes."""
    found = repeats(docs, id_col, text, threshold=threshold, min_words=min_words)
    spans = (found.where("removed").groupBy(F.col("doc_id").alias("_cut_id"))
             .agg(F.collect_list(F.struct("start", "stop", "key")).alias("_cut")))
    here = docs.withColumns({"_id": F.col(id_col).cast("long"), "_hash": F.xxhash64(text)})
    schema, names = docs.schema, docs.columns
    joined = (here.where("_id IS NOT NULL").join(spans, F.col("_id") == F.col("_cut_id"), "left")
              .select(*docs.columns, "_cut", "_hash"))

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(text).to_pylist(), batch.column("_cut").to_pylist()
            hashes = batch.column("_hash").to_pylist()
            keep = []
            for n, cut in enumerate(cuts):
                if not cut or texts[n] is None:
                    keep.append(n)
                    continue
                old, parts, at = texts[n].encode(), [], 0
                for place in sorted(cut, key=lambda c: (c["start"], -c["stop"])):
                    if place["stop"] > at and (place["key"] == hashes[n]
                                               or is_key(old[place["start"]:place["stop"]].split(), place["key"])):
                        parts.append(old[at:max(at, place["start"])])
                        at = place["stop"]
                if not parts:
                    keep.append(n)
                    continue
                texts[n] = b"".join([*parts, old[at:]]).decode().rstrip()
                if texts[n].strip():
                    keep.append(n)
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, schema).unionByName(here.where("_id IS NULL").select(*docs.columns))
