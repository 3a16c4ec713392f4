"""Quality classifier trained on weak labels.

Method
1. Overlapping heuristic labellers look at each text and vote good, bad or
   nothing (``LABELLERS``).
2. The counts of all vote patterns over the whole corpus (at most
   ``3 ** len(LABELLERS)``) go to the driver, where expectation-maximisation
   estimates the share of bad texts and each labeller's vote rates on good and
   on bad texts.  A pattern's posterior is its soft label.
3. A hashed linear scorer (words, word shapes and a few measures of the text in
   ``BUCKETS`` weights) is fitted by logistic regression on the posterior
   labels of a bounded sample: about ``train_rows`` documents, chosen by a hash
   of their id, whatever the size of the corpus.
4. The scorer rates every document; documents rated below ``threshold`` are
   rejected.

Defined results: a null text or one without words has score 0 and is rejected;
documents with a null id are scored but never sampled; rows that repeat are
scored alike; an empty table gives an empty table; other columns are untouched.
"""

from __future__ import annotations

import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm import shingles
from tessera.llm.columns import apart
from tessera.llm.worker import claim

BUCKETS = 1 << 15
#: The first buckets hold measures of the whole text, see ``Words.measures``.
MEASURES = ("symbol", "capital", "bar", "shout", "repeated", "windows", "lines", "letters")
MEMO_WORDS = 300_000

#: name: (measure, bad from here on, good up to here); votes nothing in between.
#: Reversed bounds (bad below, good above) where the measure falls with bad texts.
LABELLERS = {
    "symbol words": ("symbol", 0.20, 0.02),
    "words in capitals": ("capital", 0.50, 0.10),
    "navigation bars": ("bar", 0.10, 0.01),
    "exclamations": ("shout", 0.20, 0.02),
    "word after itself": ("repeated", 0.15, 0.03),
    "windows seen before": ("windows", 0.40, 0.15),
    "lines seen before": ("lines", 0.50, 0.20),
    "few letters": ("letters", 0.70, 0.85),
}
GOOD, BAD, NOTHING = 0, 1, 2

_SYMBOL = re.compile(rb"[#*$%&|<>]").search


_RUN = re.compile(r"(.)\1{2,}", re.S).sub


def shape(word: str) -> str:
    """Word with letters as a/A, digits as 0, and runs cut to two."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:40])
    return _RUN(r"\1\1", out)


def quick_shape(word: str) -> str:
    """The same; small and capitalised words with end marks, the bulk of a text, need no look at each letter."""
    core = word.rstrip(".,;:!?")
    if core.isalpha() and len(word) <= 40:
        rest = core[1:]
        if core.islower():
            out = "aa"[:len(core)]
        elif core[0].isupper() and (not rest or rest.islower()):
            out = "A" + "aa"[:len(rest)]
        else:
            return shape(word)
        tail = word[len(core):]
        return out + (_RUN(r"\1\1", tail) if len(tail) > 2 else tail)
    return shape(word)


class Words:
    """Per-word facts, looked up once for each distinct word (bounded)."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {}
        self.forms: dict[str, int] = {}
        self.hash, self.bucket, self.shape = array("Q"), array("l"), array("l")
        self.flags, self.letters, self.chars = array("B"), array("l"), array("l")

    def learn(self, word: bytes) -> None:
        h = xxhash.xxh3_64_intdigest(word)
        text = word.decode("utf-8", "replace")
        form = quick_shape(text)
        if form not in self.forms:
            self.forms[form] = len(MEASURES) + xxhash.xxh3_64_intdigest(form.encode(), 1) % (BUCKETS - len(MEASURES))
        letters = len(text) if text.isalpha() else sum(map(str.isalpha, text))
        upper = letters > 1 and text.upper() == text
        self.place[word] = len(self.hash)
        self.hash.append(h)
        self.bucket.append(len(MEASURES) + h % (BUCKETS - len(MEASURES)))
        self.shape.append(self.forms[form])
        self.flags.append(bool(_SYMBOL(word)) + 2 * upper + 4 * (word == b"|") + 8 * word.endswith(b"!!"))
        self.letters.append(letters)
        self.chars.append(len(text))

    def ids(self, words: list[bytes]) -> np.ndarray:
        place = self.place
        for w in set(words).difference(place):
            self.learn(w)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def column(self, name: str) -> np.ndarray:
        return np.array(getattr(self, name))


_WORDS = Words()


def _measured(texts: list[bytes]):
    """For texts that have words: row numbers, the two buckets of each word, sizes, measures."""
    claim("weak_quality", _WORDS.clear)
    if len(_WORDS.place) > MEMO_WORDS:
        _WORDS.clear()
    split = [t.split() for t in texts]
    rows = np.array([n for n, w in enumerate(split) if w], np.int64)
    size = np.array([len(split[n]) for n in rows], np.int64)
    ids = _WORDS.ids([w for n in rows for w in split[n]])
    start = np.cumsum(size) - size
    flags = _WORDS.column("flags")[ids]
    mean = lambda x: np.add.reduceat(x.astype(np.int64), start) / size
    both = [_WORDS.column(c)[ids] for c in ("bucket", "shape")]
    if not len(rows):
        return rows, both, size, np.empty((0, len(MEASURES)))
    same = np.r_[False, ids[1:] == ids[:-1]]
    same[start] = False
    hashes = _WORDS.column("hash")[ids]
    again, lines = np.zeros(len(rows)), np.zeros(len(rows))
    for k, n in enumerate(rows):
        win = shingles.windows(hashes[start[k]:start[k] + size[k]], 5)
        again[k] = 1 - len(np.unique(win)) / len(win)
        parts = [p for p in texts[n].split(b"\n") if p]
        if len(parts) > 2:
            lines[k] = 1 - len(set(parts)) / len(parts)
    # smoothed, so that the full stop of a text of one short word proves nothing
    letters = ((np.add.reduceat(_WORDS.column("letters")[ids], start) + 5)
               / (np.add.reduceat(_WORDS.column("chars")[ids], start) + 6))
    return rows, both, size, np.column_stack(
        [mean(flags & 1 > 0), mean(flags & 2 > 0), mean(flags & 4 > 0), mean(flags & 8 > 0),
         mean(same), again, lines, letters])


def votes(measures: np.ndarray) -> np.ndarray:
    """Vote of each labeller (columns) on each text (rows)."""
    out = np.full((len(measures), len(LABELLERS)), NOTHING)
    for n, (name, bad, good) in enumerate(LABELLERS.values()):
        x = measures[:, MEASURES.index(name)]
        out[x >= bad if bad > good else x <= bad, n] = BAD
        out[x <= good if bad > good else x >= good, n] = GOOD
    return out


def _pattern(measures: np.ndarray) -> np.ndarray:
    return votes(measures) @ (3 ** np.arange(len(LABELLERS)))


def expectation_maximisation(counts: dict[int, int], rounds: int = 200, tolerance: float = 1e-9):
    """Posterior of bad for every pattern, share of bad, and vote rates ``[class, labeller, vote]``."""
    k = len(LABELLERS)
    table = np.array(list(itertools.product(range(3), repeat=k)))[:, ::-1]
    n = np.zeros(3 ** k)
    for p, c in counts.items():
        n[p] = c
    one = np.stack([table == v for v in range(3)], axis=2).astype(float)  # pattern, labeller, vote
    post = np.where((table == BAD).any(axis=1), 0.7, 0.05)  # one bad vote is suspicious
    share, rates, before = 0.0, np.full((2, k, 3), 1 / 3), np.inf
    for _ in range(rounds):
        mass = np.stack([n * (1 - post), n * post])
        share = (mass[1].sum() + 1) / (n.sum() + 2)
        rates = (np.einsum("cp,plv->clv", mass, one) + 0.1) / (mass.sum(axis=1)[:, None, None] + 0.3)
        log = np.einsum("plv,clv->cp", one, np.log(rates)) + np.log([[1 - share], [share]])
        top = log.max(axis=0)
        total = top + np.log(np.exp(log - top).sum(axis=0))
        post = np.exp(log[1] - total)
        now = float((n * total).sum())
        if abs(now - before) <= tolerance * max(1.0, abs(now)):
            break
        before = now
    return post, share, rates


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    share_bad: float
    rates: np.ndarray
    trained_on: int


def _batches(column: pa.Array):
    texts = [t or b"" for t in column.to_pylist()]
    for part in shingles.groups(texts):
        yield part.start, texts[part]


def vote_patterns(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Number of documents for each pattern of votes (texts with words)."""
    def run(batches):
        for batch in batches:
            for _, texts in _batches(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_pattern(_measured(texts)[3]).astype(np.int32))], names=["pattern"])

    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "pattern int")
    return {r.pattern: r.n for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def _sample(docs: DataFrame, id_col: str, text: str, posterior: np.ndarray, part: float):
    """Soft labels and sparse features of the documents whose hash (of the id, or of the text where that
    is null) is below the part."""
    draw = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(11), id_col)).otherwise(F.xxhash64(F.lit(11), text))
    picked = docs.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))

    def run(batches):
        for batch in batches:
            label, places, values = [], [], []
            for _, texts in _batches(batch.column(0)):
                rows, both, size, measures = _measured(texts)
                label.extend(1 - posterior[_pattern(measures)])
                start = np.cumsum(size) - size
                for k in range(len(rows)):
                    at = slice(start[k], start[k] + size[k])
                    place, count = np.unique(np.concatenate([b[at] for b in both]), return_counts=True)
                    places.append(np.r_[np.arange(len(MEASURES)), place].astype(np.int32))
                    values.append(np.r_[measures[k], count / size[k]].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.float64()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(values, pa.list_(pa.float32()))], names=["label", "place", "value"])

    return picked.select(F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "label double, place array<int>, value array<float>").toArrow()


def _regression(label, place, value, row, rounds: int = 150, decay: float = 1e-4):
    """Logistic regression on soft labels by accelerated full-batch gradient steps."""
    n = len(label)
    weights, intercept = np.zeros(BUCKETS), 0.0
    at, at_i, speed = weights.copy(), 0.0, 1.0
    square = np.bincount(row, value * value, n).max() + 1
    step = 4 / square
    for _ in range(rounds):
        score = np.bincount(row, at[place] * value, n) + at_i
        gap = 1 / (1 + np.exp(-score)) - label
        new = at - step * (np.bincount(place, gap[row] * value, BUCKETS) / n + decay * at)
        new_i = at_i - step * gap.mean()
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        at, at_i = new + (speed - 1) / faster * (new - weights), new_i + (speed - 1) / faster * (new_i - intercept)
        weights, intercept, speed = new, new_i, faster
    return weights, intercept


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, train_rows: int = 10_000) -> Model:
    """Labeller accuracies from all documents, linear scorer from about ``train_rows`` of them."""
    counts = vote_patterns(docs, text)
    total = sum(counts.values())
    posterior, share, rates = expectation_maximisation(counts)
    if not total:
        return Model(np.zeros(BUCKETS), 0.0, share, rates, 0)
    sample = _sample(docs, id_col, text, posterior, min(1.0, train_rows / total))
    label = sample.column("label").to_numpy()
    if not len(label):
        return Model(np.zeros(BUCKETS), 0.0, share, rates, 0)
    place = sample.column("place").combine_chunks()
    row = np.repeat(np.arange(len(label)), np.diff(place.offsets.to_numpy()))
    weights, intercept = _regression(label, place.flatten().to_numpy(),
                                     sample.column("value").combine_chunks().flatten().to_numpy().astype(float), row)
    return Model(weights, float(intercept), share, rates, len(label))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with the chance of good quality in column ``out``."""
    value = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    schema = docs.select("*").withColumn(out, F.lit(0.0)).schema
    names = schema.names

    def run(batches):
        weights, intercept = value.value
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for first, texts in _batches(batch.column(text).cast(pa.binary())):
                rows, both, size, measures = _measured(texts)
                if len(rows):
                    each = weights[both[0]] + weights[both[1]]
                    z = np.add.reduceat(each, np.cumsum(size) - size) / size
                    z += measures @ weights[:len(MEASURES)] + intercept
                    got[first + rows] = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays(
                [pa.array(got) if c == out else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, threshold: float = 0.3,
             train_rows: int = 10_000) -> DataFrame:
    """``doc_id, quality, kept`` of every document."""
    model = fit(docs, id_col, text, train_rows=train_rows)
    rated = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), model)
    return rated.select("doc_id", "quality", (F.col("quality") >= threshold).alias("kept"))


@apart()
def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, threshold: float = 0.3,
              train_rows: int = 10_000) -> DataFrame:
    """The documents that the classifier does not reject, with their columns unchanged."""
    model = fit(docs, id_col, text, train_rows=train_rows)
    rated = score(docs, model, text, "_quality")
    return rated.where(F.col("_quality") >= threshold).select(*docs.columns)
