"""Ranked lexical search by norm buckets of impact vectors with exact integer scores.

A document is a vector of impacts over the terms that any query holds, a query one of
term weights; the score is their inner product, in whole numbers.

Method
1. One pass over the texts counts the query terms of every document.  Documents with
   any are written with their term numbers and counts; the number of documents, their
   terms and the document frequencies are sums over what was written.
2. The impacts follow from the counts; the vectors are laid out by range over their
   length, longest first, and read in buckets of ``BUCKET_ROWS`` neighbours.
3. The part with the longest vectors is searched first.  The score of a query's last
   place there is its threshold: a vector can take part only if ``|q| |d|`` reaches
   it (Cauchy-Schwarz), so the scan of the rest reads no shorter ones (a filter that
   reaches the files), and a bucket is skipped by every query it is too short for.
4. Inside a bucket the query's coordinates are taken by their largest possible share
   until the rest, bounded by the largest impacts of the bucket and by
   Cauchy-Schwarz, cannot reach the threshold alone.  Only documents with one of
   these coordinates are left, and of those only the ones whose partial score plus
   the bound of their own rest reaches it.
5. What is left is scored again in integers over all the query's terms; thresholds
   rise as places fill.  A last ranking joins the places of all tasks.

Bounds are used only to leave out documents that score below the threshold, never
equal ones, so the result is exact, ties included.

The terms and weights of at most ``QUERY_BYTES`` of queries go to the tasks at a time.
A larger set of queries is worked on in several passes over the texts.

Defined results: a document or a query with a null or empty text or without a term
has no rows; texts are read whole; a document with a null id counts in the
statistics but takes no place, as nothing could name it; rows that repeat an id are
documents of their own; ids are whole numbers; every row of the queries is ranked by itself, also if it
repeats another one; equal scores go by ascending id; columns that are not named
take no part, whatever their names; no documents or no queries give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.store import written

QUERY_BYTES = 8_000_000
BUCKET_ROWS = 2048
#: Rows of a part of the layout by length, and the most parts.
PART_ROWS, MAX_PARTS = 10_000, 50_000
#: Relative rounding of lengths and bounds is far below this.
SLACK = 1e-9

#: Bytes that end a term become spaces, A-Z become a-z; bytes of other letters stay.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of digits, letters and whatever is not ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(no, id, terms)``: a row for each row of the queries that has a term; numbers are its own."""
    id_type = items.schema[id_col].dataType.simpleString()
    src = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms(t or b""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.binary()))],
                                             names=["id", "terms"])

    made = src.mapInArrow(run, f"id {id_type}, terms array<binary>").where(F.size("terms") > 0)
    return written(made.select(F.monotonically_increasing_id().alias("no"), "id", "terms"), "search-queries")


def count_terms(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, tfs)``: number of terms, and the numbers and counts of those in ``number``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            size, term, tf, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py() or b"")
                count = Counter(map(number.get, words))
                count.pop(None, None)
                size.append(len(words))
                term += count.keys()
                tf += count.values()
                ends.append(len(term))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["id", "n", "terms", "tfs"])

    counted = src.mapInArrow(run, f"id {id_type}, n long, terms array<int>, tfs array<long>")
    return written(counted.where("n > 0"), "search-counts")


def impact_vectors(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``(id, terms, impacts, norm, part)`` laid out by descending length; ids that are null stay out."""
    named = counts.where("id IS NOT NULL AND size(terms) > 0").select(
        "id", "terms", "tfs", F.expr(f"100 - 90 + (90 * n * {n_docs}L) div {n_terms}L").alias("m"))
    vectors = named.select("id", "terms", F.expr(
        "transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))").alias("impacts"))
    vectors = vectors.withColumn("norm", F.expr(
        "sqrt(aggregate(impacts, 0D, (s, d) -> s + cast(d AS double) * d))"))
    rows = vectors.count()
    parts = min(MAX_PARTS, max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))
    # the id's hash spreads equal lengths (copies) over several parts
    laid = vectors.repartitionByRange(parts, F.desc("norm"), F.xxhash64("id")).sortWithinPartitions(F.desc("norm"))
    return written(laid.withColumn("part", F.spark_partition_id()), "search-vectors")


class Query:
    """Weights above 0 of a query by term number, its length and its best places so far."""

    def __init__(self, no: int, term: np.ndarray, value: np.ndarray, threshold: int, k: int):
        self.no, self.term, self.value, self.k = no, term, value, k
        self.norm = float(np.sqrt((value.astype(np.float64) ** 2).sum()))
        self.given, self.least = threshold, max(threshold, 1)
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score, score], np.r_[self.id, ids]
        best = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[best], ids[best]
        if len(best) == self.k:
            self.least = max(self.given, int(score[best[-1]]), 1)


class Bucket:
    """Vectors of about the same length, by row and by coordinate."""

    def __init__(self, ids, norms, terms, impacts, size):
        self.ids, self.norm2, self.longest = ids, norms ** 2, float(norms.max())
        self.term, self.impact, self.size, self.start = terms, impacts, size, np.cumsum(size) - size
        order = np.argsort(terms, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), size)[order]
        self.by_term = impacts[order]
        self.has, self.at = np.unique(terms[order], return_index=True)
        self.end = np.r_[self.at[1:], len(terms)]
        self.most = np.maximum.reduceat(self.by_term, self.at)

    def survivors(self, q: Query) -> np.ndarray:
        """Rows that the coordinate bounds cannot rule out."""
        none = np.empty(0, np.int64)
        at = np.searchsorted(self.has, q.term)
        held = at < len(self.has)
        held[held] = self.has[at[held]] == q.term[held]
        at, value = at[held], q.value[held]
        share = value * self.most[at]
        order = np.argsort(-share, kind="stable")
        at, value, share = at[order], value[order], share[order]
        # after[i]: what coordinates from i on can add, by the largest impacts, and their length
        after = np.r_[np.cumsum(share[::-1])[::-1], 0]
        length = np.sqrt(np.r_[np.cumsum((value.astype(np.float64) ** 2)[::-1])[::-1], 0])
        reach = np.minimum(after, length * self.longest * (1 + SLACK))
        focus = int(np.argmax(reach < q.least))          # the last entry is 0, below any threshold
        if not focus:
            return none
        partial, square = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for t, w in zip(at[:focus].tolist(), value[:focus].tolist()):
            rows, impact = self.row[self.at[t]:self.end[t]], self.by_term[self.at[t]:self.end[t]]
            partial[rows] += w * impact
            square[rows] += impact.astype(np.float64) ** 2
        rest = np.sqrt(np.maximum(self.norm2 * (1 + SLACK) - square, 0)) * (length[focus] * (1 + SLACK))
        return np.flatnonzero((partial > 0) & (partial + np.minimum(rest, after[focus]) >= q.least))

    def scores(self, q: Query, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of the rows; ``dense`` is a vector of zeros, as long as there are terms."""
        dense[q.term] = q.value
        size = self.size[rows]
        first = np.cumsum(size) - size
        at = np.repeat(self.start[rows] - first, size) + np.arange(size.sum())
        out = np.add.reduceat(dense[self.term[at]] * self.impact[at], first)
        dense[q.term] = 0
        return out


def buckets(batches):
    """Buckets of about ``BUCKET_ROWS`` rows in the order of the rows."""
    for batch in batches:
        norms = batch.column("norm").to_numpy()
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        term, impact = batch.column("terms"), batch.column("impacts")
        size = term.value_lengths().to_numpy()
        ends = np.cumsum(size)
        term, impact = term.flatten().to_numpy(), impact.flatten().to_numpy()
        for a in range(0, len(ids), BUCKET_ROWS):
            b = min(a + BUCKET_ROWS, len(ids))
            lo, hi = ends[a] - size[a], ends[b - 1]
            yield Bucket(ids[a:b], norms[a:b], term[lo:hi], impact[lo:hi], size[a:b].astype(np.int64))


def search(vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray, int]], k: int,
           n_terms: int) -> DataFrame:
    """``(no, id, score)``: the best places of every query in each task.

    A query is ``(no, term numbers, weights, threshold)``."""
    id_type = vectors.schema["id"].dataType.simpleString()
    id_arrow = to_arrow_type(vectors.schema["id"].dataType)

    def run(batches):
        work = [Query(*q, k) for q in queries]
        norms = np.array([q.norm for q in work])
        dense = np.zeros(n_terms, np.int64)
        for bucket in buckets(batches):
            least = np.array([q.least for q in work])
            for at in np.flatnonzero(norms * bucket.longest * (1 + SLACK) >= least).tolist():
                q = work[at]
                rows = bucket.survivors(q)
                if len(rows):
                    score = bucket.scores(q, rows, dense)
                    good = score >= q.least
                    q.add(score[good], bucket.ids[rows[good]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([q.no for q in work], [len(q.id) for q in work]).astype(np.int64)),
             pa.array(np.concatenate([q.id for q in work])).cast(id_arrow), pa.array(np.concatenate([q.score for q in work]))],
            names=["no", "id", "score"])

    return vectors.select("id", "terms", "impacts", "norm").mapInArrow(run, f"no long, id {id_type}, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` places of every query; a task has given at most that many."""
    order = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, k: int) -> DataFrame | None:
    """Places of queries whose terms are known to fit into ``QUERY_BYTES``."""
    asked = queries.select("no", "terms").collect()
    number = {t: i for i, t in enumerate(sorted({bytes(t) for q in asked for t in q["terms"]}))}
    counts = count_terms(docs, id_col, text_col, number)
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each query term
    weights = {i: weight(n_docs, df[i]) for i in df}
    plan = []
    for q in asked:
        term = np.array(sorted(i for i in (number[bytes(t)] for t in q["terms"]) if weights.get(i, 0) > 0), np.int64)
        if len(term):
            plan.append((q["no"], term, np.array([weights[i] for i in term.tolist()], np.int64), 0))
    if not plan:
        return None
    vectors = impact_vectors(counts, n_docs, n_terms)
    first = written(best(search(vectors.where("part = 0"), plan, k, len(number)), k), "search-longest")
    last = dict(first.where(F.col("rank") == k).select("no", "score").collect())
    plan = [(no, term, value, last.get(no, 0)) for no, term, value, _ in plan]
    shortest = min(t / float(np.sqrt((v.astype(np.float64) ** 2).sum())) for _, _, v, t in plan) * (1 - SLACK)
    rest = search(vectors.where((F.col("part") > 0) & (F.col("norm") >= shortest)), plan, k, len(number))
    return best(first.drop("rank").unionByName(rest), k)


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", *, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every item."""
    queries = query_terms(items, item_id, item_text)
    size = queries.agg(F.sum(F.expr("aggregate(terms, 0L, (s, t) -> s + octet_length(t) + 40)"))).first()[0] or 0
    passes = -(-size // query_bytes)
    found = [queries.select(F.col("no"), F.lit(None).cast(docs.schema[doc_id].dataType).alias("id"),
                            F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).where("false")]
    for at in range(passes):
        part = _ranked(docs, doc_id, text, queries.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == at), k)
        if part is not None:
            found.append(part.select("no", "id", "score", "rank"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.join(queries.select("no", F.col("id").alias("item")), "no").select(
        F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


#: The same in DuckDB SQL.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
tf AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
        FROM benchmark)),
scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT *
      ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), total
  GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
