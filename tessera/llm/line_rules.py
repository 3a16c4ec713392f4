"""Quality rules, line first: clean lines, then reject documents that lost too much.

Method: every line with a word is held against three groups of rules.
* punctuation: it must have a sentence end somewhere, at most 30% of its words
  may hold a symbol of ``#*$%&|<>`` and at most 30% may end in ``!!``;
* navigation: fewer than one word in five may be a bare separator;
* boilerplate: a line of up to 30 words must hold none of ``BOILERPLATE``.
Lines that fail are removed.  A document is kept if its base measures pass and
the failing lines held at most ``LOST_PERCENT`` of its words.

Words are runs of characters other than space and U+0009 to U+000D.  Defined
results: null, empty and word-less texts have all measures 0 and fail the base
rule; repeated rows and null ids are judged like other rows; an empty table
gives an empty table; ``clean`` passes other columns through unchanged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm import shingles

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Fixed values of the rules.
LEAST_WORDS, REPEAT_PERCENT, LOST_PERCENT = 10, 20, 40
SYMBOL_PERCENT, SHOUT_PERCENT, BAR_PERCENT, BOILERPLATE_WORDS = 30, 30, 20, 30
BOILERPLATE = ["accept cookies", "all rights reserved", "click here", "enable javascript", "log in to",
               "lorem ipsum", "privacy policy", "share this", "sign up for", "skip to content",
               "subscribe to our", "terms of use", "uses cookies"]
SENTENCE_END = r"[.!?…。！？؟।][\"'”’»)\]]*($|[ \t\n\x0b\f\r])"
_END = re.compile(SENTENCE_END).search
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE))).search
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]").search
_BARS = re.compile(r"[|>»•·/]+").fullmatch
MEMO_WORDS = 200_000


class _Kinds(dict):
    """Kind of a word in bits: 1 holds a symbol, 2 ends in !!, 4 is a bare separator."""

    def __missing__(self, word: str) -> int:
        kind = bool(_SYMBOL(word)) + 2 * word.endswith("!!") + 4 * bool(_BARS(word))
        if len(self) < MEMO_WORDS:
            self[word] = kind
        return kind


_KINDS = _Kinds()
_TO_SPACE = str.maketrans(SPACES, " " * len(SPACES))


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with words breaks one of the line rules."""
    n = len(words)
    kinds = list(map(_KINDS.__getitem__, words))
    if any(kinds):
        if 100 * sum(k & 1 for k in kinds) > SYMBOL_PERCENT * n:
            return True
        if 100 * sum(k >> 1 & 1 for k in kinds) > SHOUT_PERCENT * n:
            return True
        if 100 * sum(k >> 2 for k in kinds) >= BAR_PERCENT * n:
            return True
    if not _END(line):
        return True
    return n <= BOILERPLATE_WORDS and bool(_BOILER(line.lower()))


def repeated_words(text: bytes) -> int:
    """Words inside 5-word windows that occur twice or more in the text."""
    words = text.split()
    if len(words) < 6:
        return 0
    win = shingles.windows(shingles.hash_words(words), 5)
    _, code, count = np.unique(win, return_inverse=True, return_counts=True)
    if len(count) == len(win):
        return 0
    at = np.flatnonzero(count[code] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[list[int], str]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words`` and the cleaned text."""
    n = lost = dup = 0
    seen, left = set(), []
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            left.append(line)
            continue
        n += len(words)
        dup += line in seen
        seen.add(line)
        if line_fails(line, words):
            lost += len(words)
        else:
            left.append(line)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    return [n, chars, symbols, dup, repeated_words(text.encode()), lost], "\n".join(left)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words"]


def judged(docs: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """``docs`` with the counts and, if ``out`` is named, the cleaned text."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField(out, T.StringType())] if out else []
    new = {f.name for f in fields}
    schema = T.StructType([f for f in docs.schema if f.name not in new] + fields)
    old = [c for c in docs.columns if c not in new]

    def run(batches):
        for batch in batches:
            got = [measure(t or "") for t in batch.column(text).to_pylist()]
            counts = np.array([g[0] for g in got], np.int64).reshape(len(got), len(COUNTS))
            cleaned = [pa.array([g[1] for g in got], pa.string())] if out else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in old] + [pa.array(counts[:, k]) for k in range(len(COUNTS))] + cleaned,
                names=schema.names)

    return docs.mapInArrow(run, schema)


def verdict(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("lost_words") <= LOST_PERCENT * F.col("n_words")))


def quality_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return verdict(judged(rows)).select("doc_id", *COUNTS, "base_failed", "kept")


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept documents without their failing lines, columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_text"))
    kept = verdict(judged(rows, "_text", "_clean")).where("kept")
    return kept.select(*[F.col("_clean").alias(c) if c == text else F.col("row").getField(c).alias(c)
                         for c in docs.columns])


#: The same in DuckDB SQL.
_W = r"'[^\x20\x09-\x0D]+'"
_PHRASES = "|".join(BOILERPLATE)
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, generate_subscripts(l, 1) AS n, unnest(l) AS line
  FROM (SELECT rid, string_split(text, chr(10)) AS l FROM docs)),
worded AS (SELECT rid, n, line, regexp_extract_all(line, {_W}) AS w FROM lines),
judged AS (
  SELECT rid, n, line, len(w) AS size, row_number() OVER (PARTITION BY rid, line ORDER BY n) > 1 AS dup,
         100 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > {SYMBOL_PERCENT} * len(w)
         OR 100 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > {SHOUT_PERCENT} * len(w)
         OR 100 * len(list_filter(w, lambda x: regexp_full_match(x, '[|>»•·/]+'))) >= {BAR_PERCENT} * len(w)
         OR NOT regexp_matches(line, '[.!?…。！？؟।]["''”’»)\]]*($|[\x20\x09-\x0D])')
         OR (len(w) <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{_PHRASES}')) AS fails
  FROM worded WHERE len(w) > 0),
by_line AS (
  SELECT rid, sum(size)::BIGINT AS n_words, count(*) FILTER (WHERE dup) AS n_dup_lines,
         coalesce(sum(size) FILTER (WHERE fails), 0)::BIGINT AS lost_words
  FROM judged GROUP BY rid),
split AS (SELECT rid, regexp_extract_all(text, {_W}) AS w FROM docs),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words
  FROM again, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
counts AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lost_words, 0) AS lost_words
  FROM docs d LEFT JOIN by_line USING (rid) LEFT JOIN covered USING (rid))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
       AND 100 * lost_words <= {LOST_PERCENT} * n_words AS kept
FROM counts
"""
