"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Method: every task keeps an in-process DuckDB with the merge table
``merges(a, b, r)`` (all pairs of vocabulary tokens whose concatenation is a
token of rank ``r``) and the vocabulary.  The distinct words a batch has not
met before become rows of the list of their bytes' tokens and the list of the
ranks of neighbouring pairs (two bytes have one of 65,536 ranks); a recursive
query joins them with the merge table and contracts each word's leftmost
minimum-rank pair until none is left.  Decoding joins token-position rows with
the vocabulary and concatenates by an ordered aggregation.

Texts are cut before every single space that stands between two other
characters that are not white space.  No match of the split pattern spans such
a place, so the pieces can be encoded on their own, and pieces seen before are
looked up.  The memo is bounded (``MEMO_PIECES``) and holds only values of a
pure function: losing a worker loses nothing.

Words longer than ``LONG_WORD_BYTES`` (the recursive state is a list per word,
its work grows with the square of the length) take a heap that contracts the
same leftmost minimum-rank pair; the result is the same.

Defined results: a null text encodes and decodes as the empty text (no tokens);
an empty table gives an empty table; repeated rows give repeated rows; columns
of the input other than the id and the text are passed through by ``encode``
and ``decode``; one of the name that the result is given is kept as ``src_<name>``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.columns import apart
from tessera.llm.worker import claim

MEMO_PIECES = 600_000
#: Words of one DuckDB call; bounds what the recursive query holds.
WORDS_PER_QUERY = 25_000
LONG_WORD_BYTES = 1024
#: Texts are handed to DuckDB in groups of about so many characters.
BATCH_CHARS = 4_000_000
NO_PAIR = 1_000_000_000
SPACE_BESIDE_SPACE = re.compile(r"\s | \s|\A | \Z").search
ASCII_SPACES = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

ENCODE_SQL = f"""
WITH RECURSIVE step AS (
  SELECT w, l, k FROM words
  UNION ALL
  SELECT w,
         list_concat(list_append(l[:i - 1], r), l[i + 2:]) AS l,
         list_concat(
           list_concat(
             list_concat(k[:greatest(i - 2, 0)],
                         CASE WHEN i > 1 THEN [coalesce(lr, {NO_PAIR})] ELSE [] END),
             CASE WHEN i < len(k) THEN [coalesce(rr, {NO_PAIR})] ELSE [] END),
           k[i + 2:]) AS k
  FROM (
    SELECT s.*, ml.r AS lr, mr.r AS rr
    FROM (SELECT w, l, k, r, i, l[i - 1] AS la, l[i + 2] AS rb
          FROM (SELECT w, l, k, r, list_position(k, r)::INT AS i
                FROM (SELECT w, l, k, list_min(k) AS r FROM step)
                WHERE r < {NO_PAIR})) s
    LEFT JOIN merges ml ON ml.a = s.la AND ml.b = s.r
    LEFT JOIN merges mr ON mr.a = s.r AND mr.b = s.rb)
)
SELECT w, l FROM step WHERE len(k) = 0 OR list_min(k) >= {NO_PAIR}
"""

DECODE_SQL = """
SELECT d, string_agg(s, '' ORDER BY p) AS s
FROM tokens JOIN vocab USING (id) GROUP BY d
"""


def space_beside_space(text: str, parts: list[str]) -> bool:
    """Whether a space of the text, which cuts it into ``parts``, is at an end or beside white space."""
    if not text.isascii():
        return SPACE_BESIDE_SPACE(text) is not None
    return ("" in parts or any(c in text and (f" {c}" in text or f"{c} " in text) for c in ASCII_SPACES))


class Places(dict):
    """Memo places of pieces; one that is not known gets the next place and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        return place


class Spaced(dict):
    """Memo places of pieces by what follows their leading space."""

    def __init__(self, places: Places):
        super().__init__()
        self.places = places

    def __missing__(self, part: str) -> int:
        place = self[part] = self.places[" " + part]
        return place


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern (one per Python worker)."""

    def __init__(self, ranks_data: bytes, pattern: str):
        import duckdb
        import regex
        self.ranks = parse_ranks(ranks_data)
        self.split = regex.compile(pattern).findall
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        a, b, r = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), r.append(rank)
        self.merge = dict(zip(zip(a, b), r))
        byte = self.byte_rank.tolist()
        self.pair_rank = np.array([self.merge.get((x, y), NO_PAIR) for x in byte for y in byte], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self._load("merges", {"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
                              "r": pa.array(r, pa.int32())})
        self._load("vocab", {"id": pa.array(self.ranks.values(), pa.int32()),
                             "s": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.clear()

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def clear(self) -> None:
        """Forget all pieces and words: their place, ids (decimal, spaced) and decoded text."""
        self.known = Places()
        self.spaced = Spaced(self.known)
        self.ids_of: list[bytes] = []
        self.text_of: list[str] = []

    def _set(self, places: list[int], pieces: list[str], ids: list[bytes], texts: list[str]) -> None:
        """Fill places of the memo that have been given out."""
        more = len(self.known) - len(self.ids_of)
        self.ids_of += [b""] * more
        self.text_of += [""] * more
        for at, piece, i, text in zip(places, pieces, ids, texts):
            self.ids_of[at], self.text_of[at] = i, piece if text == piece else text  # one string for both

    # -- words ---------------------------------------------------------------
    def _contract(self, word: bytes) -> list[int]:
        """Leftmost minimum-rank contraction with a heap, for very long words."""
        tok = self.byte_rank[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.merge[p], i, p) for i, p in enumerate(zip(tok, tok[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or (tok[i], tok[j]) != pair:
                continue
            tok[i], alive[j], nxt[i] = rank, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (tok[x], tok[y]) in self.merge:
                    heapq.heappush(heap, (self.merge[tok[x], tok[y]], x, (tok[x], tok[y])))
        return [t for t, a in zip(tok, alive) if a]

    def _encode_words(self, words: list[bytes]) -> None:
        """Load table ``ids(w, l)``: a vocabulary entry is one token, others are contracted."""
        whole = [self.ranks.get(w) for w in words]
        long_ = [n for n, w in enumerate(words) if whole[n] is None and len(w) > LONG_WORD_BYTES]
        known = [n for n, r in enumerate(whole) if r is not None]
        skip = set(long_)
        todo = [n for n, r in enumerate(whole) if r is None and n not in skip]
        flat = np.frombuffer(b"".join([words[n] for n in todo]), np.uint8)
        size = np.fromiter((len(words[n]) for n in todo), np.int64, len(todo))
        ends = np.r_[0, np.cumsum(size)]
        pair = np.delete(self.pair_rank[flat[:-1].astype(np.int32) * 256 + flat[1:]], ends[1:-1] - 1)  # none across words
        lists = lambda offsets, values: pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(values))
        self._load("words", {"w": pa.array(todo, pa.int32()), "l": lists(ends, self.byte_rank[flat]),
                             "k": lists(ends - np.arange(len(ends)), pair)})
        self._load("ids", {
            "w": pa.array(known + long_, pa.int32()),
            "l": pa.array([[whole[n]] for n in known] + [self._contract(words[n]) for n in long_],
                          pa.list_(pa.int32()))})
        self.db.execute("INSERT INTO ids " + ENCODE_SQL)

    def _learn_words(self, words: list[str]) -> None:
        """Ids and, from the ids, bytes of words; they go to the memo."""
        known = self.known
        for k in range(0, len(words), WORDS_PER_QUERY):
            some = words[k:k + WORDS_PER_QUERY]
            self._encode_words([w.encode() for w in some])
            self.db.execute("CREATE OR REPLACE TABLE tokens AS SELECT w AS d, "
                            "generate_subscripts(l, 1) AS p, unnest(l) AS id FROM ids")
            got = self.db.sql(f"SELECT array_to_string(i.l, ' ') AS i, t.s "
                              f"FROM ids i JOIN ({DECODE_SQL}) t ON t.d = i.w "
                              "ORDER BY i.w").to_arrow_table()
            ids, texts = (got.column(c).to_pylist() for c in ("i", "s"))
            self._set([known[w] for w in some], some, list(map(str.encode, ids)),
                      [t if t.isascii() else t.encode("latin-1").decode() for t in texts])

    # -- texts ---------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The text cut before single spaces between characters that aren't white space."""
        if not text:
            return []
        parts = text.split(" ")
        if not space_beside_space(text, parts):
            return [parts[0], *map(" ".__add__, parts[1:])]
        out, open_ = [], None
        for part in parts:
            if open_ is None:
                open_ = part
            elif open_ and part and not open_[-1].isspace() and not part[0].isspace():
                out.append(open_)
                open_ = " " + part
            else:
                open_ += " " + part
        out.append(open_)
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces that are not in the memo."""
        known, ids, text = self.known, self.ids_of, self.text_of
        split = [self.split(p) for p in pieces]
        waiting = set(pieces)
        one = [p for p, words in zip(pieces, split) if len(words) == 1]
        words = dict.fromkeys(one)
        words.update((w, None) for ws in split if len(ws) > 1 for w in ws if w not in known or w in waiting)
        self._learn_words(list(words))
        many = [(p, [known[w] for w in ws]) for p, ws in zip(pieces, split) if len(ws) > 1]
        self._set([known[p] for p, _ in many], [p for p, _ in many], [b" ".join([ids[i] for i in at]) for _, at in many],
                  ["".join([text[i] for i in at]) for _, at in many])
        known.new.clear()

    def _places(self, text: str) -> list[int]:
        parts = text.split(" ")
        if text and not space_beside_space(text, parts):
            return [self.known[parts[0]], *map(self.spaced.__getitem__, parts[1:])]
        return list(map(self.known.__getitem__, self.pieces(text)))

    def index(self, texts: list[str]) -> list[list[int]]:
        """For each text the memo places of its pieces, in order."""
        if len(self.known) > MEMO_PIECES:
            self.clear()
        self.known.new.clear()
        places = [self._places(t) for t in texts]
        if self.known.new:
            try:
                self._learn(list(self.known.new))
            except BaseException:
                self.clear()  # no place may stay without its ids
                raise
        return places

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(b" ".join([self.ids_of[i] for i in ix]).decode().split(), np.int32)
                for ix in self.index(texts)]

    def decode(self, ids: list) -> list[bytes]:
        """Bytes of each id list, by an ordered aggregation over its token positions."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        out = [b""] * len(ids)
        if not size.sum():
            return out
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids if len(x)])
        self._load("tokens", {"d": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), size)),
                              "p": pa.array(np.arange(len(flat), dtype=np.int64)),
                              "id": pa.array(flat)})
        got = self.db.sql(DECODE_SQL).to_arrow_table()
        for d, s in zip(got.column("d").to_pylist(), got.column("s").to_pylist()):
            out[d] = s.encode("latin-1")
        return out


_WORKER: dict[tuple, ByteBpe] = {}


def _bpe(ranks_data: bytes, pattern: str) -> ByteBpe:
    """The worker's encoder; its tables are built once per Python worker."""
    claim("byte_bpe", _WORKER.clear)
    key = (hashlib.md5(ranks_data).digest(), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = ByteBpe(ranks_data, pattern)
    return _WORKER[key]


def _groups(texts: list[str], chars: int = BATCH_CHARS) -> Iterator[slice]:
    start = size = 0
    for n, t in enumerate(texts):
        if n > start and size + len(t) > chars:
            yield slice(start, n)
            start, size = n, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _shared(df: DataFrame, ranks_path: str | None, pattern: str | None):
    """The rank file (under 1 MB, read once by the driver) as a broadcast value."""
    import public_tokenizers
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read()), pattern or public_tokenizers.PATTERN


def _mapped(df: DataFrame, text: str, fields: list[T.StructField], ranks_path, pattern, make):
    """All columns of ``df`` and those that ``make(bpe, values)`` gives for column ``text``."""
    data, pattern = _shared(df, ranks_path, pattern)
    schema = T.StructType([f for f in df.schema if f.name not in {x.name for x in fields}] + fields)
    names = [f.name for f in schema if f.name not in {x.name for x in fields}]

    def run(batches):
        bpe = _bpe(data.value, pattern)
        for batch in batches:
            got = make(bpe, batch.column(text))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *got],
                                             names=schema.names)

    return df.mapInArrow(run, schema)


@apart("ids")
def encode(df: DataFrame, text: str = "text", ids: str = "ids", *, ranks_path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Add the token ids of column ``text`` as an array of ints."""
    def make(bpe: ByteBpe, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        out = [x for s in _groups(texts) for x in bpe.encode(texts[s])]
        return [pa.array(out, pa.list_(pa.int32()))]
    return _mapped(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], ranks_path, pattern, make)


@apart("out")
def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", *, ranks_path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Add the bytes that the id array of column ``ids`` stands for (null: no bytes)."""
    def make(bpe: ByteBpe, column: pa.Array):
        return [pa.array(bpe.decode([x or [] for x in column.to_pylist()]), pa.binary())]
    return _mapped(df, ids, [T.StructField(out, T.BinaryType())], ranks_path, pattern, make)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *,
               ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every text: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``ids_sha256`` is the digest of the decimal ids joined by single spaces,
    ``decoded_sha256`` of the decoded bytes; the ids of a text never leave the
    task that made them.
    """
    def make(bpe: ByteBpe, column: pa.Array):
        texts = [t or "" for t in column.to_pylist()]
        n, a, b = [], [], []
        for s in _groups(texts):
            found = bpe.index(texts[s])
            ids, decoded = (x.__getitem__ for x in (bpe.ids_of, bpe.text_of))
            for ix in found:
                spaced = b" ".join(map(ids, ix))
                n.append(spaced.count(b" ") + 1 if ix else 0)
                a.append(hashlib.sha256(spaced).hexdigest())
                b.append(hashlib.sha256("".join(map(decoded, ix)).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    out = _mapped(docs.select(F.col(id_col), F.col(text).alias("text")), "text", fields,
                  ranks_path, pattern, make)
    return out.drop("text")
