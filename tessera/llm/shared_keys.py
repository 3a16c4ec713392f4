"""Rows whose key stands in two documents, found by one shuffle of packed rows.

A task sorts its rows by a mix of their key and hands them on in packs, one for
each of ``BUCKETS`` ranges of the mix; a pack is the compressed columns of its
rows.  The task that a bucket comes to keeps the rows of keys met in two
documents.  Rows of a key that many rows of one task share need no company:
they go, marked as found, to buckets in turn, and only two of them (least and
greatest document) are sent to the key's bucket as witnesses.  So neither the
number of rows of a key nor that of a bucket bounds what a task can take.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import shingles

BUCKETS = 1024
#: Rows that a task sorts and packs together.
PACK_ROWS = 400_000
#: Rows of one key in those that are spread over the buckets.
SPREAD_ROWS = 8
#: Rows of whole buckets, or of one bucket, that are worked on together.
ROWS_AT_ONCE = 200_000
PACKED = "bucket int, n int, pack binary"
PLAIN, WITNESS, FOUND = 0, 1, 2


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]


def _runs(key: np.ndarray, doc: np.ndarray):
    """First place and length of each run of equal keys, and its least and greatest document."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (first, np.diff(np.r_[first, len(key)]), np.minimum.reduceat(doc, first),
            np.maximum.reduceat(doc, first))


def _packs(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Packs of rows; the first column is the key, the second the document."""
    mixed = shingles.mix(rows[0].view(np.uint64))
    order = np.argsort(mixed, kind="stable")
    mixed, rows = mixed[order], [c[order] for c in rows]
    bucket = (mixed // np.uint64(2**64 // BUCKETS)).astype(np.int32)
    way = np.full(len(mixed), PLAIN, np.uint8)
    first, size, low, high = _runs(mixed, rows[1])
    many = (size > SPREAD_ROWS) & (low < high)
    if many.any():
        there = np.repeat(many, size)
        at, doc = np.flatnonzero(there), rows[1]
        of = np.repeat(np.arange(len(size)), size)[at]
        ends = [at[doc[at] == x[of]] for x in (low, high)]
        witness = np.r_[tuple(e[np.unique(mixed[e], return_index=True)[1]] for e in ends)]
        way[at], bucket_ = FOUND, bucket[witness]
        bucket[at] = np.arange(len(at)) % BUCKETS
        rows = [np.r_[c, c[witness]] for c in rows]
        way, bucket = np.r_[way, np.full(len(witness), WITNESS, np.uint8)], np.r_[bucket, bucket_]
        order = np.argsort(bucket, kind="stable")
        rows, way, bucket = [c[order] for c in rows], way[order], bucket[order]
    border = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist()
    codec, columns = _codec(), [*rows, way]
    packs = [codec.compress(b"".join([c[a:b].tobytes() for c in columns]), asbytes=True)
             for a, b in zip(border, border[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[border[:-1]]), pa.array(np.diff(border).astype(np.int32)), pa.array(packs, pa.binary())],
        names=["bucket", "n", "pack"])


def packed(parts: Iterable[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``PACKED`` for lists of columns: key, document and others."""
    held, count = [], 0
    for rows in parts:
        if len(rows[0]):
            held.append(rows)
            count += len(rows[0])
        if count >= PACK_ROWS:
            yield _packs(_joined(held))
            held, count = [], 0
    if held:
        yield _packs(_joined(held))


def _parted(rows: list[np.ndarray], known: np.ndarray):
    """Rows of keys that are known or met in two documents, the other rows, and the keys known now."""
    if not len(rows[0]):
        return [c[:0] for c in rows[:-1]], rows, known
    order = np.argsort(rows[0], kind="stable")
    rows = [c[order] for c in rows]
    first, size, low, high = _runs(rows[0], rows[1])
    met = (low < high) | np.isin(rows[0][first], known)
    here = np.repeat(met, size)
    out = here & (rows[-1] == PLAIN)
    return [c[out] for c in rows[:-1]], [c[~here] for c in rows], np.union1d(known, rows[0][first[met]])


def _shared(batches, types: list[np.dtype]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows to keep, from packs in the order of their buckets."""
    none = np.empty(0, types[0])
    held, ready, count, most, last, known = [], [], 0, ROWS_AT_ONCE, None, none
    codec, types = _codec(), [*types, np.dtype(np.uint8)]
    ends = np.cumsum([0] + [t.itemsize for t in types]).tolist()
    for batch in batches:
        for bucket, n, pack in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("pack")):
            if count >= most:
                out, rest, known = _parted(_joined(held), known)
                yield _joined([*ready, out])
                if bucket != last:
                    held, ready, count, most, known = [], [], 0, ROWS_AT_ONCE, none
                else:  # more of this bucket: its keys that were met are known, the others wait
                    held, ready, count = [rest], [], len(rest[0])
                    most = max(ROWS_AT_ONCE, 2 * count)
            last = bucket
            data = codec.decompress(pack.as_buffer(), n * ends[-1])
            rows = [np.frombuffer(data, t, n, n * a) for t, a in zip(types, ends)]
            count += n
            found = rows[-1] == FOUND
            if found.any():
                ready.append([c[found] for c in rows[:-1]])
                rows = [c[~found] for c in rows]
            held.append(rows)
    if count:
        yield _joined([*ready, _parted(_joined(held), known)[0]])


def shared_rows(packs: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Rows of ``packs`` whose key, the first column, stands with two values of the second, a document."""
    of = {"long": np.int64, "int": np.int32, "byte": np.int8, "boolean": np.bool_}
    names, types = list(schema), [np.dtype(of[t]) for t in schema.values()]

    def run(batches):
        for rows in _shared(batches, types):
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=names)

    return (packs.repartition(F.col("bucket")).sortWithinPartitions("bucket")
            .mapInArrow(run, ", ".join(f"{n} {t}" for n, t in schema.items())))
