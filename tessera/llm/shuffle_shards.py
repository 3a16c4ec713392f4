"""Sharding by a two-pass external shuffle.

Method
1. *Scatter*: a seeded hash of id and text deals every row into one of
   ``ceil(total bytes / bucket_bytes)`` buckets, uniformly.  Rows that repeat id
   and text would all hash alike, so the second and later ones that a task meets
   are dealt by their number and task as well; they are interchangeable.
2. *Shuffle*: the rows of a bucket, sorted by hash so that reruns agree, go
   through a Fisher-Yates shuffle seeded by bucket, and are written.  A bucket
   fits in a task's memory at any size of the table.
3. The row counts of the buckets, summed in bucket order, give every row its
   place in the whole; place modulo the number of shards is its shard, the
   quotient its slot.  Shards therefore differ by one row at most (law ``rows``).

The counts are two numbers per bucket (16 bytes for ``bucket_bytes`` of input);
they are broadcast up to ``BROADCAST_BUCKETS`` buckets and joined by shuffle
beyond.

Defined results: null text has size 1 and the checksum of no bytes; null ids
are scattered by their text; repeated rows each get a slot; an empty table
gives an empty table; ``write_shards`` writes all columns unchanged, next to
``shard`` and ``slot`` (input columns of these names are prefixed ``src_``).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.llm.columns import apart
from tessera.llm.store import written

BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 100_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random permutation of ``range(n)``."""
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)) if n > 1 else ()):
        order[i], order[j] = order[j], order[i]
    return order


def _scattered(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``rows`` (with hash ``_row``) and their bucket."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_nth", T.LongType())])

    def number(batches):
        met: Counter[int] = Counter()
        task = TaskContext.get().partitionId() + 1
        for batch in batches:
            nth = np.zeros(batch.num_rows, np.int64)
            for n, h in enumerate(batch.column("_row").to_pylist()):
                if met[h]:
                    nth[n] = met[h] << 24 | task
                met[h] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=schema.names)

    numbered = rows.mapInArrow(number, schema)
    return numbered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row", "_nth"), F.lit(buckets)).cast("int"))


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of each bucket in random order, with their place in the bucket."""
    names = [c for c in rows.columns if c != "_nth"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("_place", T.LongType())])

    def permute(table: pa.Table):
        bucket = table.column("_bucket")[0].as_py()
        order = fisher_yates(table.num_rows, np.random.Generator(np.random.PCG64([seed, bucket])))
        out = table.take(pa.array(order)).append_column("_place", pa.array(np.arange(table.num_rows)))
        yield from out.to_batches(max_chunksize=2000)

    def run(batches):
        held = None
        for batch in batches:
            part = pa.table([batch.column(c) for c in names], names=names)
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows and held.column("_bucket")[0] != held.column("_bucket")[held.num_rows - 1]:
                bucket = held.column("_bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[0], side="right"))
                yield from permute(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from permute(held)

    order = ["_bucket", F.xxhash64(F.lit(seed + 1), "_row"), "_row", "_nth"]
    return rows.repartition("_bucket").sortWithinPartitions(*order).mapInArrow(run, schema)


@apart()
def shuffled_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shards: int = 8, seed: int = 17,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in written, shuffled buckets, with ``_size, _crc, shard, slot``."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select("*", size.alias("_size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
                       F.xxhash64(id_col, text).alias("_row"))
    done = written(_shuffled(_scattered(rows, buckets, seed), seed).drop("_row"), "shuffled")
    counts = done.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    before = F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before
    at = F.col("_before") + F.col("_place")
    return (done.join(before, "_bucket")
            .withColumn("shard", F.pmod(at, F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor(at / shards).cast("long"))
            .drop("_bucket", "_place", "_before"))


def shard_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, shards: int = 8, seed: int = 17,
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    rows = shuffled_table(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), shards=shards,
                          seed=seed, bucket_bytes=bucket_bytes)
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", **options) -> None:
    """Write the shuffled rows as Parquet folders ``shard=0``, ``shard=1``, ... under ``path``."""
    rows = shuffled_table(docs, id_col, text, **options).drop("_size", "_crc")
    rows.write.partitionBy("shard").parquet(path)
