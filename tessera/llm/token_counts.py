"""Token counts with a digest cache.

Method: the SHA-256 digest of the normalised text (a null text is the empty
text; nothing else may change, because any other change would change counts)
and the digest of tokenizer file, library and library version form the cache
key.  Texts join the cache on their digest; only distinct misses are encoded,
and their counts are appended to the cache table in one committed write.  A
copy of a text is never encoded twice: misses are grouped by digest with
map-side aggregation, so a text that a third of all rows repeat leaves each
task once.  Rows then join the counts on the digest; a hot digest is split by
adaptive skew handling, the counts side has one row per digest.

Files named ``.json`` are read by the library ``tokenizers``, ``.model`` by
``sentencepiece``; counts are without begin, end or added special tokens, with
the library's default for special strings inside texts, without truncation.

Defined results: null and empty texts have 0 bytes and the count of the empty
text; null ids and repeated rows are counted like any other row; an empty table
gives an empty table and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.store import scratch_path
from tessera.llm.worker import claim

#: Texts are handed to the library in groups of about so many characters.
BATCH_CHARS = 1_000_000
_WORKER: dict[str, object] = {}


def version_of(data: bytes, name: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    if name.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + data).hexdigest()


def _counter(version: str, data: bytes, name: str):
    """The worker's function from texts to counts, loaded once per Python worker."""
    claim("token_counts", _WORKER.clear)
    if version not in _WORKER:
        _WORKER.clear()
        if name.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_str(data.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _WORKER[version] = lambda texts: [
                len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor
            model = SentencePieceProcessor(model_proto=data)
            _WORKER[version] = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    return _WORKER[version]


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored ``(digest, n_tokens)`` of a tokenizer version; None before the first append."""
    try:
        stored = spark.read.schema("digest binary, n_tokens long, version string").parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # two runs at a time may have stored a text twice
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, tokenizer: str | None = None,
                 cache: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``cache`` is the folder of the cache table, shared by all runs; without one
    the run starts an empty cache in the shared scratch folder.
    """
    import public_tokenizers
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:  # a few MB at most
        data = f.read()
    name, version = os.path.basename(path), version_of(data, path)
    shared = spark.sparkContext.broadcast(data)
    cache = cache or scratch_path(spark, "token-counts")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    known = _cached(spark, cache, version)
    misses = rows.select("digest", "text")
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    misses = misses.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        count = _counter(version, shared.value, name)
        for batch in batches:
            texts, counts, some, size = batch.column("text").to_pylist(), [], [], 0
            for t in texts:
                some.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    counts += count(some)
                    some, size = [], 0
            counts += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])

    (misses.mapInArrow(encode, "digest binary, n_tokens long").withColumn("version", F.lit(version))
     .write.mode("append").partitionBy("version").parquet(cache))
    counts = _cached(spark, cache, version)
    return (rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
            .join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
