"""Token counts through a cache of content digests (operator 7).

The cache is a Parquet table of (tokenizer digest, content digest, count). A run joins
the digests of its documents to it, encodes one text for each digest that is missing and
appends the counts. Only digests meet in the joins by content, so a text with very many
copies costs one encoding and narrow rows.
"""

from __future__ import annotations

import hashlib
import importlib.metadata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.llm.arrow import map_slices, texts
from ocelens.llm.encoders import by_library, drops_white_space, vocabulary
from ocelens.session import materialise

_CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its file and by the version of the library that reads it."""
    found = hashlib.sha256(vocabulary(path))
    found.update(importlib.metadata.version("tokenizers").encode())
    return found.hexdigest()


def content_digest(text: Column, spec: bytes) -> Column:
    """Digest of the normalised text: texts with equal digests have equal counts.

    Where a tokenizer sees white space only as a separator, runs of ASCII white space
    count as one blank; for any other tokenizer the text stands as it is.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    if drops_white_space(spec):
        whole = F.trim(F.regexp_replace(whole, r"[ \t\n\x0B\f\r]+", " "))
    return F.unhex(F.sha2(whole, 256))


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens), one row per digest, also if two runs appended it."""
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(folder)  # there may be none yet
    rows = spark.read.schema(_CACHE).parquet(folder).where(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): UTF-8 bytes and token count of every whole text.

    Columns read: doc_id, text. ``path`` is a file of the tokenizers library, ``cache`` a
    shared folder. A null text is empty, a null doc_id stays null, a repeated row gives a
    repeated result. Special strings inside texts are handled as the library's default.
    """
    spark = docs.sparkSession
    spec, tokenizer = vocabulary(path), tokenizer_digest(path)
    get = by_library(spark, path)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", content_digest(F.col("text"), spec))
    keyed = materialise(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("_chosen"))
    missing = materialise(wanted.join(read_cache(spark, cache, tokenizer), "digest", "left_anti"))
    chosen = rows.join(missing.withColumnRenamed("digest", "_digest"), F.col("doc_id").eqNullSafe(F.col("_chosen")) & (F.col("digest") == F.col("_digest")))

    def make():
        encoder, seen = get(), set()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            rows, counts = [], []
            for row, (digest, text) in enumerate(zip(part.column("digest").to_pylist(), texts(part, "text"), strict=True)):
                if digest in seen:  # a repeated row
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(digest)
                rows.append(row)
                counts.append(len(encoder.encode(text)) // 4)
            return pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(rows, pa.int32())), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

        return step

    counted = map_slices(chosen.select("digest", "text"), "text", make, "digest binary, n_tokens long")
    counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # stored, so that both sides of the join are plain shuffles and a hot digest can be split
    known = materialise(read_cache(spark, cache, tokenizer))
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")
