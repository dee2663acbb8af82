"""Token counts with a digest cache.

The count of a text is stored under (tokenizer version, digest of the normalised text; for tokenizers
that keep white space the text is left as it is). Any .json or .model vocabulary will do. A run
joins its digests to the stored counts, encodes each distinct text that is missing once, appends
those counts to the cache, and joins again.

Defined cases: a null text counts as empty; empty and blank texts have no tokens; repeated rows
each get a result; a null id is kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerhop.llm.common import is_word_tokenizer, map_batches, vocabulary_digest, word_tokens
from ledgerhop.staging import stage_path

WORD_BPE = "word_bpe_49k.json"
STORED = "digest binary, n_tokens bigint"


def normalised(text: Column) -> Column:
    """Content that decides the count: a tokenizer that drops white space gives the same ids
    for any run of it, so runs become one blank and the ends are trimmed."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def count_tokens(docs: DataFrame, vocabulary: str = WORD_BPE, cache: str | None = None,
                 limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs(doc_id, text)``.

    ``cache`` is a shared folder that later runs may use again; without one the run makes a new
    folder under ``spark.checkpoint.dir``. Counts are appended as one Spark write, so a lost
    executor costs a task, and two runs appending the same text do no harm.
    """
    spark = docs.sparkSession
    folder = f"{cache or stage_path(spark, 'token-counts')}/tokenizer={vocabulary_digest(vocabulary)}"
    spark.createDataFrame([], STORED).coalesce(1).write.mode("append").parquet(folder)

    text = normalised(F.col("text")) if is_word_tokenizer(vocabulary) else F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    distinct = docs.select(digest.alias("digest"), text.alias("body")).groupBy("digest").agg(
        F.first("body").alias("body")
    )
    missing = distinct.join(stored_counts(spark, folder), "digest", "left_anti")
    encoded(missing, vocabulary).write.mode("append").parquet(folder)

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                       digest.alias("digest"))
    return rows.join(stored_counts(spark, folder), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def stored_counts(spark, folder: str) -> DataFrame:
    """One row per digest, whoever stored it."""
    return spark.read.schema(STORED).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, vocabulary: str) -> DataFrame:
    """Counts of ``texts(digest, body)``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = word_tokens(vocabulary)
        counts = [len(ids) // 4 for ids in tokens.ids(batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return map_batches(texts.select("digest", F.col("body").cast("binary").alias("body")), count, STORED)
