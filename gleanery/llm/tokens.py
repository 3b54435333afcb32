"""Token counts by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary entries. ``bpe.whole_tokens`` proves, with the library
itself, which vocabulary strings encode alone as one token; a matching pre-token counts as one and only
the rest is merged. One narrow pass over the texts, no shuffle; a worker keeps one bounded cache.

Cases: a null text is empty and has 0 tokens; special strings inside a text are handled as the library
does by default (one special token), as is any text with characters that the shortcut isn't proven for;
rows repeated stay repeated; a null doc_id stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import bpe
from gleanery.llm.common import map_batches, text_of

LIMIT = 512


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every text of ``docs`` (doc_id, text)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = bpe.byte_counts(vocabulary)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([of(t.as_py()) for t in batch.column(2)], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_of()
    counted = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")), count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
