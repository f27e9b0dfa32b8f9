"""Token counts of whole texts by a compiled finite-state tokenizer.

See :mod:`patronage.llm.token_fst`.  Defined results: a NULL text counts as empty (no
bytes, no tokens); NULL or repeated ids pass through, a row each; no rows give none.
Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.token_fst import count_tokens

LIMIT = 512


def token_counts(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT
) -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit of every row.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch(
                {"k": batch.column("k"), "n_bytes": batch.column("n_bytes"),
                 "n_tokens": count_tokens(texts, tokenizer)}
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("k"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias("text"),
    )
    counted = rows.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


