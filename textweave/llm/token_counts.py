"""Token counts: lengths only leave the Arrow functions.

Batches are bounded by bytes (``prepare``), cut again to ``byte_bpe.SUB_BYTES`` inside the worker,
and a longer text is split where the pre-tokenizer always splits.  No shuffle at all.

Edge cases: null text counts as empty (0 bytes, 0 tokens); a null id is passed on; repeated rows
are counted row by row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweave.llm.common import prepare


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; path: a byte-level BPE in JSON."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from textweave.llm.byte_bpe import buffers, load

        bpe = load(path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n = [per for _, _, per in bpe.encode(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
