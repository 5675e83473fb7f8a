"""Token counts of whole texts by rank-synchronous array merging (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.llm import bpe

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    Narrow: one pass, no shuffle. Each worker holds a batch of distinct pre-tokens as one
    ragged array and merges all of them together, lowest rank of each first; a text's count
    is the sum of what survives of its pre-tokens. Texts of any length are worked through in
    blocks of some megabytes cut where no pre-token crosses.

    A null or empty text has 0 bytes and 0 tokens; a null key stays null; repeated rows each
    give a row; an empty table gives none. Other columns are neither read nor returned.
    """
    path = path or vocabulary_path()
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        for batch in batches:
            sizes = np.diff(bpe.text_buffer(batch.column(1))[1])
            tokens = bpe.count_texts(tokenizer, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(tokens)], names=[key, "n_bytes", "n_tokens"]
            )

    counted = docs.select(F.col(key), F.col(text)).mapInArrow(
        run, f"`{key}` {key_type}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
