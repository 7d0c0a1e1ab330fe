"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Rank file of a byte-level BPE; a parameter of every operator that counts tokens. It is read where the tasks run.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, built once in each Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(vocabulary).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, keep: Sequence[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, tokens) of every row of ``df`` with a key; null texts have 0 tokens. Whole texts are encoded."""
    kinds = {n: df.schema[n].dataType for n in keep}
    out = StructType([StructField("id", df.schema[key].dataType), *[StructField(n, t) for n, t in kinds.items()], StructField("tokens", LongType())])
    schema = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(schema.field(i).type) for i in range(b.num_columns - 1)], sizes], schema=schema)

    return df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), *[F.col(f"`{n}`") for n in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(count, out)
