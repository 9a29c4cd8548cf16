"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter and never part of the library."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_sizes(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` and `n_tokens`. The strings of special tokens count as ordinary text; a null text has no size.
    One narrow Arrow pass over id and text; whole texts are encoded."""
    src = df.select(*keep, F.col(text).alias("_text"))
    kinds = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else len(encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(run, kinds)
