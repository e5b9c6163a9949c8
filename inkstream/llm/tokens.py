"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's ranks; any file of base64 token and rank lines will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    """The tokenizer at ``path``, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(df: DataFrame, key: str, text: str, also: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *also, tokens): the size of every text; null and empty texts have size 0.

    A key that comes in several rows counts once, with its largest size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkstream.llm.tokens import encoding as load

        encode = load(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "tokens"])

    rows = df.select(F.col(text).cast("string").alias("__text"), key, *also)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", tokens bigint"
    out = rows.mapInArrow(run, schema).where(F.col(key).isNotNull())
    best = out.groupBy(key).agg(F.max(F.struct("tokens", *also)).alias("__b"))
    return best.select(key, *(F.col(f"__b.{c}").alias(c) for c in also), F.col("__b.tokens").alias("tokens"))
