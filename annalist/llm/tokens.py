"""Token counts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: How the byte-level BPE splits a text before it merges bytes (fixed value, goes with the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The path of the public byte-level BPE ranks installed with the tokenizers' files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(2)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a ranks file, loaded once a process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """keep columns and ``tokens`` (bigint) of each row's whole text; null and empty texts have 0. Map-only."""
    path = vocabulary or default_vocabulary()
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)
