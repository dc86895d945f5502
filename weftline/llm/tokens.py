"""Token counts of a public byte-level BPE vocabulary, in Arrow batches.

The vocabulary file is a parameter and must be on the same path on every worker; it
is read once for each worker process.  Null and empty texts have no tokens; strings
of special tokens count as ordinary text; texts are counted whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def version(path: str = TOKENIZER) -> str:
    """The name under which counts of this vocabulary are kept."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def token_counts(docs: DataFrame, keys: list[str], tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``keys`` and n_tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    schema = docs.select(*keys).schema.add("n_tokens", T.LongType())
    return docs.select(*keys, text).mapInArrow(run, schema)
