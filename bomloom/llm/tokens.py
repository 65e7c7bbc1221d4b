"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie on every machine.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SIZED = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("copy1", pa.int64()), ("copy2", pa.int64()), ("quality", pa.float64())]
)


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def quality(text: str) -> float:
    """A weight in (0, 1]: the share of letters and blanks, times the share of lines that aren't repeats."""
    if not text:
        return 0.01
    lines = [line for line in text.split("\n") if line.strip()]
    readable = sum(c.isalpha() or c == " " for c in text) / len(text)
    return max(0.01, readable * (len(set(lines)) / len(lines) if lines else 0.01))


def _size(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = encoding(path)
    for batch in batches:
        ids, sources, texts = (c.to_pylist() for c in batch.columns)
        texts = [t or "" for t in texts]
        # copies may differ in letter case and blanks
        folded = [" ".join(t.lower().split()).encode("utf-8", "replace") for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(sources, pa.string()),
                pa.array([len(bpe.encode_ordinary(t)) for t in texts], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(f) - 2**63 for f in folded], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(f, seed=1) - 2**63 for f in folded], pa.int64()),
                pa.array([quality(t) for t in texts], pa.float64()),
            ],
            schema=_SIZED,
        )


def sized(documents: DataFrame, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``doc_id, source, n_tokens, copy1, copy2, quality``: whole texts; (copy1, copy2) is equal for copies."""
    raw = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return raw.mapInArrow(partial(_size, path=tokenizer), "doc_id bigint, source string, n_tokens bigint, copy1 bigint, copy2 bigint, quality double")
