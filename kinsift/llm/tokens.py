"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


def default_vocabulary() -> str:
    """Path of the vocabulary used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, vocabulary: str | None = None) -> int:
    return len(_encoding(vocabulary or default_vocabulary()).encode_ordinary(text)) if text else 0


def with_token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document. Texts are read once, whole;
    NULL and empty texts have no tokens. ``vocabulary`` is the path of a ranks
    file that every executor can read."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            ids, source, text = batch.columns
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, source, pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")
