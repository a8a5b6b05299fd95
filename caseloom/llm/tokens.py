"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import spread, written

TOKENIZER_FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's makers part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    key = hashlib.blake2b(vocabulary + pattern.encode()).hexdigest()
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def text_key(text: str) -> str:
    """The same for copies that differ in letter case and blanks only."""
    return hashlib.blake2b("".join(text.lower().split()).encode("utf-8", "replace"), digest_size=16).hexdigest()


def token_sizes(documents: DataFrame, tokenizer_path: str | None = None, pattern: str = PATTERN, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, source, cluster, tokens)`` per row with a text that has tokens.

    ``source`` is trimmed and in lower case, blank if null; ``cluster`` is the
    same for copies. Null and empty texts give no row; repeated rows stay;
    texts are measured whole. The vocabulary file at ``tokenizer_path`` is
    read once and sent to the executors (its size is that of the file, about
    a megabyte).
    """
    with open(tokenizer_path or os.path.join(TOKENIZER_FOLDER, TOKENIZER), "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(vocabulary.value, pattern)
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].tolist(), "source": batch["source"].tolist(), "cluster": [text_key(t) for t in texts],
                "tokens": [len(encoding.encode_ordinary(t)) for t in texts],
            })

    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"), F.col(text).alias("text")
    )
    sizes = spread(rows).mapInPandas(run, "doc_id string, source string, cluster string, tokens bigint")  # ids as text: nulls beside them would make floats of numbers
    return written(sizes.withColumn("doc_id", F.col("doc_id").cast("bigint")), "token-sizes")
