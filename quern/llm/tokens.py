"""Token counts under a public tokenizer.

The vocabulary file is a parameter: ``spark.quern.tokenizer`` names a folder or a .tiktoken
file, by default the folder of the installed public vocabularies. It is read on each executor.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# Texts are encoded in blocks of this many characters, cut before a space, so that one long text
# needs no long buffer. The pattern never joins characters across such a cut.
BLOCK = 100_000


def vocabulary(spark) -> str:
    """Path of the vocabulary file this session uses."""
    p = spark.conf.get("spark.quern.tokenizer", DEFAULT_FOLDER)
    return os.path.join(p, DEFAULT_FILE) if not p.endswith(".tiktoken") else p


def load(path: str):
    """Encoder of a .tiktoken file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(enc, text: str | None) -> int:
    """Tokens of a text; null and empty have 0."""
    return len(enc.encode_ordinary(text)) if text else 0


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the token count of a column as ``out`` (bigint; 0 for null or empty text)."""
    path = vocabulary(df.sparkSession)

    @pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(path)
        for s in batches:
            yield pd.Series([count(enc, t) for t in s], dtype="int64")

    return df.withColumn(out, n_tokens(F.col(text)))
