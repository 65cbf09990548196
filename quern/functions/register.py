"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.chunking import chunk_file
from quern.functions.text import SCREENED, content_hash, neutralized, normalized, screen


def register(spark: SparkSession) -> list[str]:
    """Register ``normalize_content``, ``content_hash``, ``neutralize``, ``screen``, ``cosine`` and the table function ``chunk``; their names."""

    @F.pandas_udf(T.StringType())
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(content_hash, na_action="ignore")

    @F.pandas_udf(SCREENED)
    def screening(texts: pd.Series, trusts: pd.Series) -> pd.DataFrame:
        rows = [screen(t, int(u)) if t is not None else None for t, u in zip(texts, trusts.fillna(0))]
        names = ("action", "content", "trust", "redactions", "markers")
        return pd.DataFrame([vars(r) if r else dict.fromkeys(names) for r in rows], columns=list(names))

    @F.udtf(returnType="chunk_index int, chunk string")
    class Chunk:
        def eval(self, name: str, text: str):
            yield from enumerate(chunk_file(name, text or ""))

    spark.udf.register("normalize_content", normalized)
    spark.udf.register("content_hash", hashed)
    spark.udf.register("neutralize", neutralized)
    spark.udf.register("screen", screening)
    spark.udtf.register("chunk", Chunk)
    # Built-in expressions alone.
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)"
    )
    return ["normalize_content", "content_hash", "neutralize", "screen", "cosine", "chunk"]
