"""Per-row model inference with one model per worker.

The embedder is a deterministic stand-in (hashed word counts, signed, scaled to
length 1): the shape and cost of the real call, without its weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_embedder(dimensions: int):
    import hashlib

    import numpy as np

    def embed(text: str | None) -> list[float]:
        v = np.zeros(dimensions, np.float32)
        for word in (text or "").encode().split():
            h = int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:8], 16)
            v[h // 2 % dimensions] += 1 if h % 2 else -1
        return (v / max(float(np.linalg.norm(v)), 1e-9)).tolist()

    return embed


def embed(df: DataFrame, text: str, name: str = "embedding", dimensions: int = 384) -> DataFrame:
    """Add an array<float> column; the model loads once per task, not per row."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_embedder(dimensions)
        for s in batches:
            yield s.map(model)

    return df.withColumn(name, run(F.col(text)))
