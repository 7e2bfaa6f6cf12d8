"""Text vectors. The default embedder is a deterministic signed hash of words; a model's callable may replace it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 48


def hashed(texts: list[str], dim: int = 384) -> np.ndarray:
    """Unit vectors; a text without words is the zero vector."""
    import hashlib
    import re

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embedder(embed: Callable[[list[str]], np.ndarray] = hashed) -> Callable[[Column], Column]:
    """A vectorised function of a text column, calling `embed` with BATCH texts at most and checking its answer's length."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            vectors: list = []
            for k in range(0, len(s), BATCH):
                texts = s.iloc[k : k + BATCH].fillna("").tolist()
                got = embed(texts)
                if len(got) != len(texts):
                    raise ValueError("the embedder returned another number of vectors than texts")
                vectors += [np.asarray(v, np.float32).tolist() for v in got]
            yield pd.Series(vectors, index=s.index)

    return run
