"""Vectors of texts. Any function from a list of texts to a matrix of one row each can take the place of the one here."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedding = Callable[[Sequence[str]], np.ndarray]


def trigram_embed(texts: Sequence[str], dim: int = 384) -> np.ndarray:
    """Counts of hashed character trigrams of the lower-cased texts, L2-normalised; texts under three characters give zeros."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        counts = trigram_slots((text or "").lower(), dim)
        if counts is not None:
            out[i] = counts / np.linalg.norm(counts)
    return out


def trigram_slots(text: str, dim: int) -> np.ndarray | None:
    """Counts of the text's hashed character trigrams by slot; none under three characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return None
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(33)) % np.uint64(dim), minlength=dim)


def embedded(text: Column, embed: Embedding = trigram_embed) -> Column:
    """array<double> of each text by ``embed``, called once per Arrow batch; a null text has a null vector."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        made = iter(np.asarray(embed(texts[known].tolist()), float) if known.any() else ())
        return pd.Series([next(made) if k else None for k in known], dtype=object)

    return vectors(text)
