"""Coherence of texts by embeddings of their sentences, with an encoder that each worker loads once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
SHAPE = "score double, similarity double, sentences int, coherent boolean"
#: Windows of texts of many sentences: over so many sentences, at most so many before.
WINDOWS = [(20, 3), (10, 5)]
#: Below this threshold similarities count more leniently: 0.3 to 0.6 are 50 to 100 per cent.
LENIENT, LOW, HIGH = 0.6, 0.3, 0.6


def hash_encoder(size: int = 64) -> Encoder:
    """The encoder of hash_embedding: bytes of the SHA-256 of a sentence, the first value its length. No model, no meaning."""

    def encode(sentences: list[str]) -> np.ndarray:
        digests = np.frombuffer(b"".join(hashlib.sha256(s.encode()).digest() for s in sentences), np.uint8).reshape(-1, 32)
        out = (digests[:, np.arange(size) % 32].astype(float) - 128) / 128
        out[:, 0] = [min(len(s) / 1000, 1.0) for s in sentences]
        return out

    return encode


def similarity_to_before(vectors: np.ndarray, window: int) -> float:
    """The mean, over sentences but the first, of their mean cosine with up to `window` sentences before; 1 for one sentence."""
    n = len(vectors)
    if n < 2:
        return 1.0
    window = next((min(window, most) for over, most in WINDOWS if n > over), window)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length > 0, length, 1)
    sums, counts = np.zeros(n), np.minimum(np.arange(n), window)
    for back in range(1, min(window, n - 1) + 1):
        sums[back:] += (unit[back:] * unit[:-back]).sum(1)
    return float((sums[1:] / counts[1:]).mean())


def score_of(similarity: float, threshold: float, single: bool) -> float:
    if single:
        return 1.0
    if threshold >= LENIENT:
        return min(100.0, max(0.0, 100 * similarity))
    if similarity < LOW:
        return similarity / LOW * 50
    return 50 + (similarity - LOW) / (HIGH - LOW) * 50 if similarity <= HIGH else min(100.0, 100 * similarity)


def coherence_by_embeddings(sentences: Column, threshold: Column, load: Callable[[], Encoder] = hash_encoder, window: int = 5) -> Column:
    """struct<score, similarity, sentences, coherent> of each array of sentences.

    load returns the encoder and is called once in a worker's life of the expression, not for each batch; a batch's
    sentences are encoded together. A text without sentences, or null, scores as one of a single sentence: 1.
    """

    @F.pandas_udf(SHAPE)
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = load()
        for texts, limits in batches:
            lists = [[] if t is None else [s or "" for s in t] for t in texts]
            every = [s for t in lists for s in t]
            vectors = encode(every) if every else np.zeros((0, 1))
            ends = np.cumsum([len(t) for t in lists])
            rows = []
            for t, end, limit in zip(lists, ends, limits, strict=True):
                mean = similarity_to_before(vectors[end - len(t) : end], window)
                rows.append((round(score_of(mean, limit, len(t) < 2), 2), round(mean, 4), len(t), mean >= limit))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SHAPE.split(", ")])

    return scored(sentences, threshold.cast("double"))
