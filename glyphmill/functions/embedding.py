"""Text embeddings: a provider slot, and an offline provider that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.scratch import ship_package
from glyphmill.worker import kept, key_of


#: Texts that are strings of Python at a time; the others of a batch stay in Arrow.
_AT_A_TIME = 256


def _vectors(rows) -> pa.Array:
    return pa.array([np.asarray(v, dtype=np.float64) for v in rows], pa.list_(pa.float64()))


class Embedder:
    """Texts to vectors. ``load`` runs once per task process and returns ``list[str] -> 2-d array``."""

    def load(self):
        raise NotImplementedError

    def as_column(self, text: Column) -> Column:
        ship_package()
        embedder, key = self, key_of(self)

        @F.arrow_udf("array<double>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = kept(key, embedder.load)
            for texts in batches:
                done = [_vectors([])]
                for at in range(0, len(texts), _AT_A_TIME):
                    done.append(_vectors(encode([t or "" for t in texts.slice(at, _AT_A_TIME).to_pylist()])))
                yield pa.concat_arrays(done)

        return embed(text)


class TrigramEmbedder(Embedder):
    """Counts of character trigrams, hashed into ``dim`` buckets, scaled to length one.

    The bucket of a trigram with code points a, b, c is ``(961 a + 31 b + c) mod dim``.
    A text shorter than three characters has the zero vector.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self):
        dim = self.dim

        def one(text: str) -> np.ndarray:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
            if len(points) < 3:
                return np.zeros(dim)
            grams = (961 * points[:-2] + 31 * points[1:-1] + points[2:]) % dim
            counts = np.bincount(grams, minlength=dim).astype(np.float64)
            return counts / np.sqrt((counts * counts).sum())

        return lambda texts: [one(t) for t in texts]


class SentenceModelEmbedder(Embedder):
    """A named sentence-transformer model, where that package is installed on the workers."""

    def __init__(self, name: str):
        self.name = name

    def load(self):
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(self.name).encode
