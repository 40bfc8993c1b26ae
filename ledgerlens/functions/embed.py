"""Text embedders (X1 interface, X3 default).

``hashing_embed`` is the deterministic offline default: lower-case, split on
anything outside [a-z0-9], bucket each token by the first 32 bits of its MD5
modulo ``dim``, count, L2-normalise. It is one ``mapInArrow`` pass per Arrow
batch (no shuffle): per-element lambdas of ``transform`` are interpreted, not
compiled, so hashing every token there cost more than the Python pass with a
token cache.

``model_embed`` plugs in any batch model through ``predict_batch_udf`` (the
model is loaded once per Python worker).

Index, retrieval, question answering and the stream take an ``embed`` argument: any
``(df, text_col, out_col) -> df`` such as ``hashing_embed`` or
``partial(model_embed, make_predict=...)``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 256


_SEP = re.compile(r"[^a-z0-9]+")
#: Tokens that a task's cache holds; then it starts anew.
CACHE_TOKENS = 200_000


def _bucket(tok: str, dim: int) -> int:
    return int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim


def _unit_rows(texts: list, dim: int, cache: dict[str, int]) -> np.ndarray:
    """Bucket counts of each text at unit length (zeros for token-less text)."""
    n = len(texts)
    flat: list[int] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        base = i * dim
        for tok in _SEP.split(t.lower()):
            if tok:
                k = cache.get(tok)
                if k is None:
                    k = cache[tok] = _bucket(tok, dim)
                flat.append(base + k)
    mat = np.bincount(np.asarray(flat, dtype=np.int64),
                      minlength=n * dim).astype(np.float64).reshape(n, dim)
    norms = np.sqrt((mat * mat).sum(axis=1))
    nz = norms > 0
    mat[nz] /= norms[nz, None]
    return mat


def _embed_batches(dim: int, text_col: str, out_col: str, keep: list[str]):
    """Tokenise, bucket, count and L2-normalise one Arrow batch at a time.
    Token → bucket is cached per task (word frequencies are skewed, so most
    tokens are looked up, not hashed)."""
    def run(batches):
        cache: dict[str, int] = {}
        for b in batches:
            mat = _unit_rows(b.column(text_col).to_pylist(), dim, cache)
            n = len(mat)
            offs = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            vec = pa.ListArray.from_arrays(offs, pa.array(mat.ravel()))
            cols = [b.column(c) for c in keep] + [vec]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [out_col])
    return run


def hashing_embed(df: DataFrame, text_col: str, out_col: str = "embedding",
                  dim: int = DEFAULT_DIM) -> DataFrame:
    """Adds ``out_col`` array<double> (unit length, zeros for token-less text).
    A narrow map: no shuffle, one Arrow round trip."""
    keep = [c for c in df.columns]
    schema = T.StructType([f for f in df.schema.fields] +
                          [T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    from ..session import spread
    return spread(df).mapInArrow(_embed_batches(dim, text_col, out_col, keep), schema)


def hashing_terms(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``df`` without the text, with its vector as ``terms array<int>`` (buckets in
    order) and ``weights array<double>``: the non-zero part of ``hashing_embed``."""
    from ..session import spread
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in keep] +
                          [T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def run(batches):
        cache: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                mat = _unit_rows(b.column(text_col).to_pylist(), dim, cache)
                rows, terms = np.nonzero(mat)
                cuts = pa.array(np.searchsorted(rows, np.arange(len(mat) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keep],
                     pa.ListArray.from_arrays(cuts, pa.array(terms.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(mat[rows, terms]))],
                    names=[*keep, "terms", "weights"])

    return spread(df).mapInArrow(run, schema)


def is_sparse(embed: Callable) -> bool:
    """Whether ``hashing_terms`` gives the vectors of ``embed`` in sparse form."""
    return embed is hashing_embed


def model_embed(df: DataFrame, text_col: str, out_col: str = "embedding", *,
                make_predict: Callable, batch_size: int = 256) -> DataFrame:
    """Any model behind ``make_predict() -> (np.ndarray[str]) -> np.ndarray``.
    Vectors are L2-normalised so the inner product is the cosine."""
    from pyspark.ml.functions import predict_batch_udf

    def loader():
        predict = make_predict()

        def run(texts: np.ndarray) -> np.ndarray:
            v = np.asarray(predict(texts), dtype=np.float64)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        return run

    udf = predict_batch_udf(loader, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.withColumn(out_col, udf(F.coalesce(F.col(text_col), F.lit(""))))
