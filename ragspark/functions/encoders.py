"""Text encoders: a hook for any model, and a model-free default.

An encoder is made once per task by a factory and maps a batch of token lists or texts to a
float matrix. The default is signed feature hashing (Weinberger et al. 2009).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import tokens

# Fixed value: dimensions of the reference's embeddings.
DIMS = 384

# texts of a batch (Arrow string array) -> float32 matrix, one row each
TextEncoder = Callable[[pa.Array], np.ndarray]


def hash_terms(terms: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each term: both from the first 8 hex digits of its md5."""
    heads = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in terms], dtype=np.int64)
    return heads % dims, np.where((heads // dims) % 2 == 0, 1.0, -1.0)


def hashed_rows(token_lists: pa.ListArray, dims: int) -> np.ndarray:
    """Signed term counts per bucket, scaled to unit length; a row without tokens stays zero."""
    lengths = np.diff(token_lists.offsets.to_numpy())
    terms = token_lists.flatten().dictionary_encode()
    out = np.zeros((len(token_lists), dims))
    if len(terms):
        bucket, sign = hash_terms(terms.dictionary.to_pylist(), dims)
        code = terms.indices.to_numpy()
        row = np.repeat(np.arange(len(token_lists)), lengths)
        flat = np.bincount(row * dims + bucket[code], weights=sign[code], minlength=out.size)
        out = flat.reshape(out.shape)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def float_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, dims = matrix.shape
    offsets = np.arange(0, (rows + 1) * dims, dims, dtype=np.int32) if dims else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def packed_rows(matrix: np.ndarray) -> pa.Array:
    """Rows as bytes, four a number, the low one first."""
    offsets = (np.arange(len(matrix) + 1) * 4 * matrix.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.astype("<f4").tobytes())])


def embed(rows: DataFrame, id_column: str, text_column: str,
          encoder: Callable[[], TextEncoder] | None = None, dims: int = DIMS,
          partitions: int | None = None, packed: bool = False) -> DataFrame:
    """(id, embedding): one vector per row, without a shuffle unless ``partitions`` asks for one.

    A corpus comes in enough files to keep all cores busy; set ``partitions`` for inputs that
    are small next to the cost of the model.

    ``encoder`` is called once in each task and returns the batch function; ``None`` takes the
    hashed default, for which the tokens are cut on the JVM side. ``packed`` gives a vector as the bytes of its
    numbers, which a table takes and returns whole instead of number by number.
    """
    hashed = encoder is None
    source = tokens(F.col(text_column)) if hashed else F.col(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (lambda lists: hashed_rows(lists, dims)) if hashed else encoder()
        for batch in batches:
            vectors = np.ascontiguousarray(encode(batch.column(1)), dtype=np.float32)
            made = packed_rows(vectors) if packed else float_lists(vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["id", "embedding"])

    if partitions is not None:
        rows = rows.select(id_column, text_column).repartition(partitions, id_column)
    picked = rows.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), source.alias("source"))
    id_type = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {id_type}, embedding {'binary' if packed else 'array<float>'}")
