"""Compact forms of vectors: sign bits, half precision, residuals and product codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a packed word.
WORD = 64


def pack_signs(v: Column) -> Column:
    """Words of 64 sign bits; bit i of a word is component i of its 64, 1 if it is at least 0."""
    words = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / WORD).cast("int"), F.lit(0)))

    def word(w: Column) -> Column:
        part = F.slice(v, w * WORD + 1, WORD)
        bits = F.transform(part, lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.lit(1).cast("long"))
        return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda total, bit: F.shiftleft(total, 1).bitwiseOR(bit))

    return F.transform(words, word)


def unpack_signs(words: Column, dim: int) -> Column:
    """Components 1 and 0 of packed signs."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.getbit(words[F.floor(i / WORD).cast("int")], i % WORD).cast("int"))


def _offsets(v: pa.Array) -> np.ndarray:
    """Where each list starts and the last one stops; a null list is as long as its slot."""
    return v.offsets.to_numpy().astype(np.int64)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def through_half(v: pa.Array) -> pa.Array:
    """Components as they are after storage in half precision."""
    flat = v.values.cast(pa.float32())
    half = flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    return pa.ListArray.from_arrays(v.offsets, pa.array(half, mask=np.asarray(flat.is_null())), mask=v.is_null())


@F.arrow_udf(T.BinaryType())
def encode_half(v: pa.Array) -> pa.Array:
    """Two bytes per component, little-endian."""
    data = v.values.cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f2").tobytes()
    return _binary(data, 2 * _offsets(v), v)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def decode_half(b: pa.Array) -> pa.Array:
    b = b.cast(pa.large_binary())
    offsets = np.frombuffer(b.buffers()[1], np.int64)[b.offset : b.offset + len(b) + 1]
    values = np.frombuffer(b.buffers()[2] or b"", "<f2", (offsets[-1] - offsets[0]) // 2, offsets[0]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(((offsets - offsets[0]) // 2).astype(np.int32)), pa.array(values), mask=b.is_null())


def _binary(data: bytes, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """Slices of one buffer as a binary column, null where ``like`` is."""
    bits = np.packbits(~np.asarray(like.is_null()), bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(like), [pa.py_buffer(bits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(v.cast("array<double>"), centroid.cast("array<double>"), lambda x, y: x - y)


def subvector(v: Column, number: Column | int, size: int) -> Column:
    """Part ``number`` (from 0) of a vector cut into parts of equal size."""
    return F.slice(v, (F.lit(number) if isinstance(number, int) else number) * size + 1, size)
