"""CRC32C (Castagnoli), which Spark has no function for: a table-driven kernel in numpy over all rows of a batch at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_TABLE = _table()


def _matrix_power(n: int) -> np.ndarray:
    """Columns of the linear map by which n zero bytes change a checksum."""
    one = _TABLE[(1 << np.arange(32, dtype=np.uint64) & 0xFF).astype(np.uint8)] ^ ((np.uint64(1) << np.arange(32, dtype=np.uint64)) >> np.uint64(8)).astype(np.uint32)
    result, power = np.uint32(1) << np.arange(32, dtype=np.uint32), one
    while n:
        if n & 1:
            result = _apply(power, result)
        power = _apply(power, power)
        n >>= 1
    return result


def _apply(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


#: Bytes of a piece of a row; pieces that go through the table side by side.
_PIECE, _BLOCK = 256, 16384


@functools.cache
def _power(k: int) -> np.ndarray:
    """Tables, one for each byte of a checksum, of how 2**k zero bytes change it."""
    columns = _matrix_power(1 << k)
    return np.stack([_apply(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums after n zero bytes, each with its own n."""
    crc = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.nonzero(n >> k & 1)[0]
        x, t = crc[at], _power(k)
        crc[at] = t[0][x & 0xFF] ^ t[1][x >> 8 & 0xFF] ^ t[2][x >> 16 & 0xFF] ^ t[3][x >> 24]
    return crc


def crc32c_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: int = 0) -> np.ndarray:
    """Of each stretch of raw, where it lies; before is the checksum of what stands before each. Rows are cut from their ends
    into pieces, so that rows of all lengths go side by side; zeros before a row's first bytes change nothing."""
    size = ends - starts
    pieces = -(-size // _PIECE)
    upto = np.cumsum(pieces)
    out = _moved(np.full(len(size), before ^ 0xFFFFFFFF, np.uint32), size)
    for low in range(0, int(upto[-1]) if len(upto) else 0, _BLOCK):
        piece = np.arange(low, min(low + _BLOCK, int(upto[-1])))
        row = np.searchsorted(upto, piece, "right")
        behind = (upto[row] - 1 - piece) * _PIECE
        begin, at = starts[row], ends[row] - behind - _PIECE
        crc = np.zeros(len(piece), np.uint32)
        for i in range(_PIECE):
            byte = np.where(at + i >= begin, raw[np.maximum(at + i, begin)], 0)
            crc = _TABLE[(crc ^ byte) & 0xFF] ^ (crc >> np.uint32(8))
        np.bitwise_xor.at(out, row, _moved(crc, behind))
    return out ^ np.uint32(0xFFFFFFFF)


def spans(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary array as they lie in memory, and where each row begins and ends there; a null has none."""
    if not len(values) or values.null_count == len(values):
        return np.zeros(0, np.uint8), np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    _, at, data = values.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset :][: len(values) + 1].astype(np.int64)
    none = values.is_null().to_numpy(zero_copy_only=False)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.where(none, at[:-1], at[1:])


def crc32c_array(values: pa.Array) -> pa.Array:
    """Of a binary array, without copies of its bytes; null for null."""
    return pa.array(crc32c_spans(*spans(values)).astype(np.int64), pa.int64(), mask=values.is_null().to_numpy(zero_copy_only=False))


def crc32c(data: bytes, start: int = 0) -> int:
    """Of one value; start is the checksum of what stands before it."""
    raw = np.frombuffer(data, np.uint8) if len(data) else np.zeros(0, np.uint8)
    return int(crc32c_spans(raw, np.array([0]), np.array([len(raw)]), start)[0])


def crc32c_rows(values: list[bytes | None]) -> list[int | None]:
    """Of many values."""
    return crc32c_array(pa.array(values, pa.large_binary())).to_pylist()


@F.arrow_udf(LongType())
def crc32c_of(content: pa.Array) -> pa.Array:
    """The CRC32C of binary values; null for null."""
    return crc32c_array(content)
