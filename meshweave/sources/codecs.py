"""Byte codecs of mesh files: ascii, base64 and raw encodings, block compression, byte order."""

from __future__ import annotations

import base64
import lzma
import sys
import warnings
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..errors import SizeProblem, ValueProblem

#: Names of the file format's number types and of its compressors.
NUMBER_TYPES = {
    "Float32": "f4", "Float64": "f8", "Int8": "i1", "Int16": "i2", "Int32": "i4", "Int64": "i8",
    "UInt8": "u1", "UInt16": "u2", "UInt32": "u4", "UInt64": "u8", "String": "i1",
}
COMPRESSORS = {"zlib": "vtkZLibDataCompressor", "lzma": "vtkLZMADataCompressor", "lz4": "vtkLZ4DataCompressor"}
#: Bytes of a block before compression.
BLOCK_BYTES = 32768
NATIVE = "LittleEndian" if sys.byteorder == "little" else "BigEndian"
#: Values in a line of ascii.
PER_LINE = 15
#: Lines that are formatted at once.
_LINES = 1000

_lz4 = pa.Codec("lz4_raw")
_compress: dict[str, Callable[[bytes], bytes]] = {
    "zlib": zlib.compress,
    "lzma": lambda b: lzma.compress(b, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC32),
    "lz4": lambda b: _lz4.compress(b, asbytes=True),
}
_decompress: dict[str, Callable[[bytes, int], bytes]] = {
    "zlib": lambda b, _: zlib.decompress(b),
    "lzma": lambda b, _: lzma.decompress(b),
    "lz4": lambda b, n: _lz4.decompress(b, n, asbytes=True),
}


def dtype_of(name: str, byte_order: str = NATIVE) -> np.dtype:
    """numpy's type of a file's number type."""
    if name not in NUMBER_TYPES:
        raise ValueProblem(f"unknown number type {name!r}")
    return np.dtype(NUMBER_TYPES[name]).newbyteorder("<" if byte_order == "LittleEndian" else ">")


def type_name(dtype: np.dtype) -> str:
    """The file's name of a numpy type; booleans are stored as bytes."""
    dtype = np.dtype("u1") if dtype == bool else dtype
    for name, code in NUMBER_TYPES.items():
        if np.dtype(code) == dtype.newbyteorder("="):
            return name
    raise ValueProblem(f"no number type for {dtype}")


def check_combination(encoder: str, data_format: str, compressor: str | None) -> None:
    """Raw goes with appended, ascii with inlined and without compression, base64 with both."""
    if encoder not in ("ascii", "base64", "raw") or data_format not in ("inlined", "appended"):
        raise ValueProblem(f"no such encoder or data format: {encoder}, {data_format}")
    if (encoder, data_format) in (("raw", "inlined"), ("ascii", "appended")):
        raise ValueProblem(f"{encoder} can't be {data_format}")
    if compressor is not None and compressor not in COMPRESSORS:
        raise ValueProblem(f"no such compressor: {compressor}")


def encode_ascii(values: np.ndarray) -> str:
    """Values in lines, floats with as many digits as surely survive (6 or 15)."""
    flat = values.ravel()
    flat = flat.astype("u1") if flat.dtype == bool else flat
    one = ("%.6g" if flat.dtype.itemsize == 4 else "%.15g") if flat.dtype.kind == "f" else "%d"
    line = " ".join([one] * PER_LINE) + "\n"
    out = []
    for at in range(0, len(flat), _LINES * PER_LINE):
        some = flat[at : at + _LINES * PER_LINE].tolist()
        full, rest = divmod(len(some), PER_LINE)
        out.append((line * full + " ".join([one] * rest)) % tuple(some))
    return "".join(out).rstrip("\n")


def decode_ascii(text: str, dtype: np.dtype, count: int | None = None) -> np.ndarray:
    """Numbers of a text; too few are an error, further ones are left alone."""
    wide = np.dtype("f8") if dtype.kind == "f" else np.dtype("u8") if dtype == np.dtype("u8") else np.dtype("i8")
    with warnings.catch_warnings():
        warnings.simplefilter("error", DeprecationWarning)  # what isn't a number ends reading with this warning
        try:
            values = np.fromstring(text, wide, sep=" ")
        except DeprecationWarning as e:
            raise ValueProblem(f"not only numbers: {text.strip()[:40]!r}") from e
    if count is not None and len(values) < count:
        raise SizeProblem(f"{len(values)} values where {count} are expected")
    values = values[:count]
    if dtype.kind != "f" and len(values) and (values.min() < np.iinfo(dtype).min or values.max() > np.iinfo(dtype).max):
        raise ValueProblem(f"values don't fit {dtype}")
    return values.astype(dtype)


def compress_blocks(raw: bytes, compressor: str, header: np.dtype, block: int = BLOCK_BYTES) -> tuple[bytes, bytes]:
    """Header (blocks, block size, size of the last if not full, compressed sizes) and compressed blocks."""
    parts = [_compress[compressor](raw[i : i + block]) for i in range(0, len(raw), block)]
    residual = len(raw) % block
    head = np.array([len(parts), block if parts else 0, residual, *map(len, parts)], header)
    return head.tobytes(), b"".join(parts)


def decompress_blocks(sizes: np.ndarray, body: bytes, compressor: str) -> bytes:
    """The bytes of compressed blocks; no blocks are no bytes."""
    n, block, residual = (int(x) for x in sizes[:3])
    out, at = [], 0
    for i, size in enumerate(int(x) for x in sizes[3 : 3 + n]):
        full = residual if residual and i == n - 1 else block
        out.append(_decompress[compressor](body[at : at + size], full))
        at += size
    return b"".join(out)


def encode_binary(values: np.ndarray, encoder: str, compressor: str | None, header: np.dtype, block: int = BLOCK_BYTES) -> bytes:
    """Header and data of an array, raw or in base64 (each padded by itself)."""
    raw = np.ascontiguousarray(values.astype("u1") if values.dtype == bool else values).tobytes()
    head, body = compress_blocks(raw, compressor, header, block) if compressor else (np.array([len(raw)], header).tobytes(), raw)
    return head + body if encoder == "raw" else base64.b64encode(head) + base64.b64encode(body)


def decode_raw(data: bytes | memoryview, compressor: str | None, header: np.dtype) -> bytes:
    """The bytes of a raw array that begins at the start of data."""
    size = header.itemsize
    if not compressor:
        n = int(np.frombuffer(data[:size], header)[0])
        return bytes(data[size : size + n])
    n = int(np.frombuffer(data[:size], header)[0])
    sizes = np.frombuffer(data[: size * (3 + n)], header)
    return decompress_blocks(sizes, bytes(data[size * (3 + n) :][: int(sizes[3:].sum())]), compressor)


def decode_base64(text: bytes, compressor: str | None, header: np.dtype) -> bytes:
    """The bytes of an array in base64, whose header is padded by itself or encoded together with the data."""
    size = header.itemsize
    chars = lambda n: -(-n // 3) * 4
    n = int(np.frombuffer(base64.b64decode(text[: chars(size)])[:size], header)[0])
    head_bytes = size * (3 + n) if compressor else size
    head_chars = chars(head_bytes)
    head = base64.b64decode(text[:head_chars])
    apart = head_bytes % 3 == 0 or text[head_chars - 1 : head_chars] == b"="
    if not compressor:
        if apart:
            return base64.b64decode(text[head_chars : head_chars + chars(n)])[:n]
        return base64.b64decode(text[: chars(size + n)])[size : size + n]
    sizes = np.frombuffer(head[:head_bytes], header)
    total = int(sizes[3:].sum())
    body = base64.b64decode(text[head_chars : head_chars + chars(total)])[:total] if apart else base64.b64decode(text[: chars(head_bytes + total)])[head_bytes:]
    return decompress_blocks(sizes, body, compressor)
