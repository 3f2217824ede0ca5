"""Sealed payloads: ChaCha20-Poly1305 (RFC 8439) in numpy, keys from passphrases, and zstd frames, as Arrow functions."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ZSTD_MAGIC = "28B52FFD"
_SIGMA = np.frombuffer(b"expand 32-byte k", "<u4")
_ROUNDS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def derived_key(passphrase: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """32 bytes by PBKDF2 with HMAC-SHA256."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def chacha_stream(key: bytes, nonce: bytes, blocks: int, counter: int = 0) -> np.ndarray:
    """Key stream bytes of all blocks at once."""
    state = np.empty((16, blocks), np.uint32)
    state[:4] = _SIGMA[:, None]
    state[4:12] = np.frombuffer(key, "<u4")[:, None]
    state[12] = np.arange(counter, counter + blocks, dtype=np.uint32)
    state[13:] = np.frombuffer(nonce, "<u4")[:, None]
    x = state.copy()
    for _ in range(10):
        for a, b, c, d in _ROUNDS:
            x[a] += x[b]
            x[d] = _turn(x[d] ^ x[a], 16)
            x[c] += x[d]
            x[b] = _turn(x[b] ^ x[c], 12)
            x[a] += x[b]
            x[d] = _turn(x[d] ^ x[a], 8)
            x[c] += x[d]
            x[b] = _turn(x[b] ^ x[c], 7)
    return np.ascontiguousarray((x + state).T).view(np.uint8).ravel()


def poly1305(key: bytes, message: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total, p = 0, (1 << 130) - 5
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\x01", "little")) * r % p
    return ((total + int.from_bytes(key[16:32], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(key: bytes, nonce: bytes, text: bytes, extra: bytes) -> bytes:
    pad = lambda b: b + bytes(-len(b) % 16)
    return poly1305(chacha_stream(key, nonce, 1)[:32].tobytes(), pad(extra) + pad(text) + len(extra).to_bytes(8, "little") + len(text).to_bytes(8, "little"))


def _xor(key: bytes, nonce: bytes, data: bytes) -> bytes:
    stream = chacha_stream(key, nonce, -(-len(data) // 64), 1)[: len(data)] if data else np.zeros(0, np.uint8)
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def seal(key: bytes, data: bytes, nonce: bytes | None = None, extra: bytes = b"") -> bytes:
    """nonce, cipher text, tag. The nonce follows from key and data unless it is given, so that a task that runs again
    gives the same payload."""
    nonce = nonce or hmac.new(key, data, hashlib.sha256).digest()[:12]
    text = _xor(key, nonce, data)
    return nonce + text + _tag(key, nonce, text, extra)


def unseal(key: bytes, payload: bytes, extra: bytes = b"") -> bytes | None:
    """The data, or None where the payload is short or the tag is another's."""
    if len(payload) < 28:
        return None
    nonce, text, tag = payload[:12], payload[12:-16], payload[-16:]
    return _xor(key, nonce, text) if hmac.compare_digest(tag, _tag(key, nonce, text, extra)) else None


def _each(column: Column, run) -> Column:
    @F.arrow_udf("binary")
    def each(a: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else run(x.as_py()) for x in a], pa.binary())

    return each(column.cast("binary"))


def sealed(column: Column, key: bytes) -> Column:
    return _each(column, lambda b: seal(key, b))


def unsealed(column: Column, key: bytes) -> Column:
    """Null where it can't be opened."""
    return _each(column, lambda b: unseal(key, b))


def compressed(column: Column, level: int = 3) -> Column:
    """zstd frames."""

    def run(b: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(b)

    return _each(column, run)


def decompressed(column: Column) -> Column:
    """What a zstd frame holds; null where it is broken or cut off."""

    def run(b: bytes) -> bytes | None:
        import zstandard

        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            data = frame.decompress(b)
        except zstandard.ZstdError:
            return None
        return data if frame.eof else None

    return _each(column, run)


def is_compressed(payload: Column) -> Column:
    return F.hex(F.substring(payload, 1, 4)) == ZSTD_MAGIC
