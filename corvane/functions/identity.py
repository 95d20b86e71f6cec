"""Ed25519 signatures (RFC 8032) in plain Python; on data only inside Arrow batches."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = n - m, d - c, d + c, n + m
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, point: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, point)
        point = _add(point, point)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if square == 0:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


def _decode(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _encode(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_BASE_Y = 4 * pow(5, P - 2, P) % P
BASE: Point = (_x(_BASE_Y, 0) or 0, _BASE_Y, 1, (_x(_BASE_Y, 0) or 0) * _BASE_Y % P)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expand(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


@lru_cache(maxsize=1024)
def public_key(secret: bytes) -> bytes:
    return _encode(_times(_expand(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    key, r = public_key(secret), _digest(prefix, message) % ORDER
    point = _encode(_times(r, BASE))
    return point + ((r + _digest(point, key, message) % ORDER * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Strict: false for a bad length, a point off the curve or of small order, or a scalar that isn't reduced."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _decode(key), _decode(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER or any(_same(_times(8, p), (0, 1, 1, 0)) for p in (a, r)):
        return False
    k = _digest(signature[:32], key, message) % ORDER
    return _same(_times(s, BASE), _add(r, _times(k, a)))


def verified(key: Column, message: Column, signature: Column) -> Column:
    """boolean: whether each signature holds; false for null."""

    @F.arrow_udf("boolean")
    def check(keys: pa.Array, messages: pa.Array, signatures: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), messages.to_pylist(), signatures.to_pylist(), strict=True)
        return pa.array([None not in r and verify(*r) for r in rows], pa.bool_())

    return check(key, message, signature)
