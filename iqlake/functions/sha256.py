"""SHA-256 whose state can be kept and taken up again elsewhere, which hashlib's can't."""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import cache

#: The first 32 bits of the fractional parts of the square roots of the first 8 primes.
START = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_MASK = 0xFFFFFFFF


@cache
def _rounds() -> tuple[int, ...]:
    """The first 32 bits of the fractional parts of the cube roots of the first 64 primes."""
    primes = [n for n in range(2, 312) if all(n % d for d in range(2, int(n**0.5) + 1))][:64]
    out = []
    for p in primes:
        low, high, aim = 0, 1 << 36, p << 96
        while high - low > 1:  # the integer cube root of p * 2^96
            mid = (low + high) // 2
            low, high = (mid, high) if mid**3 <= aim else (low, mid)
        out.append(low & _MASK)
    return tuple(out)


class _Context(ctypes.Structure):
    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_ubyte * 64), ("num", ctypes.c_uint), ("size", ctypes.c_uint)]


@cache
def _native():
    """OpenSSL's update function, by the library that hashlib itself uses, or None."""
    names = []
    try:
        import _hashlib

        names.append(_hashlib.__file__)
    except ImportError:
        pass
    for name in [*names, ctypes.util.find_library("crypto")]:
        try:
            return ctypes.CDLL(name).SHA256_Update if name else None
        except (OSError, AttributeError):
            continue
    return None


class Sha256:
    """A digest under way: eight words, the number of bytes so far, and the bytes of the block that isn't full."""

    def __init__(self, state: bytes | None = None):
        *words, self.count = struct.unpack("<8IQ", state[:40]) if state else (*START, 0)
        self.words, self.rest = list(words), state[40:] if state else b""

    def state(self) -> bytes:
        """What another process needs to go on; below 104 bytes."""
        return struct.pack("<8IQ", *self.words, self.count) + self.rest

    def update(self, data: bytes) -> Sha256:
        if data:
            self._native(data) if _native() else self._plain(data)
        return self

    def _native(self, data: bytes) -> None:
        bits = self.count * 8
        c = _Context((ctypes.c_uint32 * 8)(*self.words), bits & _MASK, bits >> 32 & _MASK, (ctypes.c_ubyte * 64)(*self.rest), len(self.rest), 32)
        _native()(ctypes.byref(c), ctypes.c_char_p(data), ctypes.c_size_t(len(data)))
        self.words, self.rest = list(c.h), bytes(c.data[: c.num])
        self.count += len(data)

    def _plain(self, data: bytes) -> None:
        self.count += len(data)
        data = self.rest + data
        whole = len(data) // 64 * 64
        for k in range(0, whole, 64):
            self._block(data[k : k + 64])
        self.rest = data[whole:]

    def _block(self, block: bytes) -> None:
        turn = lambda x, n: (x >> n | x << (32 - n)) & _MASK
        w = list(struct.unpack(">16I", block))
        for i in range(16, 64):
            a, b = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (turn(a, 7) ^ turn(a, 18) ^ a >> 3) + w[i - 7] + (turn(b, 17) ^ turn(b, 19) ^ b >> 10)) & _MASK)
        a, b, c, d, e, f, g, h = self.words
        for k, x in zip(_rounds(), w, strict=True):
            t = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k + x
            u = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (t + u) & _MASK, a, b, c, (d + t) & _MASK, e, f, g
        self.words = [(x + y) & _MASK for x, y in zip(self.words, (a, b, c, d, e, f, g, h), strict=True)]

    def digest(self) -> bytes:
        end = Sha256(self.state())
        end.update(b"\x80" + b"\0" * ((55 - self.count) % 64) + struct.pack(">Q", self.count * 8))
        return struct.pack(">8I", *end.words)

    def hexdigest(self) -> str:
        return self.digest().hex()
