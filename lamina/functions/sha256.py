"""SHA-256 whose state can be taken along: a long value is hashed over several tasks, one after the other."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
from functools import cache

#: Bytes of OpenSSL's SHA256_CTX: eight words of state, the length, a block and two counts.
_CTX = 112


@cache
def _lib() -> ctypes.CDLL:
    for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Init.argtypes = [ctypes.c_char_p]
            lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
            lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
            return lib
        except (OSError, AttributeError, TypeError):
            continue
    raise ImportError("OpenSSL's libcrypto, with SHA256_Update, is needed")


class Sha256:
    def __init__(self, state: bytes | None = None):
        self._ctx = ctypes.create_string_buffer(state, _CTX) if state else ctypes.create_string_buffer(_CTX)
        if not state:
            _lib().SHA256_Init(self._ctx)

    def update(self, data: bytes) -> None:
        _lib().SHA256_Update(self._ctx, data, len(data))

    def state(self) -> bytes:
        return self._ctx.raw

    def hexdigest(self) -> str:
        ctx, out = ctypes.create_string_buffer(self._ctx.raw, _CTX), ctypes.create_string_buffer(32)
        _lib().SHA256_Final(out, ctx)
        return out.raw.hex()
