"""Decoder of LZ4 blocks with a size prefix, as browsers store their sessions."""

from __future__ import annotations

MAGIC = b"mozLz40\x00"


def decode_block(data: bytes, size: int) -> bytes:
    """The ``size`` bytes of a raw LZ4 block; a malformed block raises ValueError."""
    out, i, n = bytearray(), 0, len(data)
    try:
        while i < n:
            token = data[i]
            i += 1
            literal = token >> 4
            if literal == 15:
                while True:
                    more = data[i]
                    i += 1
                    literal += more
                    if more != 255:
                        break
            if i + literal > n:
                raise ValueError("literals beyond the end")
            out += data[i : i + literal]
            i += literal
            if i >= n:
                break
            offset = data[i] | data[i + 1] << 8
            i += 2
            if not 0 < offset <= len(out):
                raise ValueError("offset out of range")
            length = (token & 15) + 4
            if token & 15 == 15:
                while True:
                    more = data[i]
                    i += 1
                    length += more
                    if more != 255:
                        break
            start = len(out) - offset
            if offset >= length:
                out += out[start : start + length]
            else:
                piece = bytes(out[start:])
                out += (piece * (length // offset + 1))[:length]
    except IndexError as e:
        raise ValueError("block ends early") from e
    if len(out) != size:
        raise ValueError("size doesn't match")
    return bytes(out)


def decode_session(data: bytes) -> str:
    """The JSON text of a session file."""
    if data[:8] != MAGIC:
        raise ValueError("not a session file")
    return decode_block(data[12:], int.from_bytes(data[8:12], "little")).decode("utf-8")


def encode_literal(text: str) -> bytes:
    """A valid session file without compression (one run of literals), for tests and round trips."""
    raw = text.encode("utf-8")
    n = len(raw)
    head = bytes([min(n, 15) << 4])
    if n >= 15:
        rest = n - 15
        head += b"\xff" * (rest // 255) + bytes([rest % 255])
    return MAGIC + n.to_bytes(4, "little") + head + raw
