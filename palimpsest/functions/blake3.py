"""BLAKE3 after its published specification, in plain Python: for parity with stored digests, not for volume."""

from __future__ import annotations

import struct

# The initial state (that of SHA-256) and the message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: State words that a quarter round mixes: columns, then diagonals.
LANES = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)] + [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]
MASK = 0xFFFFFFFF


def _turn(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & MASK


def _compress(chain: tuple[int, ...], block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    s = [*chain, *IV[:4], counter & MASK, counter >> 32 & MASK, size, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(LANES):
            for word, right, left in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                s[a] = (s[a] + s[b] + word) & MASK
                s[d] = _turn(s[d] ^ s[a], right)
                s[c] = (s[c] + s[d]) & MASK
                s[b] = _turn(s[b] ^ s[c], left)
        m = [m[p] for p in PERMUTATION]
    return [x ^ y for x, y in zip(s[:8], s[8:])]


def _chunk(data: bytes, counter: int, last: int) -> tuple[int, ...]:
    chain: tuple[int, ...] = IV
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        flags = CHUNK_START * (i == 0) | (CHUNK_END | last) * (i == len(blocks) - 1)
        chain = tuple(_compress(chain, b, counter, len(b), flags))
    return chain


def _tree(data: bytes, counter: int, last: int) -> tuple[int, ...]:
    """A left subtree is the largest power of two of whole chunks that leaves something for the right."""
    if len(data) <= 1024:
        return _chunk(data, counter, last)
    left = 1024 << ((len(data) - 1) // 1024).bit_length() - 1
    both = _tree(data[:left], counter, 0) + _tree(data[left:], counter + left // 1024, 0)
    return tuple(_compress(IV, struct.pack("<16I", *both), 0, 64, PARENT | last))


def digest(data: bytes) -> str:
    """32 bytes in hexadecimal."""
    return struct.pack("<8I", *_tree(data, 0, ROOT)).hex()
