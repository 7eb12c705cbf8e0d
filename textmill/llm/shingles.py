"""Word shingles of a text as XXH64 hashes, and SimHash fingerprints of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED, BITS = 42, 64

#: Shingles that are hashed at once, which bounds memory on very long texts.
_BLOCK = 1 << 16


def hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, in blocks. Fewer words than a shingle: one of them all; none: none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and just the six white-space characters of ASCII
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for at in range(0, len(starts), _BLOCK):
        some = starts[at : at + _BLOCK]
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in zip(some, ends[at : at + _BLOCK], strict=True)), np.uint64, len(some))


def distinct_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Ascending."""
    found = list(hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def fingerprint_of(blocks: Iterator[np.ndarray]) -> int:
    """The 64 bits that are set in over half of all hashes; zero if there are none."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x
