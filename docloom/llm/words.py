"""Words of many texts at once: spans, hashes and exact comparison in flat byte buffers.

A word is a maximal run of bytes other than space and the control bytes 9 to 13.
UTF-8 never uses those bytes inside a longer code point, so bytes suffice.
"""

from __future__ import annotations

import numpy as np

from docloom.llm import text

#: Bytes between words: a fixed value.
SEPARATORS = (0x20, *range(0x09, 0x0E))


def padded8(data: np.ndarray) -> np.ndarray:
    """uint64 array whose item i holds bytes i .. i + 7, zeros beyond the end."""
    return text.grams8(np.concatenate([data, np.zeros(8, np.uint8)]))


def _low_bytes(n: np.ndarray) -> np.ndarray:
    """Mask of the n lowest bytes of a word of 8 (n is 1 to 8)."""
    return ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * n.astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, text number) of every word; a word ends with its text."""
    between = np.zeros(256, bool)
    between[list(SEPARATORS)] = True
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= between[data[:-1]] | cut[1:-1]
    closes[:-1] &= between[data[1:]] | cut[1:-1]
    begins = np.flatnonzero(opens)
    return begins, np.flatnonzero(closes) + 1, np.searchsorted(offsets, begins, side="right") - 1


def hashes(eight: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, eight bytes a round, over the spans that go on."""
    out = eight[begins] & _low_bytes(np.minimum(sizes, 8))
    out += sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text.mix64(out)
    at, longer = 8, np.flatnonzero(sizes > 8)
    while len(longer):
        rest = np.minimum(sizes[longer] - at, 8)
        out[longer] = text.mix64(out[longer] + (eight[begins[longer] + at] & _low_bytes(rest)) * np.uint64(0xC2B2AE3D27D4EB4F))
        at += 8
        longer = longer[sizes[longer] > at]
    return out


def equal_bytes(eight: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of one size that begin at a and b have the same bytes."""
    same = ((eight[a] ^ eight[b]) & _low_bytes(np.minimum(sizes, 8))) == 0
    at, longer = 8, np.flatnonzero(same & (sizes > 8))
    while len(longer):
        rest = np.minimum(sizes[longer] - at, 8)
        differs = ((eight[a[longer] + at] ^ eight[b[longer] + at]) & _low_bytes(rest)) != 0
        same[longer[differs]] = False
        at += 8
        longer = longer[~differs & (sizes[longer] > at)]
    return same
