"""ASCII-lower-cased words and hashes of word shingles, many documents at a time.

A word is a run of bytes that are 0-9, a-z after lower-casing A-Z, or above 0x7F, that is
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ on the lower-cased text.
"""

from __future__ import annotations

import xxhash

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Odd 64-bit constants of the mixing functions below (splitmix64).
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def mix(x):
    """splitmix64's finaliser on a uint64 array."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def word_hashes(many: list[list[bytes]]):
    """64-bit hashes of all words of many documents, one after the other, and each document's end."""
    import numpy as np

    ends = np.cumsum([len(w) for w in many], dtype=np.int64) if many else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for w in many for x in w), np.uint64, total), ends


def shingle_hashes(hashes, size: int):
    """Hash of the size words from each place on; the last size - 1 places of the array get 0."""
    import numpy as np

    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - size + 1
    if n > 0:
        h = hashes[:n].copy()
        for k in range(1, size):
            h = mix(h) + hashes[k : n + k]
        out[:n] = mix(h + np.uint64(size))
    return out
