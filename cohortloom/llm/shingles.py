"""Sets of word shingles and their sketches."""

from __future__ import annotations

from math import comb

import numpy as np

#: A text keeps its least shingle in BANDS x ROWS orders of all shingles. At similarity 0.8 a pair agrees in no whole band about once in 330,000: (1 - 0.8^5)^32.
BANDS, ROWS = 32, 5
#: Chance that the minima of a pair of just the similarity sought agree too seldom.
HIDDEN = 1e-6


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined runs of `shingle` words, A-Z lower-cased; of all words, if they are fewer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    ends = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=len(ends))


def orders() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the further hashes that order the shingles."""
    r = np.random.default_rng(5)
    return tuple(r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def minima(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the least of each further hash of the shingles."""
    masks, odd = factors
    out = np.full(len(odd), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        x = shingles[at : at + 256, None] ^ masks
        x *= odd
        x ^= x >> np.uint64(32)
        x *= odd
        out = np.minimum(out, x.min(axis=0))
    return out.astype("<u2")


def band_keys(least: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a name for each band of the minima (texts, BANDS x ROWS); bands of different places never mean the same."""
    x = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for r in range(ROWS):
        out = (out ^ x[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def fewest(similarity: float) -> int:
    """Minima in which a pair of that similarity agrees at least, but for a chance of HIDDEN."""
    n, below = BANDS * ROWS, 0.0
    for k in range(n + 1):
        below += comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > HIDDEN:
            return k
    return n


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, block: int = 1024) -> np.ndarray:
    """(left, right): how many shingles the sets of each pair share, exactly; left and right are places in sets.

    What many sets of the right side hold is multiplied out, the rest is counted along lists of who holds it.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
    side = np.full((2, len(sets)), -1)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    l_id, l_at = ids[side[0, owner] >= 0], side[0, owner][side[0, owner] >= 0]
    r_id, r_at = ids[side[1, owner] >= 0], side[1, owner][side[1, owner] >= 0]
    order = np.argsort(r_id, kind="stable")
    r_id, r_at = r_id[order], r_at[order]
    held = np.bincount(r_id, minlength=len(names))
    common = np.flatnonzero(held > max(8, len(right) / 16))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), block):
        place = np.full(len(names), -1)
        place[common[lo : lo + block]] = np.arange(len(common[lo : lo + block]))
        tables = []
        for i, at, n in ((l_id, l_at, len(left)), (r_id, r_at, len(right))):
            table, has = np.zeros((n, len(common[lo : lo + block])), np.float32), place[i] >= 0
            table[at[has], place[i][has]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    begins, rare = np.concatenate([[0], np.cumsum(held)]), np.ones(len(names), bool)
    rare[common] = False
    few = rare[l_id] & (held[l_id] > 0)
    l_id, l_at = l_id[few], l_at[few]
    flat = out.reshape(-1)
    for lo in range(0, len(l_id), 1 << 15):
        i, at = l_id[lo : lo + (1 << 15)], l_at[lo : lo + (1 << 15)]
        n = held[i]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[i], n)
        np.add.at(flat, np.repeat(at, n) * len(right) + r_at[places], np.float32(1))
    return out
