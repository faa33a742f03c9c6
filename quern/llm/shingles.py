"""Word shingles of whole texts as 128-bit hashes, computed on byte arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A
document's set holds its distinct five-word shingles; a document of one to four
words has the whole sequence as its one shingle; no words, no shingles.

A hash is two 64-bit lanes with seeds of their own. Words of up to eight bytes go
through a bijection, so two of one length never share a lane; longer ones are chained
block by block, each block through that bijection, and words of over LONG_WORD bytes are
hashed by BLAKE2b. For all shingles of 100 TB of text, about 2^44, two that differ
and share both lanes are expected 2^-41 times.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WIDTH = 5
LONG_WORD = 64
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0x165667B19E3779F9)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

Lanes = tuple[np.ndarray, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray, cut: np.ndarray | None = None, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes after the table fold, where words start and end in them, and for each document the index of its first word (one more entry at the end).

    Where cut says so, a word ends before a byte.
    """
    n = len(data)
    low = fold[data]
    inside = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    if cut is not None:
        edge[:-1] |= cut
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...] = SEEDS) -> tuple[np.ndarray, ...]:
    """A lane of 64-bit hashes of the words for each seed (of the first two, for long words)."""
    lens = ends - starts
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from each place
    base = lens.astype(np.uint64) * _LENGTH
    lanes = [mix(base + np.uint64(s)) for s in seeds]
    at = np.flatnonzero(lens <= LONG_WORD)
    done = 0
    while len(at):
        left = lens[at] - done
        block = eight[starts[at] + done] & _MASK[np.minimum(left, 8)]
        for lane in lanes:
            lane[at] = mix(lane[at] ^ block)
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(lens > LONG_WORD):
        digest = np.frombuffer(blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), np.uint64)
        for lane, value in zip(lanes, digest, strict=False):
            lane[i] = value
    return tuple(lanes)


def _distinct(a: np.ndarray, b: np.ndarray) -> Lanes:
    """The distinct pairs of two lanes in order."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # one lane met by chance, or a run is out of order
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    keep = np.ones(len(x), bool)
    keep[1:] = ~(same & (y[1:] == y[:-1]))
    return x[keep], y[keep]


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[Lanes]:
    """For each document the distinct hashes of its shingles, in order."""
    low, starts, ends, first = word_spans(data, offs)
    words = hash_words(low, starts, ends)
    rolled = []
    for w in words:
        r = w
        for j in range(1, WIDTH):
            r = mix(r[: max(0, len(w) - j)]) + w[j:]
        rolled.append(mix(r))
    none = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WIDTH:
            out.append(_distinct(rolled[0][a : b - WIDTH + 1], rolled[1][a : b - WIDTH + 1]))
        elif b > a:
            one = []
            for w in words:
                r = np.array([b - a], np.uint64) * _SHORT
                for x in w[a:b]:
                    r = mix(r) + x
                one.append(mix(r))
            out.append((one[0], one[1]))
        else:
            out.append((none, none))
    return out


def fingerprint(s: Lanes) -> bytes:
    """A 128-bit cryptographic digest of a set."""
    h = blake2b(s[0].tobytes(), digest_size=16)
    h.update(s[1].tobytes())
    return h.digest()


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for a seed everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], odd: np.ndarray) -> np.ndarray:
    """The MinHash signature of each set: per coordinate the upper half of the least product; empty sets get zeros."""
    out = np.zeros((len(sets), len(odd)), np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(sizes)
    at = 0
    while at < len(rows):
        to, total = at, 0
        while to < len(rows) and (to == at or total + sizes[rows[to]] <= 1 << 15):
            total += sizes[rows[to]]
            to += 1
        part = rows[at:to]
        flat = np.concatenate([sets[r] for r in part])
        first = np.cumsum(sizes[part]) - sizes[part]
        for k, a in enumerate(odd):
            out[part, k] = np.minimum.reduceat(flat * a, first) >> np.uint64(32)
        at = to
    return out.view(np.int32)
