"""Vectorised text kernels: words, shingles, MinHash, odd sketches, anchors.

Every kernel takes a batch of texts and works on one flat array of code points, so the cost per
character is a few numpy passes and no Python loop runs per word.  They are pure functions of their
input: a task that is run again on another executor gives the same rows.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
MASK32 = U64(0xFFFFFFFF)
# Odd multipliers of the hash functions (any odd 64-bit numbers would do, but they
# must be the same in every task).
MULT_A = U64(0x9E3779B97F4A7C15)
MULT_B = U64(0xC2B2AE3D27D4EB4F)
MULT_C = U64(0x165667B19E3779F9)
POLY = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * MULT_A
    x = x ^ (x >> U64(29))
    x = x * MULT_B
    return x ^ (x >> U64(32))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    chars = [chr(i) for i in range(0x110000)]
    return (
        np.fromiter((c.isalnum() for c in chars), bool, len(chars)),
        np.fromiter((c.isdigit() for c in chars), bool, len(chars)),
    )


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n - 1, 0), POLY)]), dtype=U64)


@functools.lru_cache(maxsize=2)
def _inverse_powers(n: int) -> np.ndarray:
    inverse = U64(pow(int(POLY), -1, 1 << 64))
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n - 1, 0), inverse)]), dtype=U64)


def _grown(n: int) -> int:
    """Sizes in powers of two, so that the cached power tables are shared between batches."""
    return 1 << max(10, int(n - 1).bit_length())


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and the start of each text."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    return codes, starts


def word_mask(codes: np.ndarray) -> np.ndarray:
    """Letters and digits, and a point or comma directly between two digits."""
    alnum, digit = _classes()
    inside = alnum[codes]
    marks = np.flatnonzero((codes == 46) | (codes == 44))
    marks = marks[(marks > 0) & (marks < len(codes) - 1)]
    marks = marks[digit[codes[marks - 1]] & digit[codes[marks + 1]]]
    inside[marks] = True
    return inside


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words before each text (length + 1)."""
    codes, starts = flatten([t.lower() for t in texts])
    inside = word_mask(codes)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    bounds = np.searchsorted(first, np.append(starts, len(codes)))
    if not len(first):
        return np.empty(0, U64), bounds
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, first)
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    value = (codes[at].astype(U64) + MULT_C) * _powers(_grown(int(size.max())))[place]
    return mix(np.add.reduceat(value, begin) + size.astype(U64)), bounds


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of `width` consecutive words per text, and their offsets.

    A text of fewer words than `width` has its whole word sequence as its only shingle; a text
    without any word has none.
    """
    word, bounds = words(texts)
    count = np.diff(bounds)
    n = len(texts)
    owner = np.repeat(np.arange(n), count)
    grams = np.zeros(max(len(word) - width + 1, 0), U64)
    for k in range(width):
        grams = (grams + word[k : k + len(grams)]) * MULT_A
        grams ^= grams >> U64(31)
    whole = owner[: len(grams)] == owner[width - 1 :] if len(grams) else np.empty(0, bool)
    value, of = mix(grams[whole]), owner[: len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array([_sequence_hash(word[bounds[i] : bounds[i + 1]]) for i in short], U64)
        value, of = np.concatenate([value, extra]), np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        value, of = value[keep], of[keep]
    return value, np.searchsorted(of, np.arange(n + 1))


def _sequence_hash(word: np.ndarray) -> int:
    h = U64(len(word))
    with np.errstate(over="ignore"):
        for w in word:
            h = (h ^ w) * MULT_B
            h ^= h >> U64(29)
    return int(h)


def set_prints(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit print per set (texts x 2), independent of order; every set must have an element."""
    out = np.zeros((len(bounds) - 1, 2), U64)
    if len(out):
        out[:, 0] = mix(np.add.reduceat(mix(value ^ MULT_C), bounds[:-1]))
        out[:, 1] = mix(np.add.reduceat(mix(value + MULT_B), bounds[:-1]) ^ np.diff(bounds).astype(U64))
    return out


@functools.cache
def _coefficients(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=U64) * MULT_C)
    low = (seeds & MASK32).astype(np.uint32)
    return low[:samples] | np.uint32(1), low[samples:]


def minhash(value: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """Signatures (texts x samples) of 32-bit minima; every set must have an element."""
    out = np.empty((len(bounds) - 1, samples), np.uint32)
    if not len(value):
        return out
    x = (value >> U64(32)).astype(np.uint32)
    a, b = _coefficients(samples)
    buffer = np.empty_like(x)
    for k in range(samples):
        np.multiply(x, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, bounds[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One bucket key per text and band of `rows` samples; bands never share keys.

    Keys keep 48 bits: a chance collision only adds a candidate, and the rows that are shuffled get
    smaller.
    """
    bands = signature.shape[1] // rows
    out = np.empty((len(signature), bands), U64)
    for k in range(bands):
        h = np.arange(k + 1, k + 2, dtype=U64).repeat(len(signature)) * MULT_C
        for j in range(rows):
            h = (h ^ signature[:, k * rows + j].astype(U64)) * MULT_A
            h ^= h >> U64(32)
        out[:, k] = mix(h) >> U64(16)
    return out


def odd_sketch(signature: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: each (sample number, minimum) toggles one of `bits` bits."""
    n, samples = signature.shape
    place = mix((signature.astype(U64) << U64(16)) + np.arange(samples, dtype=U64)) % U64(bits)
    flat = np.bincount((place + (np.arange(n, dtype=U64) * U64(bits))[:, None]).ravel().astype(np.int64), minlength=n * bits)
    return np.packbits((flat & 1).astype(bool).reshape(n, bits), axis=1)


def odd_likeness(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """Jaccard similarity from the population count of the XOR of two parity bitmaps."""
    bits = a.shape[1] * 8
    z = np.unpackbits(a ^ b, axis=1).sum(axis=1, dtype=np.int64)
    inner = np.maximum(1 - 2 * z / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(inner)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` code points from each position of one flat array."""
    n = len(codes)
    if n < width:
        return np.empty(0, U64)
    size = _grown(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(codes.astype(U64) + MULT_B) * _powers(size)[:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * _inverse_powers(size)[: n - width + 1])


def _sliding(x: np.ndarray, width: int, take, filler) -> np.ndarray:
    """Minimum or maximum of x[i : i + width] for every i (blockwise prefixes and suffixes)."""
    n = len(x)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, filler, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    prefix = take.accumulate(grid, axis=1).ravel()
    suffix = take.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(suffix[:n], prefix[width - 1 : width - 1 + n])


def anchors(texts: list[str], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors (text number, position, hash).

    The least hash of every `window` successive grams is chosen, so two texts that share a run of
    gram + window - 1 characters share an anchor inside that run, wherever the run stands.
    """
    codes, starts = flatten(texts)
    sizes = np.diff(np.append(starts, len(codes))) - 1
    h = window_hashes(codes, gram)
    top = U64(0xFFFFFFFFFFFFFFFF)
    valid = np.zeros(len(codes), bool)
    for s, k in zip(starts, sizes):
        if k >= gram:
            valid[s : s + k - gram + 1] = True
    valid = valid[: len(h)]
    h = np.where(valid, h, top)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    least = _sliding(h, window, np.minimum, top)
    # windows that begin in a text but reach past its end would choose needless anchors
    room = np.zeros(len(codes), bool)
    for s, k in zip(starts, sizes):
        if k >= gram:
            room[s : s + max(k - gram - window + 2, 1)] = True
    least = np.where(room[: len(h)], least, U64(0))
    pad = np.concatenate([np.zeros(window - 1, U64), least])
    highest = _sliding(pad, window, np.maximum, U64(0))[: len(h)]
    at = np.flatnonzero(valid & (highest == h))
    owner = np.searchsorted(starts, at, side="right") - 1
    return owner, at - starts[owner], h[at]
