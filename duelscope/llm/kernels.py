"""Vectorised text kernels: words, shingle sets and hashes of a batch of texts.

Everything here works on whole batches of UTF-8 bytes with NumPy, so that no
Python code runs for each word.  Hashes depend only on the text, never on the
process, and are the same on every executor.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: An odd multiplier for the polynomial over the bytes of a word.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step takes together; long texts make a step of their own.
STEP_BYTES = 400_000


def _byte_codes() -> np.ndarray:
    """A 64-bit code of each byte; A-Z share the codes of a-z, white space has none."""
    codes = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], dtype=np.uint64)
    codes[65:91] = codes[97:123]
    codes[[32, *range(9, 14)]] = 0
    return codes


CODES = _byte_codes()
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * STEP_BYTES)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 8 * STEP_BYTES:
            _powers[name] = have
    return have[:n]


def steps(sizes: list[int], limit: int = STEP_BYTES):
    """Ranges of consecutive texts whose sizes together stay under the limit, one text at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[data]
    word = ~space
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(space & before)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(CODES[data] * powers(len(data), BASE, "up"), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(len(data), INVERSE, "down")[starts] + (ends - starts).astype(np.uint64))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return hashes, np.searchsorted(starts, bounds)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a short array."""
    if len(hashes) < 2:
        return hashes.copy()
    s = np.sort(hashes)
    keep = np.empty(len(s), dtype=bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def shingle_sets(texts: list[bytes | None], width: int = 5):
    """For each text its sorted distinct shingle hashes.

    A text of fewer words than ``width``, but not none, has its whole sequence
    as one shingle; a null text or one without words has an empty set.
    """
    raw = [t or b"" for t in texts]
    out: list[np.ndarray] = []
    salts = [np.uint64(pow(INVERSE, k + 3, 1 << 64) | 1) for k in range(width)]
    for lo, hi in steps([len(t) for t in raw]):
        hashes, first = word_hashes(raw[lo:hi])
        full = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for k in range(width):
            full += hashes[k : k + len(full)] * salts[k]
        full = mix(full)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= width:
                out.append(distinct(full[a : b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for k in range(b - a):
                        short = short + hashes[a + k] * salts[k]
                out.append(mix(np.array([short], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int = 80):
    """The least intersection with which sets of these sizes reach the similarity: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1 if len(b) else 0
    return int((b[at] == a).sum()) if len(b) else 0


#: Bits of the parity map that bounds a symmetric difference from below.
PARITY_BITS = 1024


def parity(members: np.ndarray) -> bytes:
    """One bit for each of PARITY_BITS classes of hashes: whether the set has an odd number of it.

    Two maps differ in no more bits than their sets differ in elements.
    """
    odd = np.bincount((members >> np.uint64(54)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def identity(members: np.ndarray) -> int:
    """A signed 64-bit id of a set: equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def spread(members: np.ndarray) -> np.ndarray:
    """How many of the hashes lie in each of 16 equal ranges."""
    return np.bincount((members >> np.uint64(60)).astype(np.int64), minlength=16)


def similar(a: np.ndarray, b: np.ndarray, percent: int = 80, spreads: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Whether 100 |a & b| >= percent |a | b|; the suffix filter, counts over hash ranges, goes first."""
    need = needed(len(a), len(b), percent)
    if need > min(len(a), len(b)) or not need:
        return False
    x, y = spreads or (spread(a), spread(b))
    if np.abs(x - y).sum() > len(a) + len(b) - 2 * need:
        return False
    return overlap(a, b) >= need


#: Codes of the characters of the basic plane; others are mixed as they come.
PLANE = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E37))


def character_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by place, and for each line where its runs of ``width`` characters begin and how many they are.

    A line shorter than that is one run.  Hashes at other places, those that
    would cross the end of a line, mean nothing.  No line is empty or holds a
    line end.
    """
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", dtype=np.uint32)
    codes = PLANE[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        codes[beyond] = mix(points[beyond].astype(np.uint64) + np.uint64(0x9E37))
    down = powers(len(points), INVERSE, "down")
    total = np.zeros(len(points) + width, dtype=np.uint64)
    codes *= powers(len(points), BASE, "up")
    np.cumsum(codes, out=total[1 : len(points) + 1])
    total[len(points) + 1 :] = total[len(points)]
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    hashes = mix((total[width:] - total[:-width]) * down[: len(total) - width] + np.uint64(width))
    short = starts[sizes < width]
    if len(short):
        n = sizes[sizes < width]
        hashes[short] = mix((total[short + n] - total[short]) * down[short] + n.astype(np.uint64))
    return hashes, starts, np.maximum(sizes - width + 1, 1)


def minhashes(hashes: np.ndarray, starts: np.ndarray, runs: np.ndarray, count: int) -> np.ndarray:
    """A (lines, count) table of smallest images under ``count`` bijections of 32 bits."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    bounds = np.stack([starts, np.minimum(starts + runs, len(short) - 1)], axis=1).ravel()
    out = np.empty((len(starts), count), dtype=np.uint32)
    moved = np.empty_like(short)
    for k in range(count):
        np.multiply(short, np.uint32(int(seeds[2 * k]) & 0xFFFFFFFF | 1), out=moved)
        moved ^= np.uint32(int(seeds[2 * k + 1]) & 0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(moved, bounds)[::2]
    return out


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function, giving memory back to the system when its partition is done: workers stay for later tasks."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


class Recent:
    """Remembers ids for a while: enough to send repeats of a task once, never more than a fixed number of them."""

    def __init__(self, most: int = 100_000):
        self.most, self.ids = most, set()

    def new(self, e: int) -> bool:
        if e in self.ids:
            return False
        if len(self.ids) >= self.most:
            self.ids.clear()
        self.ids.add(e)
        return True
