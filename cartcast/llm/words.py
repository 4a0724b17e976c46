"""Words and their hashes over Arrow text columns, one numpy pass per block.

Texts are handled as UTF-8 bytes. Both word definitions used here treat every
byte from 0x80 up alike, so splitting bytes gives the same words as splitting
characters. Hashes are 64-bit; two different words or shingles agree by chance
with probability 2^-64, which the exact steps built on them accept. They are not
meant to withstand texts made to collide by someone who knows their constants.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

LONG_SPAN = 256  # bytes from which on a span is hashed by itself
BLOCK_BYTES = 1 << 20  # texts handled at once; a longer text makes its own block

#: Word bytes: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20  # A-Z to a-z

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the base (``up``) or of its inverse modulo 2^64 (``down``)."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, BLOCK_BYTES) + 1, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits may be used."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(29))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


@dataclass
class Block:
    """Some texts of a batch: bytes, where each text begins, and the batch row of the first."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a block in order: byte span, text within the block, hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words of each text


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts in blocks of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None):
    """Hash of each byte span, from prefix sums of a polynomial modulo 2^64.

    Such a polynomial takes the same value on certain pairs of strings whatever
    its constants (Thue-Morse sequences of two letters and their complements,
    from 1024 bytes on). Spans of ``LONG_SPAN`` bytes and more are hashed by
    XXH3 instead, one by one: few, and nothing in it cancels by length.
    """
    table = _BYTE if fold is None else _BYTE[fold]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power("up", len(data))[: len(data)], out=sums[1:])
    out = mix((sums[end] - sums[start]) * _power("down", len(data))[start])
    long = np.flatnonzero(end - start >= LONG_SPAN)
    if len(long):
        raw = (data if fold is None else fold[data]).tobytes()
        out[long] = [xxh3_64_intdigest(raw[s:e], _BASE) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return out


def find_words(block: Block, word_bytes: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of each text: the longest runs of ``word_bytes``."""
    inside = word_bytes[block.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(block.offsets, start, "right") - 1
    return Words(start, end, doc, span_hash(block.data, start, end, fold), np.bincount(doc, minlength=block.n))


def ngram_hash(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``n`` words within a text, in order."""
    m = max(0, len(words.hash) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ words.hash[k : m + k]) * _U(0x2545F4914F6CDD1D) + _U(k + 1)
    same = words.doc[:m] == words.doc[n - 1 : m + n - 1]
    return words.doc[:m][same], mix(h[same])

