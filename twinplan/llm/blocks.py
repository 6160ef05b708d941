"""Texts as blocks of bytes: what the vectorised operators share.

A block is a run of rows of an Arrow batch, cut so that its texts together hold
about limit bytes, and has at most 65536 rows; a longer text is a block of its own. Nulls read as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from twinplan.llm.common import Powers, Rolling, mix

#: Bytes of text that are worked on at once; the arrays beside them take some fifty times as much.
BLOCK = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, for hashes of stretches of bytes.
BYTE_CODES = _rng.integers(0, 1 << 64, 256, np.uint64)
BYTE_CODES_2 = _rng.integers(0, 1 << 64, 256, np.uint64)
POWERS, POWERS_2, POWERS_WORD, POWERS_WORD_2 = (Powers(s) for s in (11, 23, 37, 53))


@dataclass
class Block:
    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if texts.null_count:
            texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
        texts = texts.cast(pa.large_binary())
        _, o, d = texts.buffers()
        offsets = np.frombuffer(o, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, len(texts), i + (1 << 16))
            yield Block(batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


@dataclass
class Words:
    """The words of a block: bytes start:end, the number of their text, and word i of text t is at first[t] + i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words_of(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    inside = ~IS_SPACE[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = False
        before[starts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = inside[1:]
    if len(data):
        after[-1] = False
        ends = offsets[1:][offsets[1:] > 0] - 1
        after[ends] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    # texts without a byte share their offset with the next one; the last of them holds the word
    first = np.searchsorted(start, offsets)
    return Words(start, end, doc, first)


def byte_hashes(data: np.ndarray) -> Rolling:
    return Rolling(BYTE_CODES[data], POWERS)


def byte_hashes_2(data: np.ndarray) -> Rolling:
    return Rolling(BYTE_CODES_2[data], POWERS_2)


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, however long; each lane is a hash of its own.

    Every 8 bytes are mixed with a key of their place, and these values are added
    up. No base is raised to powers, so texts that differ by a polynomial with
    many factors of two, as Thue-Morse words do, are told apart like all others.
    """
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    which = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(which)) - first[which]
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    left = np.minimum(size[which] - (place << 3), 8).astype(np.uint64)
    token = eight[start[which] + (place << 3)] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - (left << np.uint64(3))))
    seed = np.uint64((0x9FB21C651E98DF25 * (lane + 1)) & (1 << 64) - 1)
    key = mix((np.arange(int(n.max(initial=0))).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ seed)
    sums = np.r_[np.uint64(0), np.cumsum(mix(token ^ key[place]), dtype=np.uint64)]
    return mix(sums[first + n] - sums[first] + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) ^ seed)


def word_hashes(data: np.ndarray, words: Words, lane: int = 0) -> np.ndarray:
    return stretch_hashes(data, words.start, words.end, lane)
