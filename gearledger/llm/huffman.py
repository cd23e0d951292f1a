"""Canonical length-limited Huffman codes for token ids, and their bit streams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Longest code; the decoding table has two to this power entries.
LIMIT = 18
# Tokens between two checkpoints.
BLOCK = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths up to ``limit`` for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, row = [np.ones(n, bool)], leaves
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        row = both[at]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(levels):
        own = int(level[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """Code lengths per id (0: the id does not occur)."""

    lengths: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> Code:
        lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
        if len(ids):
            lengths[ids] = code_lengths(counts)
        return cls(lengths)

    @cached_property
    def _canonical(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in canonical order, their lengths and the first places of their codes."""
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        spans = np.int64(1) << (LIMIT - self.lengths[ids])
        return ids, self.lengths[ids], np.cumsum(spans) - spans

    @cached_property
    def codes(self) -> np.ndarray:
        ids, lengths, first = self._canonical
        out = np.zeros(len(self.lengths), np.uint64)
        out[ids] = (first >> (LIMIT - lengths)).astype(np.uint64)
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every ``LIMIT``-bit beginning, the id and the bits it takes."""
        ids, lengths, _ = self._canonical
        spans = np.int64(1) << (LIMIT - lengths)
        symbol, used = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
        filled = int(spans.sum())
        symbol[:filled], used[:filled] = np.repeat(ids, spans), np.repeat(lengths, spans)
        return symbol, used

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bit stream of documents joined in ``ids``; bytes and checkpoints (bits) of each document.

        A document begins at a byte, and every ``BLOCK`` tokens there is a checkpoint.
        """
        bits = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(bits)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        doc_bytes = -(-(total[ends] - total[starts]) // 8)
        shift = 8 * (np.cumsum(doc_bytes) - doc_bytes) - total[starts]
        at = total[:-1] + np.repeat(shift, sizes)
        words = np.zeros(int(doc_bytes.sum()) // 8 + 2, np.uint64)
        if len(ids):
            code, word = self.codes[ids], at >> 6
            over = (at & 63) + bits - 64  # bits that run into the next word
            high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[heads]] = np.add.reduceat(high, heads)
            crossing = np.flatnonzero(over > 0)
            words[word[crossing] + 1] += code[crossing] << (64 - over[crossing]).astype(np.uint64)
        stream = words.byteswap().tobytes()[: int(doc_bytes.sum())]
        blocks = -(-sizes // BLOCK)
        first = np.repeat(starts - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(int(blocks.sum()))
        own = np.repeat(starts, blocks)
        return stream, doc_bytes, total[first] - total[own]

    def decode(self, stream: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks that begin at the checkpoints (bits) and hold ``sizes`` tokens each."""
        symbol, used = self.table
        data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.empty(int(sizes.sum()), np.uint32)
        # All blocks advance together, one token at a time; longest first, so the rest drops off.
        order = np.argsort(-sizes, kind="stable")
        bit, left = checkpoints[order].astype(np.int64), sizes[order]
        place = (np.cumsum(sizes) - sizes)[order]
        for step in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-left, -step, side="left"))
            here = bit[:active]
            begin = (window[here >> 3] >> (32 - LIMIT - (here & 7)).astype(np.uint32)) & np.uint32((1 << LIMIT) - 1)
            out[place[:active] + step] = symbol[begin]
            bit[:active] += used[begin]
        return out
