"""Byte-level BPE by a rank queue over a hierarchical bitmap.

Each pre-token is a doubly linked list of symbols. A bucket per merge rank holds the list
positions at which the merge of that rank may apply; a three-level bitmap (64 ways each) marks the
buckets in use, so that the lowest rank is found by three find-first-set steps. Merging changes
the two neighbouring pairs only; entries that no longer match what the list holds are stale and
skipped when their bucket is drained. A pre-token of n bytes costs O(n log n) at worst, whatever
its length, so a text without a single space is encoded whole.
"""

from __future__ import annotations

import base64
import json

import regex

#: The pattern that splits a text before the merges of the byte-level files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_LIMIT = 200_000  # pre-tokens remembered per worker
CACHE_CHARS = 64  # longer pre-tokens are not remembered


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves,
    the others are moved up behind 255 in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(moved)}


class RankQueue:
    """Ranks in 0..size-1, each with a bucket of positions; pops the lowest rank in use."""

    def __init__(self, size: int) -> None:
        self.buckets: list[list[int] | None] = [None] * size
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [at]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(at)

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) | ((m & -m).bit_length() - 1)
        w = self.low[a]
        return (a << 6) | ((w & -w).bit_length() - 1)

    def take(self, rank: int) -> list[int]:
        bucket = self.buckets[rank]
        self.buckets[rank] = None
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return bucket


class ByteBPE:
    """Encoder built from the bytes of a vocabulary file, ``.json`` (vocabulary and merges) or
    ``.tiktoken`` (ranks)."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.byte_ids = [0] * 256
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        if data[:1] == b"{":
            model = json.loads(data)["model"]
            vocab = model["vocab"]
            for symbol, byte in byte_symbols().items():
                self.byte_ids[byte] = vocab[symbol]
            for rank, merge in enumerate(model["merges"]):
                left, right = merge.split(" ") if isinstance(merge, str) else merge
                self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
            size = len(model["merges"])
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            for token, rank in ranks.items():
                if len(token) == 1:
                    self.byte_ids[token[0]] = rank
                for i in range(1, len(token)):
                    left, right = ranks.get(token[:i]), ranks.get(token[i:])
                    if left is not None and right is not None:
                        self.pairs[left, right] = (rank, rank)
            size = max(ranks.values()) + 1
        self.queue = RankQueue(size)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n, pairs, queue = len(ids), self.pairs, self.queue
        if n == 1:
            return (ids[0],)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            hit = pairs.get((ids[i], ids[i + 1]))
            if hit:
                queue.push(hit[0], i)
        while (rank := queue.first()) >= 0:
            waiting = sorted(queue.take(rank))
            for k, i in enumerate(waiting):
                j = after[i]
                if ids[i] < 0 or j >= n:
                    continue  # stale
                hit = pairs.get((ids[i], ids[j]))
                if not hit or hit[0] != rank:
                    continue  # stale
                ids[i], ids[j] = hit[1], -1
                after[i] = right = after[j]
                if right < n:
                    before[right] = i
                    new = pairs.get((ids[i], ids[right]))
                    if new:
                        queue.push(new[0], i)
                left = before[i]
                if left >= 0:
                    new = pairs.get((ids[left], ids[i]))
                    if new:
                        queue.push(new[0], left)
                if 0 <= queue.first() < rank:  # a merge made possible a better one: that goes first
                    for rest in waiting[k + 1 :]:
                        queue.push(rank, rest)
                    break
        return tuple(t for t in ids if t >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens; a null or empty text has none."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.split(text):
            got = cache.get(piece)
            if got is None:
                got = self.merge(piece)
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_LIMIT:
                        cache.clear()
                    cache[piece] = got
            out += got
        return out
