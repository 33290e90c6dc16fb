"""Byte-level BPE as a two-tier lookup: a minimal perfect hash over the vocabulary, then a merge heap.

Tier 1 resolves a whole pre-token that is itself a vocabulary entry through a minimal perfect hash (hash and
displace). Tier 2 merges the bytes of any other pre-token with a heap of candidate pairs over a linked list, so
a pre-token of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from functools import lru_cache

import numpy as np
import regex
import xxhash

#: Fixed value of the public vocabulary: how text is split into pre-tokens.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed public_tokenizers package, or under /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(root, "byte_bpe_50k.tiktoken")


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): n keys fill exactly n slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = np.array([xxhash.xxh3_128_intdigest(k) & 0xFFFFFFFFFFFFFFFF for k in keys], dtype=np.uint64)
        self.shift = np.zeros(self.buckets, dtype=np.uint32)
        self.slot_hash = np.zeros(n, dtype=np.uint64)
        self.slot_value = np.full(n, -1, dtype=np.int32)
        free = np.ones(n, dtype=bool)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(counts)))
        vals = np.array(values, dtype=np.int32)
        big = [b for b in np.argsort(-counts, kind="stable").tolist() if counts[b] > 1]
        for b in big:
            members = order[starts[b] : starts[b + 1]]
            self.shift[b], slots = self._place(hashes[members], free)
            free[slots] = False
            self.slot_hash[slots], self.slot_value[slots] = hashes[members], vals[members]
        # A bucket with one key names its slot directly, so the last free slots need no search.
        single = np.flatnonzero(counts == 1)
        slots, members = np.flatnonzero(free)[: len(single)], order[starts[single]]
        self.shift[single] = slots.astype(np.uint32) | self.DIRECT
        self.slot_hash[slots], self.slot_value[slots] = hashes[members], vals[members]

    DIRECT = np.uint32(1 << 31)

    def _place(self, h: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends the keys of a bucket to different free slots."""
        for start in range(0, 1 << 24, 256):
            slots = self._slots(h[None, :], np.arange(start, start + 256)[:, None])
            for row in np.flatnonzero(free[slots].all(axis=1)).tolist():
                if len(set(slots[row].tolist())) == len(h):
                    return start + row, slots[row]
        raise ValueError("no displacement found")

    def _slots(self, h: np.ndarray, d) -> np.ndarray:
        mixed = (h ^ (h >> np.uint64(29))) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(d, dtype=np.uint64) + np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def get(self, keys: list[bytes]) -> np.ndarray:
        """Values of many keys at once, -1 for a key that was not hashed."""
        if not keys:
            return np.zeros(0, dtype=np.int32)
        h = np.fromiter((xxhash.xxh3_128_intdigest(k) & 0xFFFFFFFFFFFFFFFF for k in keys), dtype=np.uint64, count=len(keys))
        with np.errstate(over="ignore"):
            shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
            slots = np.where(shift & self.DIRECT, shift & ~self.DIRECT, self._slots(h, shift)).astype(np.int64)
        return np.where(self.slot_hash[slots] == h, self.slot_value[slots], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, leftmost on a tie."""
    n = len(piece)
    end = list(range(1, n + 1))  # a node starts at i and ends at end[i]
    prev, nxt, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            k = nxt[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Encoder:
    """The vocabulary of one worker process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with np.errstate(over="ignore"):
            self.hash = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.split = regex.compile(PRE_TOKEN)
        self.seen: dict[str, tuple[int, ...]] = {}

    def resolve(self, pieces: list[str]) -> None:
        """Look the pre-tokens up that this process has not met; misses of the hash are merged."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.seen]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, v in zip(new, raw, self.hash.get(raw).tolist()):
            self.seen[p] = (v,) if v >= 0 else tuple(merge(b, self.ranks))

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; the empty list for an empty or null text."""
        if not text:
            return []
        pieces = self.split.findall(text)
        self.resolve(pieces)
        seen, out = self.seen, []
        for p in pieces:
            out.extend(seen[p])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process, built once from the vocabulary file."""
    return Encoder(path)
