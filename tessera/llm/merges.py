"""Byte-pair merges of many short pieces at once, in arrays.

All pieces advance together: in each round every piece applies its least-ranked merge at all places, left to right, which
is what merging one place after another comes to, for a merge's result only takes part in merges of higher rank.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(1 << 30)


def byte_signs() -> list[str]:
    """The sign that byte-level files write for each byte: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Merges:
    """Of a byte-level BPE file with an end-of-word suffix."""

    BITS = 19

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain BPE file with an end-of-word suffix")
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        # open addressing; key -1 is free
        size = 1 << self.BITS
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            slot = at[todo]
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.ranks[slot[first]] = keys[todo[first]], todo[first]
            todo = np.delete(todo, first)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 16 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty piece as little-endian uint16 bytes."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes) - 1
        ids = self.inner[data]
        ids[ends] = self.last[data[ends]]
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[ends] = NONE
        live = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        while True:
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                per_id = np.repeat(done, sizes)
                flat = ids[per_id].astype("<u2").tobytes()
                at = 0
                for k, n in zip(live[done].tolist(), sizes[done].tolist(), strict=True):
                    out[k] = flat[at : at + 2 * n]
                    at += 2 * n
                if done.all():
                    return out
                ids, rank, live, sizes, least = ids[~per_id], rank[~per_id], live[~done], sizes[~done], least[~done]
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            close = np.flatnonzero(at[1:] == at[:-1] + 1)
            if len(close):  # a pair of equal ids in a run: every other one
                new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
                start = at[new_run][np.cumsum(new_run) - 1]
                at = at[(at - start) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            gone = np.add.reduceat(~keep, np.cumsum(sizes) - sizes)
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            ended = np.concatenate([last[at + 1]])
            ids, rank, sizes = ids[keep], rank[keep], sizes - gone
            at = at - np.arange(len(at))  # their places now
            rank[at[ended]] = NONE
            more = at[~ended]
            rank[more] = self.rank(ids[more], ids[more + 1])
            first = np.zeros(len(ids), bool)
            first[np.cumsum(sizes) - sizes] = True
            before = at[~first[at]] - 1
            rank[before] = self.rank(ids[before], ids[before + 1])
