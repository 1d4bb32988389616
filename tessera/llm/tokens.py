"""Exact, reuse-heavy encoding with a public word-level BPE file.

A text is split at ASCII white space into units, which separates them for good: neither normalisation nor pre-tokenisation
nor merges reach across it, and control strings hold none. So the ids of a text are the ids of its units in a row, and equal
units are encoded once. On characters on which Python's and the library's Unicode rules agree, units are lower-cased,
split and merged here, many at once; units with others (``ODD`` finds them, and control strings) go to the library.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from tessera.llm.merges import Merges

#: Other characters than plain ASCII (without rare controls), Latin letters with marks and common punctuation.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4\xb6-\xb8\xba\xbb\xbf-įı-ňŊ-ž‐-―‘-‟•…€]|<\\|")


#: The pre-tokenizer's pattern as it reads on the fast path's characters.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|\\d|(?:[^\\w\\s]|_)+")


#: Signs that end a clause, as bytes.
CLAUSE = frozenset(b".,;:!?")


#: In place of the ids of an odd unit; no ids are of odd length.
STRANGE = b"?"


class UnitEncoder:
    """Ids of texts as little-endian uint16 bytes.

    A unit that is met for the first time is on trial; met again, it is known. Of both, the half that has been there longest goes
    when they are full (``limit``, and a quarter of it); so memory is bounded, and rare units make no room for
    themselves, however much is encoded.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError(f"{size} ids do not fit in 16 bits")
        self.merges = Merges(self.tokenizer)
        self.limit, self.known, self.trial, self.odd = limit, {}, {}, False

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 20_000):
            out += self.merges.encode(pieces[at : at + 20_000])
        return out

    @staticmethod
    def _halved(d: dict, limit: int) -> dict:
        return d if len(d) <= limit else dict(islice(d.items(), len(d) - limit // 2, None))

    def _remember(self, found: dict) -> None:
        """Units on trial that are among ``found`` are known from now on, the others of it on trial."""
        again = found.keys() & self.trial.keys()
        self.trial.update(found)
        for k in again:
            self.known[k] = self.trial.pop(k)
        self.known = self._halved(self.known, self.limit)
        self.trial = self._halved(self.trial, self.limit // 4)

    def _recalled(self, keys: set[bytes]) -> dict[bytes, bytes]:
        out = {k: self.trial[k] for k in keys & self.trial.keys()}
        out.update((k, self.known[k]) for k in keys & self.known.keys())
        return out

    def _units(self, units: set[bytes]) -> dict[bytes, bytes]:
        """Ids of units that are not among the young, by their pieces; ``STRANGE`` for odd ones."""
        found = self._recalled(units)
        units = units.difference(found)
        whole = [u for u in units if u.isalpha()]  # ASCII letters alone: one piece
        split: dict[bytes, list[bytes] | None] = {}
        for u in units.difference(whole):
            if u[-1] in CLAUSE and u[:-1].isalpha():  # the most frequent kind, by its bytes
                split[u] = [u[:-1], u[-1:]]
                continue
            t = u.decode()
            if ODD.search(t):
                split[u] = None
            elif t.isalpha():
                whole.append(u)
            else:
                split[u] = [x.encode() for x in PIECE.findall(t)]
        found.update(zip(whole, self._merged(whole), strict=True))
        pieces = {x for p in split.values() if p for x in p}.difference(found)
        known = self._recalled(pieces)
        new = list(pieces.difference(known))
        known.update(zip(new, self._merged(new), strict=True))
        for u, p in split.items():
            if p is None:
                found[u], self.odd = STRANGE, True
            else:
                found[u] = b"".join([known[x] if x in known else found[x] for x in p])
        self._remember(found)
        return found

    def _odd_units(self, units: set[bytes]) -> dict[bytes, bytes]:
        """Ids of units as they are written, by the library; remembered with a byte in front that no text has."""
        keys = {b"\xff" + u for u in units}
        found = self._recalled(keys)
        new = [k for k in keys if k not in found]
        found.update(zip(new, self.library([k[1:].decode() for k in new]), strict=True))
        self._remember(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.known.get
        units = [t.lower().encode().split() for t in texts]
        out: list = [list(map(get, u)) for u in units]
        gaps = []
        for i, p in enumerate(out):
            if None in p:
                k, u = p.index(None), units[i]
                for _ in range(p.count(None) - 1):
                    gaps.append((i, k, u[k]))
                    k = p.index(None, k + 1)
                gaps.append((i, k, u[k]))
        new = self._units({u for _, _, u in gaps})
        for i, k, u in gaps:
            out[i][k] = new[u]
        if self.odd:
            strange = [(i, texts[i].encode().split()) for i, p in enumerate(out) if STRANGE in p]
            ids = self._odd_units({u for i, written in strange for u, x in zip(written, out[i], strict=True) if x == STRANGE})
            for i, written in strange:
                out[i] = [ids[b"\xff" + u] if x == STRANGE else x for u, x in zip(written, out[i], strict=True)]
        return [b"".join(p) for p in out]


_OPEN: dict[str, UnitEncoder] = {}


def unit_encoder(path: str) -> UnitEncoder:
    """The encoder of this process: a Python worker's later tasks go on with what it remembers."""
    if path not in _OPEN:
        _OPEN[path] = UnitEncoder(path)
    return _OPEN[path]
