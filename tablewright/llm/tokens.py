"""Token ids of whole texts by the tokenizers library, each distinct word of a chunk encoded once.

A text is cut in front of every run of blanks that follows another character, and
between a letter of Latin-1 and a sign of ASCII other than ``'`` and ``|``: the one may begin a
contraction, the other stands behind a letter in special tokens. Both kinds of public tokenizers
used here begin a new unit there, whatever stands around, so ids of the parts in
a row are the ids of the text.
"""

import gc
import os
import string
import sys
import types
import unicodedata
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa

from tablewright.llm.chunks import IS_SPACE, Chunk

TOKEN_CHUNK = 4 << 20
_KEPT_PARTS = 150_000  # from task to task
_KNOWN_PARTS = 400_000  # parts remembered from chunk to chunk; rare ones are then forgotten, which changes no result

# Last bytes of blanks beyond ASCII, by length of their UTF-8 form. A run of blanks may begin with one of those, so it is not cut there.
_TWO = {(0xC2, 0x85), (0xC2, 0xA0)}
_THREE = {(0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)} | {
    (0xE2, 0x80, x) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]
}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n + (int(starts.max()) if n else 0) < 2**31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(n, dtype=kind)
    return out


def pieces(values: pa.Array) -> list[bytes]:
    """The values of a large binary array without nulls, cut from one copy of its bytes, which ``to_pylist`` takes four times as long for."""
    _, offsets, data = values.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8).tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in pairwise(cuts)]


_LAST = np.array(sorted({x[-1] for x in _TWO | _THREE}), np.uint8)
_IS_LETTER, _IS_STOP = np.zeros(256, bool), np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_STOP[[b for b in string.punctuation.encode() if b not in b"'|"]] = True
_TOGETHER = 4096


def byte_signs() -> str:
    """The sign that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in seen else chr(next(hidden)) for b in range(256))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # parts are remembered here
        self.lower = self.tokenizer.normalizer is not None  # lower case, composed, and blanks dropped
        self.signs = byte_signs()
        self.place: dict[bytes, int] = {}
        self.parts: list[bytes] = []
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _unit(self, part: bytes) -> str | None:
        """A part as the vocabulary writes it, if it is letters behind at most one blank: those are never divided."""
        if self.lower:
            word = part.strip(b" \t\n\x0b\x0c\r")
            if word.isalpha():
                return word.lower().decode()
            text = word.decode()
            if not text.isalpha() or max(text) > "\u024f" or "\u0130" in text:
                return None
            return unicodedata.normalize("NFC", text).lower().encode().decode("latin-1").translate(self.signs)
        letters = part[1:] if part[:1] == b" " else part
        if letters.isalpha():
            return self.signs[32] + letters.decode() if len(letters) < len(part) else letters.decode()
        return part.decode("latin-1").translate(self.signs) if letters.decode().isalpha() else None

    def _learn(self, parts: list[bytes]) -> None:
        for a in range(0, len(parts), _TOGETHER):
            some = parts[a : a + _TOGETHER]
            units = [self._unit(p) for p in some]
            rest = [p.decode() for p, u in zip(some, units, strict=True) if u is None]
            whole = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
            tokenize = self.model.tokenize
            found = [next(whole).ids if u is None else [t.id for t in tokenize(u)] for u in units]
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            self._store(some, ids, np.fromiter(map(len, found), np.int64, len(found)))

    def rest(self) -> None:
        """Called at the end of a task, as the worker goes on to others."""
        if len(self.parts) > 2 * _KEPT_PARTS:
            self.shrink(_KEPT_PARTS)

    def shrink(self, most: int) -> None:
        """Keep the parts that most chunks had."""
        n = len(self.parts)
        if n <= most:
            return
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[:most])
        ids, lengths, hits = self.ids[ragged(self.starts[keep], self.lengths[keep])], self.lengths[keep], self.hits[keep]
        parts = [self.parts[i] for i in keep.tolist()]
        self.place, self.parts, self.used = {}, [], 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self._store(parts, ids, lengths)
        self.hits[: len(parts)] = hits // 2

    def _store(self, parts: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        have, total = len(self.place), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = ids
        while have + len(parts) > len(self.starts):
            self.starts, self.lengths, self.hits = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.hits)
            )
        self.starts[have : have + len(parts)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[have : have + len(parts)] = lengths
        self.hits[have : have + len(parts)] = 0
        self.used += total
        self.parts += parts
        self.place.update(zip(parts, range(have, have + len(parts)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = IS_SPACE[data]
        cuts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        odd = cuts[data[cuts - 1] >= 0x80]
        if len(odd):
            last = [tuple(data[max(0, c - 3) : c].tolist()) for c in odd[np.isin(data[odd - 1], _LAST)]]
            bad = [c for c, x in zip(odd[np.isin(data[odd - 1], _LAST)], last, strict=True) if x[-2:] in _TWO or x in _THREE]
            cuts = np.setdiff1d(cuts, bad) if bad else cuts
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        edge[1:-1] |= _IS_STOP[data[1:]] & _IS_LETTER[data[:-1]]
        after = np.flatnonzero(data[:-2] == 0xC3) + 2  # letters of Latin-1 beyond ASCII, times and divided by among them
        edge[after[_IS_STOP[data[after]] & (data[after - 1] != 0x97) & (data[after - 1] != 0xB7)]] = True
        edge[offsets] = True
        edge[len(data)] = edge[0] = True
        cuts = np.flatnonzero(edge)
        buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        distinct = pieces(parts.dictionary)
        if len(self.parts) > _KNOWN_PARTS:
            self.shrink(_KNOWN_PARTS // 2)
        new = [p for p in distinct if p not in self.place]
        if new:
            gc.disable()  # many small objects, none in a cycle
            self._learn(new)
            gc.enable()
        place = self.place
        known = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))
        self.hits[known] += 1
        places = known[parts.indices.to_numpy()]
        lengths = self.lengths[places]
        ids = self.ids[ragged(self.starts[places], lengths)]
        upto = np.zeros(len(cuts), np.int64)
        np.cumsum(lengths, out=upto[1:])
        return ids, upto[np.searchsorted(cuts, offsets)]

    def encode_chunk(self, chunk: Chunk, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the id ``end`` after each text."""
        ids, offsets = self.encode(chunk.data, chunk.offsets)
        return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def kept(kind: type, path: str):
    """The one object of that kind and path in this worker process.

    Functions travel by value, so modules of this package cannot keep it; a module that is set up in the worker does.
    """
    module = sys.modules.setdefault("tablewright_kept", types.ModuleType("tablewright_kept"))
    held = module.__dict__.setdefault("held", {})
    key = (kind.__name__, path)
    if key not in held:
        held[key] = kind(path)
    return held[key]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return kept(Encoder, path)
