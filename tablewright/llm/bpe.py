"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

Each leaf of the tree holds rank and place of the pair that begins there, each inner node
the smaller of its two children, so the root is the leftmost pair of the lowest rank. A merge
changes three leaves, and the ways up from them; it ends when the root holds no pair.

Short words are merged many at once, as one tree a row of a numpy array; a long word
has a tree of its own. Texts are cut into parts as ``tokens`` cuts them, and parts into words by
the pattern of the vocabulary's file; each distinct part of a chunk is merged once.
"""

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tablewright.llm.chunks import chunks
from tablewright.llm.tokens import Encoder, byte_signs, kept, ragged

_SHORT = 64  # symbols; longer words get a tree of their own
_CELLS = 1 << 19  # of the trees that are merged together
_CHUNK = 1 << 21
_NONE = np.int64(1 << 62)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The pairs of a vocabulary: rank and merged id by the two ids, as a table of open addresses."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks, self.merged = np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        for rank in range(len(keys) - 1, -1, -1):  # of a repeated pair the lowest rank stays
            key = keys[rank]
            at = int(key) * int(_SPREAD) % (1 << 64) >> int(self.shift)
            while self.keys[at] not in (-1, key):
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, merged[rank]
        self.one: dict[int, tuple[int, int]] = {}
        for rank in range(len(keys) - 1, -1, -1):
            self.one[int(keys[rank])] = (rank, int(merged[rank]))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; rank -1 if there is none."""
        keys = left << 32 | right
        at = (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        held = self.keys[at]
        odd = np.flatnonzero((held != keys) & (held != -1))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            held[odd] = self.keys[at[odd]]
            odd = odd[(held[odd] != keys[odd]) & (held[odd] != -1)]
        return np.where(held == keys, self.ranks[at], -1), self.merged[at]


def merge_word(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of one word, by a tree of its own; a merge takes a time logarithmic in the length of the word."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        found = merges.get(ids[i] << 32 | ids[i + 1])
        if found:
            tree[size + i] = found[0] << 32 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(place: int, value: int) -> None:
        at = size + place
        if tree[at] == value:
            return
        tree[at] = value
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                return
            tree[at] = least

    def pair(place: int) -> int:
        to = after[place]
        found = merges.get(ids[place] << 32 | ids[to]) if to < n else None
        return found[0] << 32 | place if found else none

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        ids[i] = merges[ids[i] << 32 | ids[j]][1]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        ids[j] = -1
        put(j, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [x for x in ids if x >= 0]


def merge_words(ids: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words of one padded size, one tree a row: ``ids`` is rows x size, a power of two, -1 behind a word's end."""
    rows, size = ids.shape
    ids = ids.astype(np.int64)
    places = np.arange(size, dtype=np.int64)
    after = np.where(places + 1 < lengths[:, None], places + 1, size)
    before = np.broadcast_to(places - 1, (rows, size)).copy()
    tree = np.full((rows, 2 * size), _NONE)
    r, i = np.nonzero(after < size)
    rank, _ = merges.find(ids[r, i], ids[r, i + 1])
    tree[r, size + i] = np.where(rank >= 0, rank << 32 | i, _NONE)
    half = size
    while half > 1:
        tree[:, half // 2 : half] = tree[:, half : 2 * half].reshape(rows, half // 2, 2).min(2)
        half //= 2

    def put(r: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        at = at + size
        tree[r, at] = value
        while size > 1 and at[0] > 1:
            at >>= 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def pairs(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        to = after[r, at]
        there = to < size
        rank, _ = merges.find(ids[r, at], np.where(there, ids[r, np.where(there, to, 0)], 0))
        return np.where(there & (rank >= 0), rank << 32 | at, _NONE)

    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        i = tree[live, 1] & 0xFFFFFFFF
        j = after[live, i]
        _, ids[live, i] = merges.find(ids[live, i], ids[live, j])
        to = after[live, j]
        after[live, i] = to
        inside = to < size
        before[live[inside], to[inside]] = i[inside]
        ids[live, j] = -1
        put(live, j, _NONE)
        put(live, i, pairs(live, i))
        first = before[live, i]
        some = first >= 0
        if some.any():
            put(live[some], first[some], pairs(live[some], first[some]))
        live = live[tree[live, 1] != _NONE]
    left = ids >= 0
    return ids[left], left.sum(1)


class TreeEncoder(Encoder):
    """Cuts and remembers parts as ``Encoder`` does; the ids of new ones come from segment trees."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary = held["model"]["vocab"]
        if held.get("normalizer") or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("segment trees encode byte-level vocabularies without a normalizer")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        joined = np.array([vocabulary[a + b] for a, b in pairs], np.int64).reshape(-1)
        known = np.array([[vocabulary[a], vocabulary[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        self.merges = Merges(known, joined)
        self.first = np.array([vocabulary[s] for s in byte_signs()], np.int64)
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.byte_of = {s: b for b, s in enumerate(byte_signs())}
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str

    def _words(self, part: bytes) -> list[bytes | int]:
        """The words of a part, as bytes, and the ids of added tokens."""
        if self._unit(part) is not None:
            return [part]
        rest, out = part.decode(), []
        while rest:
            at, token = min(((rest.find(t), t) for t in self.added if t in rest), default=(len(rest), ""))
            for signs, _ in self.cut(rest[:at]) if at else ():
                out.append(bytes(map(self.byte_of.__getitem__, signs)))
            if token:
                out.append(self.added[token])
            rest = rest[at + len(token) :]
        return out

    def _learn(self, parts: list[bytes]) -> None:
        cut = [self._words(p) for p in parts]
        place: dict[bytes | int, int] = {}
        order = [place.setdefault(w, len(place)) for words in cut for w in words]
        ids, starts, lengths = self.encode_words(list(place))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        used = np.array(order, np.int64)
        upto = np.zeros(len(used) + 1, np.int64)
        np.cumsum(lengths[used], out=upto[1:])
        bounds = np.zeros(len(cut) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        self._store(parts, ids[ragged(starts[used], lengths[used])].astype(np.uint32), np.diff(upto[bounds]))

    def encode_words(self, words: list[bytes | int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where those of each word begin and how many they are."""
        sizes = np.array([len(w) if isinstance(w, bytes) else 0 for w in words], np.int64)
        found, starts, lengths, used = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0

        def add(which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal used
            found.append(ids)
            starts[which], lengths[which] = used + np.cumsum(counts) - counts, counts
            used += len(ids)

        for k in np.flatnonzero((sizes == 0) | (sizes > _SHORT)).tolist():
            word = words[k]
            ids = [word] if isinstance(word, int) else merge_word(self.first[np.frombuffer(word, np.uint8)].tolist(), self.merges.one)
            add(np.array([k]), np.array(ids, np.int64), np.array([len(ids)]))
        size = 1
        while size <= _SHORT:
            group = np.flatnonzero((sizes > size // 2) & (sizes <= size))
            for a in range(0, len(group), max(1, _CELLS // size)):
                some = group[a : a + max(1, _CELLS // size)]
                ids = np.full((len(some), size), -1, np.int64)
                n = sizes[some]
                inside = np.arange(size) < n[:, None]
                ids[inside] = self.first[np.frombuffer(b"".join(words[k] for k in some.tolist()), np.uint8)]
                add(some, *merge_words(ids, n, self.merges))
            size *= 2
        return np.concatenate(found) if found else np.zeros(0, np.int64), starts, lengths


class Decoder:
    """The bytes of every id of a vocabulary; those of added tokens are their text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte_of = {s: b for b, s in enumerate(byte_signs())}
        tokens = held["model"]["vocab"] | {t["content"]: t["id"] for t in held["added_tokens"]}
        parts = [b""] * (max(tokens.values(), default=-1) + 1)
        for token, i in tokens.items():
            signs = [byte_of.get(c) for c in token]
            parts[i] = token.encode() if None in signs else bytes(signs)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids between the offsets; ids that the vocabulary lacks give nothing, bytes that are no UTF-8 the replacement sign."""
        known = (ids >= 0) & (ids < len(self.lengths))
        ids = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[ids], 0)
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        data = self.data[ragged(self.starts[ids], lengths)].tobytes()
        cuts = upto[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


def encode_texts(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in ``ids``, an array of integers; null is an empty text.

    A column that already has that name gives way. Rows are taken one by one, so repeated ones stay, and
    an empty table stays empty. ``path`` names the vocabulary's file on every machine. No shuffle.
    """
    fields = [f for f in docs.schema.fields if f.name != ids]
    schema = StructType([*fields, StructField(ids, ArrayType(IntegerType()))])
    names = [f.name for f in fields]
    docs = docs.select(*names) if column in names else docs.select(*names, F.col(column).alias("_text"))
    read = column if column in names else "_text"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for chunk in chunks(batches, read, _CHUNK):
            tool = tool or kept(TreeEncoder, path)
            found, offsets = tool.encode(chunk.data, chunk.offsets)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(chunk.rows.column(c) for c in names), lists], names=[*names, ids])
        if tool:
            tool.rest()

    return docs.mapInArrow(run, schema)


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the text of the token ids in ``text``, added tokens included; null ids give an empty text.

    A column that already has that name gives way. No shuffle.
    """
    fields = [f for f in frame.schema.fields if f.name != text]
    names = [f.name for f in fields]
    schema = StructType([*fields, StructField(text, StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            tool = tool or kept(Decoder, path)
            column = batch.column(ids)
            lists = column.cast(pa.large_list(pa.int64()))
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            offsets = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=offsets[1:])
            texts = pa.array(tool.decode(values, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, text])

    return frame.select(*names).mapInArrow(run, schema)
