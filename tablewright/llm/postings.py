"""Postings: which owners have a key, sent to buckets as packed blocks instead of a row each.

A key is 40 bits within its bucket, an owner a handle of 40 bits. Both can fall
together with others, so what postings find are candidates that an exact step has to settle.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.chunks import Chunk, chunks

_U = np.uint64
KEY_BITS, OWNER_BITS = 40, 40
FEW = 8  # owners of a key that meet in one task; the others do not need to
LABEL_BITS = 5  # the lowest bits of a key stay as they are
_FLUSH = 1 << 19
SCHEMA = "bucket int, many boolean, keys binary, owners binary"
_BLOCKS = pa.schema([("bucket", pa.int32()), ("many", pa.bool_()), ("keys", pa.binary()), ("owners", pa.binary())])


def bucket_bits(docs: DataFrame, column: str, bytes_per_key: int) -> int:
    """Bits of the bucket number that leave about 2**18 keys in a bucket; up to a million buckets."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return min(20, max(6, int(total // (bytes_per_key << 18)).bit_length()))


def _pack(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(_U)


def handles(digests: np.ndarray) -> np.ndarray:
    return digests & _U((1 << OWNER_BITS) - 1)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: place in the run of equal ones, and length of that run."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(keys)))
    return np.arange(len(keys)) - np.repeat(begin, count), np.repeat(count, count)


def shortened(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a key that postings keep: bucket, key and label."""
    drop, label = _U(64 - KEY_BITS - bits), _U((1 << LABEL_BITS) - 1)
    return ((keys >> drop) & ~label) | (keys & label)


def blocks(
    docs: DataFrame, column: str, bits: int, produce: Callable[[Chunk], tuple[np.ndarray, np.ndarray, np.ndarray]]
) -> DataFrame:
    """Blocks by bucket. ``produce`` gives keys, their rows, and the digests of all rows of a chunk.

    Rows of one digest have the same keys, so each task sends them once.
    """

    def flush(keys: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        place, _ = runs(key)
        over = place > FEW
        rows = []
        if over.any():  # enough stay to tell that they are many
            spread = -1 - int(key[over][0] % _U(1 << bits))
            rows.append((spread, True, _pack(key[over], 8), _pack(owner[over], 5)))
            key, owner = key[~over], owner[~over]
        bucket = (key >> _U(KEY_BITS)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(key))
        rows += [(int(bucket[a]), False, _pack(key[a:b], 5), _pack(owner[a:b], 5)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCKS.names, r, strict=True)) for r in rows], schema=_BLOCKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, owners, held = [], [], 0
        for chunk in chunks(batches, column):
            value, rows, digests = produce(chunk)
            fresh = np.zeros(len(chunk), bool)
            for i, d in enumerate(digests.tolist()):
                if d not in seen:
                    seen.add(d)
                    fresh[i] = True
            use = fresh[rows]
            value, rows = value[use], rows[use]
            if len(value):
                keys.append(shortened(value, bits))
                owners.append(handles(digests[rows]))
                held += len(value)
            if held > _FLUSH:
                yield from flush(keys, owners)
                keys, owners, held = [], [], 0
        if held:
            yield from flush(keys, owners)

    return docs.select(column).mapInArrow(run, SCHEMA)


def gathered(table: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Keys and owners of one bucket, sorted, without repeats; the flag says they are known to be keys of many, unsorted."""
    bucket = table.column("bucket")[0].as_py()
    keys, owners = table.column("keys").to_pylist(), _unpack(table.column("owners").to_pylist(), 5)
    if bucket < 0:
        return True, _unpack(keys, 8), owners
    key = _unpack(keys, 5) | (_U(bucket) << _U(KEY_BITS))
    order = np.lexsort((owners, key))
    key, owner = key[order], owners[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return False, key[new], owner[new]
