"""Whole texts of Arrow batches as flat byte arrays, and the words and word windows in them.

A batch is cut between rows into chunks of a few megabytes, so that what a
task holds does not grow with the batch; one very long text is a chunk of its
own. Words are runs of bytes other than blank and \\x09-\\x0D.
"""

from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 20
_HASH_BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BYTE = U(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_BYTE_INVERSE = U(pow(int(_BYTE), -1, 1 << 64))
_WORD = U(0xD1342543DE82EF95)


def small_batches(spark: SparkSession) -> None:
    """Set the session to send texts to Python a thousand at a time; the usual ten thousand take
    tens of megabytes on either side, twice over, for each core.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + _STEP
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix(np.arange(256, dtype=U))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def binary(column: pa.Array) -> pa.Array:
    """A text column as large binary, null as empty."""
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


class Chunk:
    """Some rows of a batch with their texts as one byte array."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def ids(self, column: str = "doc_id") -> np.ndarray:
        """An integer column as int64; null as the largest integer."""
        return self.rows.column(column).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.empty(len(self.data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(IS_SPACE[self.data], out=inside[1:-1])
        here = inside[1:-1]
        starts, ends = here & ~inside[:-2], here & ~inside[2:]
        full = self.offsets[:-1] < self.offsets[1:]
        first, last = self.offsets[:-1][full], self.offsets[1:][full] - 1
        starts[first] = here[first]
        ends[last] = here[last]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self._bounds[1]

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Row i has the words word_offsets[i] to word_offsets[i + 1]."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_offsets))

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return hashed(self.data, self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of ``size`` words inside one row: the place of the first word, and a hash."""
        return windows(self.word_hashes, self.word_offsets, size)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total, weight = np.zeros(n, U), U(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += hashes[k : k + n] * weight
            weight *= _WORD
        total = mix(total)
    ok = np.zeros(n + size, bool)  # not over the end of a row
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    rows = np.flatnonzero(counts)
    steps = np.zeros(n + size, np.int8)
    steps[offsets[rows]] += 1
    np.subtract.at(steps, offsets[rows] + counts[rows], 1)
    ok = np.cumsum(steps, dtype=np.int8)[:n].astype(bool)
    at = np.flatnonzero(ok)
    return at, total[at]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which ascend and do not overlap."""
    out = np.empty(len(starts), U)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            base = starts[done]
            upto = max(done + 1, int(np.searchsorted(ends, base + _HASH_BLOCK, "right")))
            part = data[base : ends[upto - 1]]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE_VALUES[part] * _powers(_BYTE, len(part)), out=sums[1:])
            s, e = starts[done:upto] - base, ends[done:upto] - base
            out[done:upto] = (sums[e] - sums[s]) * _powers(_BYTE_INVERSE, len(part))[s] + (e - s).astype(U)
            done = upto
        return mix(out)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    for batch in batches:
        texts = binary(batch.column(column))
        if not len(texts):
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Chunk(batch.slice(at, upto - at), data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
            at = upto


def covered(at: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans that begin at ``at``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + lengths, 1)
    return np.cumsum(change[:-1]) > 0


def appended(
    docs: DataFrame,
    fields: str,
    measure: Callable[[Chunk], dict],
    keep: list[str] | None = None,
    column: str = "text",
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``docs`` with the columns of ``fields`` that ``measure`` gives for each chunk, without a shuffle.

    ``keep`` names the input columns to return, by default all; one with the
    name of a new column gives way to it.
    """
    new = StructType.fromDDL(fields)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    schema = StructType([docs.schema[c] for c in kept] + new.fields)
    used = docs.select(*dict.fromkeys([*kept, column, *(["doc_id"] if "doc_id" in docs.columns else [])]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column, limit):
            made = measure(chunk)
            arrays = [chunk.rows.column(c) for c in kept]
            arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[f] for f in new.names)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new.names])

    return used.mapInArrow(run, schema)


def packed_texts(docs: DataFrame, column: str, digests: Callable[[Chunk], np.ndarray] | None = None) -> DataFrame:
    """(doc_id, packed) and, if given, ``digests``: the texts compressed, for shuffles; with digests, each task has an id and digest once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        seen: set[tuple] = set()
        for chunk in chunks(batches, column):
            ids = chunk.rows.column("doc_id").cast(pa.int64())
            data, offsets = chunk.data.tobytes(), chunk.offsets.tolist()
            rows = list(range(len(chunk)))
            columns = {"doc_id": ids}
            if digests is not None:
                columns["digest"] = pa.array(digests(chunk).view(np.int64))
                keys = list(zip(ids.to_pylist(), columns["digest"].to_pylist(), strict=True))
                rows = [i for i in rows if keys[i] not in seen and not seen.add(keys[i])]
                columns = {c: x.take(pa.array(rows, pa.int64())) for c, x in columns.items()}
            columns["packed"] = pa.array([squeeze.compress(data[offsets[i] : offsets[i + 1]]) for i in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    fields = "doc_id long, packed binary" if digests is None else "doc_id long, digest long, packed binary"
    return docs.select("doc_id", column).mapInArrow(run, fields)
