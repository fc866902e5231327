"""Vector best-fit packing of documents into sequences.

Each sequence has a capacity of tokens, of documents and of attention cost (the
sum of squared lengths). What a piece takes of each follows from its length
alone, so the pieces of one length are interchangeable: the driver needs only the
number of pieces of each length, at most one number per possible length
whatever the corpus holds. It packs those counts, longest first, each time into the
open sequences with the best score among those with room under every
constraint, and describes the outcome as runs: so many pieces of one length,
so many in each sequence, from this place on. Ranking the pieces of each length
and looking a rank up in the runs is then all that the tasks do.

Null and empty texts become one piece that holds the end id. Repeated rows are
packed as often as they stand there, null ids stay null, columns that the input
has besides are left out, and an empty table gives an empty one.
"""

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.errors import OperationError
from tablewright.llm.chunks import chunks
from tablewright.llm.tokens import TOKEN_CHUNK, encoder
from tablewright.scratch import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = False, column: str = "text"
) -> DataFrame:
    """Pieces of at most ``size`` tokens of each text with the end id behind it; ``with_ids`` adds the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for chunk in chunks(batches, column, TOKEN_CHUNK):
            ids, offsets = tokens.encode_chunk(chunk, end_id)
            ids = ids.astype("<u4")
            n = np.diff(offsets)
            pieces = -(-n // size)
            rows = np.repeat(np.arange(len(chunk)), pieces)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            begin = offsets[rows] + start
            length = np.minimum(n[rows] - start, size)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            out = {
                "doc_id": chunk.rows.column("doc_id").cast(pa.int64()).take(pa.array(rows)),
                "piece": piece.astype(np.int32),
                "start": start,
                "length": length,
                "ids_crc32": np.array(crc, np.int64),
            }
            if with_ids:
                at = np.append(begin, offsets[-1]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)
        tokens.rest()

    return docs.select("doc_id", column).mapInArrow(run, schema)


def pack_counts(
    counts: dict[int, int],
    max_tokens: int,
    max_documents: int,
    max_attention: int,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
) -> np.ndarray:
    """Runs (length, first rank, pieces in each sequence, sequences, first sequence, offset) that place all pieces.

    ``rule`` is ``norm``, the smallest weighted norm of what is left after
    placing, or ``dot``, the largest weighted product of what is left and
    what the piece takes. A chosen sequence gets pieces of the same length
    as long as they fit.
    """
    if rule not in ("norm", "dot"):
        raise OperationError(f"no rule {rule!r}")
    capacity = np.array([max_tokens, max_documents, max_attention], float)
    scale = np.array(weights) / capacity**2
    # Open sequences in groups alike: what is left of each capacity, how many, the first one's number.
    left, many, first = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, opened = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        takes = np.array([length, 1, length * length], float)
        if (takes > capacity).any():
            raise OperationError(f"a piece of {length} tokens fits no sequence")
        todo, rank = counts[length], 0
        usable = left[:, 0] >= 1
        left, many, first = left[usable], many[usable], first[usable]
        room = (left >= takes).all(axis=1)
        after = left - takes
        score = (scale * after * after).sum(axis=1) if rule == "norm" else -(scale * left * takes).sum(axis=1)
        order = np.flatnonzero(room)
        order = order[np.lexsort((first[order], score[order]))]
        made: list[tuple[np.ndarray, int, int]] = []
        used = np.zeros(len(many), bool)
        for g in [*order.tolist(), -1]:
            if not todo:
                break
            if g < 0:  # new sequences
                have = capacity
                each = int((capacity // takes).min())
                count, at = -(-todo // each), opened
                opened += count
            else:
                have, count, at = left[g], int(many[g]), int(first[g])
                each = int((have // takes).min())
                used[g] = True
            offset = int(max_tokens - have[0])
            whole = min(count, todo // each)
            if whole:
                runs.append((length, rank, each, whole, at, offset))
                made.append((have - each * takes, whole, at))
                rank += whole * each
                todo -= whole * each
            if whole < count and todo:
                part = todo  # fewer than ``each``: they go to one sequence
                runs.append((length, rank, part, 1, at + whole, offset))
                made.append((have - part * takes, 1, at + whole))
                rank, todo, whole = rank + part, 0, whole + 1
            if whole < count:
                made.append((have, count - whole, at + whole))
        left = np.concatenate([left[~used], np.array([m[0] for m in made]).reshape(-1, 3)])
        many = np.concatenate([many[~used], np.array([m[1] for m in made], np.int64)])
        first = np.concatenate([first[~used], np.array([m[2] for m in made], np.int64)])
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(
    pieces: DataFrame,
    max_tokens: int,
    max_documents: int | None = None,
    max_attention: int | None = None,
    rule: str = "norm",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; by default only the tokens are limited.

    The pieces are written once and then again with their task and their rank among the
    pieces of the same length in that task, so the numbering survives lost executors. Numbering them while
    they are made would keep two Python workers at each core.
    """
    schema = StructType([f for f in pieces.schema.fields if f.name not in ("task", "nth", "base", "sequence_id", "offset")])
    names = schema.names

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(max_tokens + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            if len(length) and length.max() > max_tokens:
                raise ValueError(f"a piece of {length.max()} tokens fits no sequence")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            begin = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - begin + seen[ordered]
            seen += np.bincount(length, minlength=max_tokens + 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.full(len(length), task, np.int32)), pa.array(nth)],
                names=[*names, "task", "nth"],
            )

    numbered = written(written(pieces.select(*names)).mapInArrow(number, schema.simpleString()[7:-1] + ",task:int,nth:bigint"))
    by_task = numbered.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # At most one row for each possible length.
    counts = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = pack_counts(counts, max_tokens, max_documents or max_tokens, max_attention or max_tokens**2, rule)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    span = np.int64(1) << np.int64(44)  # ranks of one length stay below this
    keys = runs[:, 0] * span + runs[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((keys, runs))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            run = runs[np.searchsorted(keys, length * span + rank, "right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names),
                    pa.array(run[:, 4] + nth // np.maximum(run[:, 2], 1)),
                    pa.array(run[:, 5] + nth % np.maximum(run[:, 2], 1) * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    joined = numbered.join(bases, ["task", "length"]).select(*names, "nth", "base")
    return joined.mapInArrow(place, schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint")
