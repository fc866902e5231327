"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Words, with ASCII letters in lower case, are the symbols. Three steps, all inside the
tasks that read the documents:

1. Windows as long as an item begin where a run of the item's words in the
   document points to. An item within ``max_edits`` of a passage shares a known
   number of word triples with it, so windows with fewer are no candidates.
2. The random-walk embedding turns window and item into strings of three times the
   length, where few edits become few differences; samples of places of several
   walks are keys, and a window meets the items of its length that share a key. How many walks
   a length takes follows from the recall asked for, measured on drawn pairs with all edits allowed;
   a length that would take more than ``MOST_WALKS`` goes without keys, so all its windows are aligned.
3. The edit distance of the item and the best stretch of text about its windows decides. Stretches
   that overlap are aligned as one, many at a time, and given up once the distance is too large.

The index of the items is broadcast. Its size is checked first: benchmarks beyond
``block_bytes`` are worked through in blocks, each a pass over the documents.

Null and empty texts and items match nothing. Items of fewer than three words must occur whole.
Repeated items are found under each of their ids, repeated documents one by one; an empty table on either
side gives no matches. Columns that the input has besides are left alone.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.chunks import Chunk, appended, chunks, mix, windows

MATCHES = "doc_id long, item_id long, start_word long, n_words long, edits long"
GRAM = 3
_U = np.uint64
_FILTER = 1 << 22
MOST_WALKS = 48
_STEP_WORDS = 20  # lengths are told apart in steps of so many words when walks are counted
_ALIGNED = 1 << 19  # cells that are aligned together
_MERGED = 1 << 15  # words of stretches that are aligned as one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Items:
    """Benchmark items: their ids, words, word triples, and keys of their embeddings."""

    ids: list[int]
    words: list[np.ndarray]
    edits: np.ndarray  # most edits allowed, by item
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by size: sorted hashes, item, place in it
    filters: dict[int, np.ndarray]  # by size: whether a hash with these low bits is there
    keys: dict[tuple[int, int, int], list[int]]  # (length, walk, key) to items
    walks: dict[int, int]  # by length; 0 for lengths without keys
    samples: int


def walk_keys(sequences: list[np.ndarray], lengths: np.ndarray, walks: int, samples: int) -> np.ndarray:
    """Keys of shape (walks, sequences).

    Each walk goes over a sequence of n words in 3n steps: at each step the word it
    stands on is written, and a bit drawn for walk, step and word says whether
    to go on to the next. A key is a hash of what was written at ``samples`` steps,
    drawn for the walk as parts of 3n.
    """
    rows, most = len(sequences), int(lengths.max())
    padded = np.zeros((rows, most + 1), _U)  # behind the end stands 0, for good
    for i, sequence in enumerate(sequences):
        padded[i, : len(sequence)] = sequence
    drawn = np.random.default_rng(20).random((walks, 1, samples))
    taken = np.floor(drawn * (3 * lengths[None, :, None])).astype(np.int64)
    at, row = np.zeros((walks, rows), np.int64), np.arange(rows)[None, :]
    keys = np.zeros((walks, rows), _U)
    with np.errstate(over="ignore"):
        salt = mix(np.arange(walks, dtype=_U))[:, None]
        for step in range(int(taken.max()) + 1):
            word = padded[row, at]
            for k in range(samples):
                here = taken[:, :, k] == step
                if here.any():
                    keys = np.where(here, mix(keys * _U(0xD1342543DE82EF95) + word), keys)
            bit = mix(word + salt + _U(step * 0x9E3779B97F4A7C15 % 2**64)) >> _U(63)
            at = np.minimum(at + bit.astype(np.int64), lengths[None, :])
    return keys


def _chunk_lower(batch: pa.RecordBatch, column: str) -> Iterator[Chunk]:
    for chunk in chunks([batch], column):
        yield Chunk(chunk.rows, _LOWER[chunk.data], chunk.offsets)


def walks_for(length: int, max_edits: float, samples: int, recall: float, pairs: int = 48) -> int:
    """The fewest walks by which windows with all allowed edits meet their item in a share of ``recall``; 0 if ``MOST_WALKS`` do not do.

    Measured on drawn pairs of one length, half of the edits replaced words and the others as many dropped as added ones.
    """
    draw = np.random.default_rng(length)
    edits = int(max_edits * length)
    if length < GRAM or not edits:
        return 1
    one = draw.integers(1, 1 << 62, (pairs, length)).astype(_U)
    two = []
    for words in one:
        held = words.tolist()
        moved = edits // 4
        for at in sorted(draw.choice(length, moved, replace=False).tolist(), reverse=True):
            del held[at]
        for at in draw.choice(length, moved).tolist():
            held.insert(at % (len(held) + 1), int(draw.integers(1, 1 << 62)))
        for at in draw.choice(length, edits - 2 * moved, replace=False).tolist():
            held[at] = int(draw.integers(1, 1 << 62))
        two.append(np.array(held, _U))
    lengths = np.full(pairs, length)
    met = walk_keys(list(one), lengths, MOST_WALKS, samples) == walk_keys(two, lengths, MOST_WALKS, samples)
    share = np.logical_or.accumulate(met, 0).mean(1)
    enough = np.flatnonzero(share >= recall)
    return int(enough[0]) + 1 if len(enough) else 0


def index_items(rows: list[tuple[int, str]], max_edits: float, recall: float, samples: int) -> Items:
    ids, words = [], []
    batch = pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    for chunk in _chunk_lower(batch, "text"):
        for i, (a, b) in enumerate(zip(chunk.word_offsets[:-1], chunk.word_offsets[1:], strict=True)):
            if b > a:
                ids.append(chunk.rows.column("id")[i].as_py())
                words.append(chunk.word_hashes[a:b])
    edits = np.array([0 if len(w) < GRAM else int(max_edits * len(w)) for w in words], np.int64)
    by_size, keys = defaultdict(list), defaultdict(list)
    for i, w in enumerate(words):
        size = min(GRAM, len(w))
        at, grams = windows(w, np.array([0, len(w)]), size)
        by_size[size].append((grams, np.full(len(at), i), at))
    classes = {-(-len(w) // _STEP_WORDS) * _STEP_WORDS for w in words}
    needed = {most: walks_for(most, max_edits, samples, recall) for most in sorted(classes)}
    walks = {len(w): needed[-(-len(w) // _STEP_WORDS) * _STEP_WORDS] for w in words}
    keyed = [i for i, w in enumerate(words) if walks[len(w)]]
    if keyed:
        lengths = np.array([len(words[i]) for i in keyed])
        most = max(walks[len(words[i])] for i in keyed)
        for walk, drawn in enumerate(walk_keys([words[i] for i in keyed], lengths, most, samples).tolist()):
            for i, key in zip(keyed, drawn, strict=True):
                if walk < walks[len(words[i])]:
                    keys[len(words[i]), walk, key].append(i)
    grams, filters = {}, {}
    for size, found in by_size.items():
        h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        grams[size] = (h[order], item[order], at[order])
        filters[size] = np.zeros(_FILTER, bool)
        filters[size][(h % _U(_FILTER)).astype(np.int64)] = True
    return Items(ids, words, edits, grams, filters, dict(keys), walks, samples)


def best_stretches(items: list[np.ndarray], texts: list[np.ndarray], allowed: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each item and text: least edit distance of the item and a stretch of the text, and where that begins and ends; none if above ``allowed``.

    A column of all alignments is made at once: cost and begin of the best stretch that ends at each place.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    order = sorted(range(len(items)), key=lambda p: len(texts[p]))
    while order:
        width = len(texts[order[-1]]) + 1
        take, order = order[-max(1, _ALIGNED // width) :], order[: -max(1, _ALIGNED // width)]
        length = np.array([len(items[p]) for p in take])
        wanted = np.zeros((len(take), int(length.max(initial=0)) + 1), _U)
        held = np.zeros((len(take), width - 1), _U)
        for row, p in enumerate(take):
            wanted[row, : len(items[p])] = items[p]
            held[row, : len(texts[p])] = texts[p]
        size, most, live = np.array([len(texts[p]) for p in take]), allowed[take], np.arange(len(take))
        outside = np.arange(width) > size[:, None]
        shift = 1 << 31
        cost = np.where(outside, shift, 0).astype(np.int64)
        begin, place = np.broadcast_to(np.arange(width), cost.shape).copy(), np.arange(width, dtype=np.int64)
        for i in range(1, wanted.shape[1] + 1):
            done = np.flatnonzero(length[live] < i)
            for row in done.tolist():
                end = int(cost[row].argmin())
                if cost[row, end] <= most[live[row]]:
                    out[take[live[row]]] = (int(cost[row, end]), int(begin[row, end]), end)
            keep = (length[live] >= i) & (cost.min(1) <= most[live])
            if not keep.all():
                live, cost, begin, outside = live[keep], cost[keep], begin[keep], outside[keep]
            if not len(live):
                break
            swap = cost[:, :-1] + (held[live] != wanted[live, i - 1][:, None])
            drop = cost[:, 1:] + 1
            dropped = drop < swap
            new, start = np.empty_like(cost), np.empty_like(begin)
            new[:, 0], start[:, 0] = i, 0
            new[:, 1:], start[:, 1:] = np.where(dropped, drop, swap), np.where(dropped, begin[:, 1:], begin[:, :-1])
            # words added to the text: the best of all places before, each a cost of one further off; of equal ones the nearest
            reach = np.minimum.accumulate((new - place + width) * shift + (width - place), axis=1)
            near = width - (reach & (shift - 1))
            cost = np.take_along_axis(new, near, 1) + place - near
            cost[outside] = shift
            begin = np.take_along_axis(start, near, 1)
    return out


def _windows(chunk: Chunk, items: Items) -> set[tuple[int, int, int]]:
    """Candidate windows as (row, first word, item)."""
    found: set[tuple[int, int, int]] = set()
    for size, (hashes, owner, place) in items.grams.items():
        at, grams = chunk.windows(size)
        likely = np.flatnonzero(items.filters[size][(grams % _U(_FILTER)).astype(np.int64)])
        at, grams = at[likely], grams[likely]
        low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
        many = high - low
        hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        item, start = owner[hit], at - place[hit]
        row = chunk.word_rows[at]
        order = np.lexsort((start, item, row))
        row, item, start = row[order], item[order], start[order]
        if not len(row):
            continue
        lengths = np.array([len(w) for w in items.words])
        # At least so many of the triples of an item survive its edits.
        need = np.maximum(1, lengths - size + 1 - size * items.edits)
        group = (row * len(lengths) + item) * (1 << 32) + start + (1 << 16)
        near = items.edits[item]
        count = np.searchsorted(group, group + near, "right") - np.searchsorted(group, group - near, "left")
        keep = count >= need[item]
        for r, i, s in zip(row[keep].tolist(), item[keep].tolist(), start[keep].tolist(), strict=True):
            first = max(s, int(chunk.word_offsets[r]))
            found.add((r, first, i))
    return found


def matches(chunk: Chunk, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word in its text, words, edits), the best place for each row and item."""
    words, offsets = chunk.word_hashes, chunk.word_offsets
    windows_ = _windows(chunk, items)
    if not windows_:
        return []
    size = [len(w) for w in items.words]
    met: set[tuple[int, int, int]] = {w for w in windows_ if not items.walks[size[w[2]]]}
    places = sorted({(row, start, size[item]) for row, start, item in windows_ if items.walks[size[item]]})
    if places:
        # A window that the end of its text cuts off is filled up.
        held = [words[start : min(start + length, offsets[row + 1])] for row, start, length in places]
        drawn = walk_keys(held, np.array([p[2] for p in places]), max(items.walks[p[2]] for p in places), items.samples)
        for walk, keys in enumerate(drawn.tolist()):
            for (row, start, length), key in zip(places, keys, strict=True):
                for item in items.keys.get((length, walk, key), ()):
                    met.add((row, start, item))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    stretches: dict[tuple[int, int], list[list[int]]] = defaultdict(list)
    for row, start, item in sorted(met):
        allowed, wanted = int(items.edits[item]), items.words[item]
        a = max(int(offsets[row]), start - allowed)
        b = min(int(offsets[row + 1]), start + len(wanted) + allowed)
        if start + len(wanted) <= b and (words[start : start + len(wanted)] == wanted).all():
            best.setdefault((row, item), (0, start - int(offsets[row]), len(wanted)))
            continue
        have = stretches[row, item]
        if have and a <= have[-1][1] and b - have[-1][0] <= max(_MERGED, 2 * len(wanted)):
            have[-1][1] = max(have[-1][1], b)
        else:
            have.append([a, b])
    wanted = [(key, a, b) for key, have in stretches.items() if key not in best for a, b in have]
    found = best_stretches(
        [items.words[item] for (_, item), _, _ in wanted], [words[a:b] for _, a, b in wanted], items.edits[[item for (_, item), _, _ in wanted]]
    )
    for ((row, item), a, _), stretch in zip(wanted, found, strict=True):
        if stretch:
            edits, begin, end = stretch
            place = (edits, a + begin - int(offsets[row]), end - begin)
            best[row, item] = min(best.get((row, item), place), place)
    return [(row, item, start, n, edits) for (row, item), (edits, start, n) in sorted(best.items())]


def _blocks(benchmark: DataFrame, max_edits: float, recall: float, samples: int, block_bytes: int) -> Iterator[Broadcast]:
    spark = benchmark.sparkSession
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = [tuple(r) for r in part.collect()]  # about block_bytes
        items = index_items(sorted(held), max_edits, recall, samples)
        if items.ids:
            yield spark.sparkContext.broadcast(vars(items))  # plain data, as executors may lack this package


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edits: float = 0.2,
    recall: float = 0.98,
    samples: int = 3,
    block_bytes: int = 8 << 20,
    column: str = "text",
) -> DataFrame:
    """A row for each document and benchmark item (``item_id``, ``text``) it holds within ``max_edits`` of the item's words."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for shared in _blocks(benchmark, max_edits, recall, samples, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = Items(**shared.value)
            for batch in batches:
                for chunk in _chunk_lower(batch, column):
                    found = matches(chunk, items)
                    if found:
                        row, item, start, n, edits = (list(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": chunk.rows.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                                "item_id": pa.array([items.ids[i] for i in item], pa.int64()),
                                "start_word": pa.array(start, pa.int64()),
                                "n_words": pa.array(n, pa.int64()),
                                "edits": pa.array(edits, pa.int64()),
                            }
                        )

        out = out.union(docs.select("doc_id", column).mapInArrow(run, MATCHES))
    return out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edits: float = 0.2,
    recall: float = 0.98,
    samples: int = 3,
    block_bytes: int = 8 << 20,
    column: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; nothing is shuffled."""
    columns = docs.columns
    for shared in _blocks(benchmark, max_edits, recall, samples, block_bytes):

        def clean(chunk: Chunk, shared: Broadcast = shared) -> dict[str, np.ndarray]:
            lowered = Chunk(chunk.rows, _LOWER[chunk.data], chunk.offsets)
            out = np.ones(len(chunk), bool)
            out[[m[0] for m in matches(lowered, Items(**shared.value))]] = False
            return {"_clean": out}

        docs = appended(docs, "_clean boolean", clean, columns, column).where("_clean").select(*columns)
    return docs
