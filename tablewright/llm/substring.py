"""Exact substring deduplication against suffix automata of the reference, which is the corpus itself.

A window of 13 words is removed from a document if it also begins in one with a
smaller id. Documents are compared through anchors: the word 5-gram with the smallest hash of
a window, the same wherever the window stands, and shared by neighbouring windows, which
make a segment. Anchors that two different texts have are found by postings; the
segments about them are the reference, dealt into shards by their anchors.
Each shard is a suffix automaton over words whose states know the smallest id that holds them;
segments are streamed through it, and the state of the last 13 words read tells where else they
begin. As a shard is needed only where its anchors are, segments travel to the
automata rather than the automata to all documents: the reference grows with the corpus, so no
broadcast of it is bounded.

Texts of equal words are one class, of which only the smallest id is compared; in
the others every window begins in that one. Segments that a task has twice are settled there.
Shards take rows by ascending id, so what a shard holds is bounded: the segments of a place
that outgrow it are sent on as single windows.

Null and empty texts have no words. Rows with a null id neither lose words nor
take them from others; rows that repeat an id take none from each other. Columns that the input has besides are
left alone, and an empty table gives an empty one.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.chunks import Chunk, appended, covered, mix, packed_texts, windows
from tablewright.llm.postings import LABEL_BITS, OWNER_BITS, blocks, bucket_bits, gathered, runs, shortened
from tablewright.scratch import written

_U = np.uint64
ANCHOR = 5  # words of an anchor
SHARD_WORDS = 20_000  # of distinct segments in one automaton
SHARD_ROWS = 100_000
_BATCH_ROWS = 256
_EMPTY = hashlib.sha256(b"").hexdigest()
SEGMENTS = "place long, segment binary, doc_id long, digest long, at int, n int"
_ROWS = pa.schema(
    [("place", pa.int64()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
)


def word_digests(chunk: Chunk) -> np.ndarray:
    """One hash for the word sequence of each row."""
    offsets = chunk.word_offsets
    with np.errstate(over="ignore"):
        nth = (np.arange(len(chunk.word_hashes)) - offsets[:-1][chunk.word_rows]).astype(_U)
        sums = np.append(np.zeros(1, _U), np.cumsum(mix(chunk.word_hashes + nth * _U(0x9E3779B97F4A7C15))))
        return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(_U))


def anchors(chunk: Chunk, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the anchor of each."""
    size = min(ANCHOR, window)
    at, grams = windows(chunk.word_hashes, chunk.word_offsets, size)
    full = np.full(len(chunk.word_hashes) + window, np.iinfo(np.uint64).max, _U)
    full[at] = grams >> _U(LABEL_BITS) << _U(LABEL_BITS)
    n = len(chunk.word_hashes)
    least = full[:n].copy()
    for k in range(1, window - size + 1):
        np.minimum(least, full[k : k + n], out=least)
    room = chunk.word_offsets[1:][chunk.word_rows] - np.arange(n) >= window
    first = np.flatnonzero(room)
    return first, least[first]


def _new_runs(values: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where consecutive windows of one row change their anchor."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1]) | (first[1:] != first[:-1] + 1)
    return np.flatnonzero(new)


class Automaton:
    """Suffix automaton of word sequences; ``least`` is the smallest id that holds the words of a state."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def add(self, words: list[int], doc: int) -> None:
        steps, link, length, least = self.steps, self.link, self.length, self.least
        last = 0
        for word in words:
            known = steps[last].get(word)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, word, known)
            else:
                new = len(steps)
                steps.append({})
                link.append(0)
                length.append(length[last] + 1)
                least.append(1 << 62)
                p = last
                while p >= 0 and word not in steps[p]:
                    steps[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = steps[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            if doc < least[last]:
                least[last] = doc

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the sequences of ``q`` that end a sequence of ``p`` and ``word``."""
        steps, link = self.steps, self.link
        twin = len(steps)
        steps.append(steps[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.least.append(1 << 62)
        while p >= 0 and steps[p].get(word) == q:
            steps[p][word] = twin
            p = link[p]
        link[q] = twin
        return twin

    def finish(self) -> None:
        """A state holds whatever the states that it ends hold."""
        link, least = self.link, self.least
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]

    def first_holders(self, words: list[int], window: int) -> list[int]:
        """For each window of ``words``, read as a stream, the smallest id that holds it."""
        steps, link, length, least = self.steps, self.link, self.length, self.least
        out, state, matched = [], 0, 0
        for nth, word in enumerate(words):
            while state and word not in steps[state]:
                state = link[state]
                matched = length[state]
            if word in steps[state]:
                state, matched = steps[state][word], matched + 1
            # The state whose sequences end with the last ``window`` words read.
            while state and length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            if nth + 1 >= window:
                out.append(least[state] if matched >= window else 1 << 62)
        return out


def _shards(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans that are removed, as rows without a place; windows of places that outgrow a shard, with a new one.

    Rows come by place and ascending id.
    """
    held: dict[int, dict[bytes, tuple[int, list]]] = {}  # place: segment: smallest id, members
    state = {"words": 0, "rows": 0}
    broken = None  # the place that is sent on
    out: list[tuple] = []

    def settle(carry: int | None) -> None:
        numbers: dict[bytes, int] = {}
        automaton, split = Automaton(), {}
        for segments in held.values():
            for segment, (doc, _) in segments.items():
                split[segment] = [numbers.setdefault(w, len(numbers)) for w in segment.split(b" ")]
                automaton.add(split[segment], doc)
        automaton.finish()
        for segments in held.values():
            for segment, (_, members) in segments.items():
                holders = automaton.first_holders(split[segment], window) if members else []
                for doc, digest, at in members:
                    begin = None
                    for i, holder in enumerate([*holders, 1 << 62]):
                        if holder < doc:
                            begin = i if begin is None else begin
                        elif begin is not None:
                            out.append((None, None, doc, digest, at + begin, i - begin + window - 1))
                            begin = None
        kept = {s: (doc, []) for s, (doc, _) in held[carry].items()} if carry is not None else {}
        held.clear()
        state["words"] = state["rows"] = 0
        if carry is not None:
            held[carry] = kept
            state["words"] = sum(s.count(b" ") + 1 for s in kept)

    def send_on(segment: bytes, members: list) -> None:
        words = segment.split(b" ")
        for i in range(len(words) - window + 1):
            part = b" ".join(words[i : i + window])
            place = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
            out.extend((place, part, doc, digest, at + i, window) for doc, digest, at in members)

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)
        out.clear()
        return batch

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("place", "segment", "doc_id", "digest", "at"))
        for place, segment, doc, digest, at in zip(*columns, strict=True):
            if place == broken:
                send_on(segment, [(doc, digest, at)])
                continue
            if place not in held:
                if state["words"] >= SHARD_WORDS or state["rows"] >= SHARD_ROWS:
                    settle(None)
                held[place] = {}
            segments = held[place]
            if segment in segments:
                segments[segment][1].append((doc, digest, at))
            else:
                segments[segment] = (doc, [(doc, digest, at)])
                state["words"] += segment.count(b" ") + 1
            state["rows"] += 1
            if state["rows"] >= SHARD_ROWS:
                settle(place)
            elif state["words"] >= 2 * SHARD_WORDS and len(segments) > 1:
                size = sum(s.count(b" ") + 1 for s in segments)
                if size >= SHARD_WORDS:  # too many contexts of one anchor
                    broken = place
                    del held[place]
                    state["words"] -= size
                    for s, (first, members) in segments.items():
                        send_on(s, members or [(first, 0, 0)])
        if len(out) >= 20_000:
            yield flushed()
    if held:
        settle(None)
    if out:
        yield flushed()


def _segments(joined: DataFrame, bits: int, window: int) -> DataFrame:
    """Segments about shared anchors of the texts; of those that a task has twice, all but the first are settled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            rows = out + [(p, s, *m, s.count(b" ") + 1) for (p, s), m in seen.items()]
            out.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

        for batch in batches:
            for part in (batch.slice(i, _BATCH_ROWS) for i in range(0, batch.num_rows, _BATCH_ROWS)):
                texts = [open_.decompress(x.as_py()) for x in part.column("packed")]
                offsets = np.append(0, np.cumsum([len(x) for x in texts]))
                chunk = Chunk(part, np.frombuffer(b"".join(texts), np.uint8), offsets)
                docs, digests = part.column("doc_id").to_pylist(), part.column("digest").to_pylist()
                first, anchor = anchors(chunk, window)
                anchor = shortened(anchor, bits)
                rows = chunk.word_rows[first]
                lists = part.column("anchors")
                flat, at = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
                owner = np.repeat(np.arange(len(part)), np.diff(at))
                flat = flat[at[0] : at[-1]]
                # (row, anchor) of windows among those of the lists
                order = np.lexsort((flat, owner))
                with np.errstate(over="ignore"):
                    pairs = np.sort(mix(flat[order] + owner[order].astype(_U) * _U(0x9E3779B97F4A7C15)))
                    mine = mix(anchor + rows.astype(_U) * _U(0x9E3779B97F4A7C15))
                spot = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
                use = np.flatnonzero(pairs[spot] == mine) if len(pairs) else np.zeros(0, np.int64)
                first, anchor, rows = first[use], anchor[use], rows[use]
                edges = np.append(_new_runs(anchor, rows, first), len(first)) if len(first) else np.zeros(1, np.int64)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    row = int(rows[a])
                    begin, end = int(first[a]), int(first[b - 1]) + window
                    segment = b" ".join(chunk.data[chunk.starts[begin] : chunk.ends[end - 1]].tobytes().split())
                    start = begin - int(chunk.word_offsets[row])
                    key, member = (int(anchor[a].view(np.int64)), segment), (docs[row], digests[row], start)
                    known = seen.get(key)
                    if known is None:
                        seen[key] = member
                    elif known[0] == member[0]:  # the same id: neither takes from the other
                        out.append((*key, *member, end - begin))
                    else:
                        seen[key], later = (known, member) if known < member else (member, known)
                        out.append((None, None, *later, end - begin))
                if len(out) + len(seen) > 100_000:
                    yield flushed()
        if out or seen:
            yield flushed()

    return joined.mapInArrow(run, SEGMENTS)


def deduplicate_substrings(docs: DataFrame, window: int = 13, column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each document.

    ``spans`` are the removed places (first word, words), null if nothing or all is
    removed; ``kept_sha256`` is of the kept words joined by one blank.
    """

    def describe(chunk: Chunk) -> dict:
        data, offsets = chunk.data.tobytes(), chunk.offsets.tolist()
        whole = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return {"n_words": np.diff(chunk.word_offsets), "digest": word_digests(chunk).view(np.int64), "whole": whole}

    described = written(appended(docs, "n_words long, digest long, whole string", describe, ["doc_id"], column))
    classes = described.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("handle", F.col("digest").bitwiseAND((1 << OWNER_BITS) - 1)))
    bits = bucket_bits(docs, column, 30)

    def produce(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, anchor = anchors(chunk, window)
        rows = chunk.word_rows[first]
        new = _new_runs(anchor, rows, first)
        return anchor[new], rows[new], word_digests(chunk)

    def shared(table: pa.Table) -> pa.Table:
        known, key, owner = gathered(table)
        keep = np.ones(len(key), bool) if known else runs(key)[1] > 1
        return pa.table({"anchor": pa.array(key[keep].view(np.int64)), "handle": pa.array(owner[keep].view(np.int64))})

    found = blocks(docs.where("doc_id is not null"), column, bits, produce).groupBy("bucket").applyInArrow(shared, "anchor long, handle long")
    lists = found.groupBy("handle").agg(F.collect_set("anchor").alias("anchors"))
    wanted = classes.where("first is not null").join(lists, "handle").select(F.col("first").alias("doc_id"), "digest", "anchors")
    # Rows that repeat an id and its words are one.
    texts = packed_texts(docs, column, word_digests).join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    texts = written(texts.select("doc_id", "digest", "packed", "anchors"))
    segments = written(_segments(texts, bits, window))

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shards(batches, window)

    spans, todo = segments.where("place is null"), segments.where("place is not null")
    while True:
        # Windows that are sent on make places of one segment, so the second round is the last.
        dealt = todo.repartition("place").sortWithinPartitions("place", "doc_id", "digest", "at")
        settled = written(dealt.mapInArrow(shards, SEGMENTS))
        spans = spans.union(settled.where("place is null"))
        todo = settled.where("place is not null")
        if not todo.take(1):
            break

    removed = spans.groupBy("digest").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            names = ["digest", "n_removed", "kept_sha256", "spans"]
            out: dict[str, list] = {c: [] for c in names}
            for digest, packed, taken in zip(*(batch.column(c).to_pylist() for c in ("digest", "packed", "spans")), strict=True):
                words = open_.decompress(packed).split()
                at = np.array([s["at"] for s in taken], np.int64)
                n = np.array([s["n"] for s in taken], np.int64)
                gone = covered(at, n, len(words))
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                row = (digest, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
                for c, v in zip(names, (*row, [{"at": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]), strict=True):
                    out[c].append(v)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, types, strict=True)], names=names)

    reduced = texts.select("digest", "packed").join(removed, "digest").mapInArrow(
        cut, "digest long, n_removed long, kept_sha256 string, spans array<struct<at:int,n:int>>"
    )
    out = described.join(classes.select("digest", "first"), "digest", "left").join(reduced, "digest", "left")
    copy = F.col("doc_id") > F.col("first")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).when(F.col("doc_id").isNull(), F.col("whole")).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(~copy, F.col("spans")).alias("spans"),
    )
