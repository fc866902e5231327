"""The trie of all prefixes of conversations, with members, children, leaves and shared bytes of every node.

A prefix is named by a signature: the sums, modulo 2**64, of two hashes of each of its turns that know
the turn's place. Such sums run over sorted ranges, so one conversation of any length spreads over
many tasks. Each task inserts its conversations into a z-fast trie: compacted nodes are hashed at the
two-fattest depth of their edge, and a fat binary search over a conversation's signatures finds the
node where it leaves the trie. What a task has inserted is expanded, edge by edge, into
one row a prefix, and the rows of all tasks are added up by signature.

What lies below a node needs no walk: the smallest member of a node stays the smallest in every deeper node that it belongs to, so
a conversation owns all its prefixes from one depth on. Leaves and saved bytes of a node
are therefore sums over its members, of one number each.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablewright.scratch import written

_SEGMENT = 1 << 16  # turns; a longer conversation is inserted in several segments
_HELD = 1 << 19  # turns in a task's trie before it is expanded and begun anew
_BLOB = 1 << 15  # bytes of member ids that travel as one row


def running(frame: DataFrame, key: str, near: list[Column], order: list[Column], columns: list[Column], add: list[str]) -> DataFrame:
    """``columns`` of ``frame``, sorted, with the running count of rows of a key as ``place`` and running sums of ``add`` as ``sum_…``.

    Rows are dealt by ranges of ``key`` and ``near`` and sorted by ``order`` within a key, so a key of any
    size spreads over many tasks. A task sums up its own rows; what the key that it begins with has in
    earlier tasks is one row a task, added up by the driver. Sums are modulo 2**64.
    """
    ranged = frame.repartitionByRange(F.col(key), *near).sortWithinPartitions(F.col(key), *order).select(*columns)
    sums = ["place", *(f"sum_{c}" for c in add)]
    schema = StructType([*ranged.schema.fields, StructField("part", IntegerType()), *(StructField(s, LongType()) for s in sums)])
    names = [*ranged.columns, "part", *sums]

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, totals = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            heads = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            lengths = np.diff(np.append(heads, len(keys)))
            made = []
            for s, c in zip(sums, [None, *add], strict=True):
                x = np.ones(len(keys), np.int64) if c is None else batch.column(c).to_numpy()
                upto = np.cumsum(x)
                upto -= np.repeat(upto[heads] - x[heads], lengths)
                if keys[0] == last:
                    upto[: lengths[0]] += totals[s]
                totals[s] = upto[-1]
                made.append(upto)
            last = keys[-1]
            arrays = [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *map(pa.array, made)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    table = written(ranged.mapInArrow(local, schema))
    ends = table.groupBy("part").agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.max(F.struct(F.col(key), *(F.col(s) for s in sums))).alias("end")
    )
    carry: dict[int, tuple[int, list[int]]] = {}
    before: tuple[int, list[int]] | None = None
    for row in sorted(ends.collect(), key=lambda r: r.part):  # one row a task
        own = [row.end[s] for s in sums]
        if before and before[0] == row.low:
            carry[row.part] = before
            if row.low == row.high:
                own = [(a + b + 2**63) % 2**64 - 2**63 for a, b in zip(own, before[1], strict=True)]
        before = (row.high, own)
    if not carry:
        return table.drop("part")

    def carried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch.column(key).to_numpy(), batch.column("part").to_numpy()
            made = {s: batch.column(s).to_numpy().copy() for s in sums}
            for part in np.unique(parts).tolist():
                if part in carry:
                    here = (parts == part) & (keys == carry[part][0])
                    for s, x in zip(sums, carry[part][1], strict=True):
                        made[s][here] += np.int64(x)
            yield pa.RecordBatch.from_arrays([pa.array(made[f]) if f in made else batch.column(f) for f in out], names=out)

    fields = [f for f in schema.fields if f.name != "part"]
    out = [f.name for f in fields]
    return table.mapInArrow(carried, StructType(fields))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, w1, w2, bytes): turns in order, with two hashes of role and text, and the text's UTF-8 length.

    Order is by turn, null first, then by role and text. Null roles and texts are empty. Rows without a conv_id are of no
    conversation and are left out; repeated rows are turns of their own.
    """
    used = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turn = F.col("turn").asc_nulls_first()
    columns = [
        F.col("conv_id"),
        F.xxhash64(F.lit(1), "role", "text").alias("w1"),
        F.xxhash64(F.lit(2), "role", "text").alias("w2"),
        F.octet_length("text").cast("long").alias("bytes"),
    ]
    return running(used, "conv_id", [turn], [turn, F.col("role"), F.col("text")], columns, [])


def spliced(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as that of the multiple of ``every`` at or before them (towards 0): (turns, conversations).

    Conversation c has the first h turns of conversation c - c % every, all if those are fewer, none if there is no such conversation, then its own turns
    behind its first h, with h the CRC-32 of c in decimal modulo ``most``. Turns are (conv_id, pos from 1, w1, w2, bytes),
    conversations (conv_id, length).
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    counts = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = written(
        counts.withColumn("base", base)
        .join(bases, "base", "left")
        .select("conv_id", "own", head, F.coalesce("has", F.lit(0)).alias("has"))
        .select("conv_id", "h", F.least("h", "has").alias("taken"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"))
    )
    word = ["w1", "w2", "bytes"]
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("pos"), *word)
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % every == 0))
    shared = heads.select(F.col("conv_id").alias("base"), "place", *word, F.explode(F.sequence(F.lit(1 - every), F.lit(every - 1))).alias("k"))
    shared = shared.select(F.try_add("base", "k").alias("conv_id"), "base", F.col("place").alias("pos"), *word).where(base == F.col("base"))
    shared = shared.join(convs.select("conv_id", "h"), "conv_id").where("pos <= h").select("conv_id", "pos", *word)
    return own.unionByName(shared), convs.select("conv_id", (F.col("taken") + F.col("rest")).alias("length"))


def fattest(low: int, high: int) -> int:
    """The number above ``low`` and up to ``high`` that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """The compacted trie of segments of conversations.

    A segment holds signatures for the depths from its first one on; segments that begin at the same depth share a trie.
    The edge of a node covers the depths above ``start`` up to ``end``.
    """

    def __init__(self):
        self.start: list[int] = []
        self.end: list[int] = []
        self.up: list[int] = []
        self.rows: list[tuple] = []  # first depth, signatures, columns of the segment that made the node
        self.members: list[int] = []  # that end here, as whole segments
        self.least: list[int] = []
        self.ends: list[int] = []  # of these, whole conversations
        self.handles: dict[tuple, int] = {}
        self.first: dict[tuple, int] = {}
        self.held = 0

    def _name(self, node: int, depth: int) -> tuple:
        begin, signatures, _ = self.rows[node]
        return begin, signatures[depth - begin]

    def _common(self, node: int, begin: int, signatures: list, low: int, high: int) -> int:
        """The last depth from ``low`` (known) to ``high`` that the node's edge shares."""
        while low < high:
            middle = (low + high + 1) // 2
            if self._name(node, middle)[1] == signatures[middle - begin]:
                low = middle
            else:
                high = middle - 1
        return low

    def locate(self, begin: int, signatures: list) -> tuple[int, int]:
        """The exit node of a segment, -1 for the root, and the depth up to which the two agree."""
        node, low, high = -1, begin - 1, begin - 1 + len(signatures)
        top = high
        while low < high:
            depth = fattest(low, high)
            found = self.handles.get((begin, signatures[depth - begin]))
            if found is None:
                high = depth - 1
                continue
            end = self.end[found]
            if end > top or self._name(found, end)[1] != signatures[end - begin]:
                return found, self._common(found, begin, signatures, depth, min(end, top))
            node, low = found, end
        if low < top:
            child = self.first.get((begin, signatures[low + 1 - begin]))
            if child is not None:
                return child, self._common(child, begin, signatures, low + 1, min(self.end[child], top))
        return node, low

    def _new(self, start: int, end: int, up: int, rows: tuple) -> int:
        node = len(self.start)
        for held, value in ((self.start, start), (self.end, end), (self.up, up), (self.rows, rows), (self.members, 0), (self.least, 2**63 - 1), (self.ends, 0)):
            held.append(value)
        self._enter(node)
        return node

    def _enter(self, node: int) -> None:
        self.first[self._name(node, self.start[node] + 1)] = node
        self.handles[self._name(node, fattest(self.start[node], self.end[node]))] = node

    def _split(self, node: int, depth: int) -> int:
        """A new node between the parent and ``node``, with its extent ending at ``depth``."""
        del self.handles[self._name(node, fattest(self.start[node], self.end[node]))]
        upper = self._new(self.start[node], depth, self.up[node], self.rows[node])
        self.start[node], self.up[node] = depth, upper
        self._enter(node)
        return upper

    def insert(self, conv: int, begin: int, signatures: list, columns: dict, whole: bool) -> None:
        node, depth = self.locate(begin, signatures)
        top = begin - 1 + len(signatures)
        if node >= 0 and depth < self.end[node]:
            node = self._split(node, depth)
        if depth < top:
            node = self._new(depth, top, node, (begin, signatures, columns))
            self.held += len(signatures)
        self.members[node] += 1
        self.ends[node] += whole
        self.least[node] = min(self.least[node], conv)

    def expanded(self) -> dict[str, np.ndarray]:
        """A row for each depth of each edge, with members and the smallest of them from here on."""
        members, least = list(self.members), list(self.least)
        for node in sorted(range(len(self.end)), key=self.end.__getitem__, reverse=True):
            up = self.up[node]
            if up >= 0:
                members[up] += members[node]
                least[up] = min(least[up], least[node])
        lengths = np.array(self.end) - np.array(self.start)
        out = {}
        cuts = [(columns, a + 1 - begin, b + 1 - begin) for (begin, _, columns), a, b in zip(self.rows, self.start, self.end, strict=True)]
        for c in _EDGE:
            out[c] = np.concatenate([columns[c][a:b] for columns, a, b in cuts])
        out["members"], out["least"] = np.repeat(members, lengths), np.repeat(np.array(least, np.int64), lengths)
        out["ends"] = np.zeros(len(out["least"]), np.int64)
        out["ends"][np.cumsum(lengths) - 1] = self.ends
        return out


_EDGE = ["pos", "s1", "s2", "p1", "p2", "bytes", "upto"]


def _task_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the tries of all tasks, from rows sorted by conversation and place."""
    fields = ", ".join(f"{c} long" for c in [*_EDGE, "members", "least", "ends"])
    read = ["conv_id", "pos", "s1", "s2", "u", "v", "bytes", "upto", "length"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rest = ZFastTrie(), None
        for batch in _and_none(batches):
            part = {c: batch.column(c).to_numpy() for c in read} if batch is not None else None
            if rest is not None:
                part = {c: np.concatenate([rest[c], part[c]]) for c in read} if part else rest
            if part is None or not len(part["conv_id"]):
                continue
            conv, pos = part["conv_id"], part["pos"]
            cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
            cuts = [0, *cuts.tolist(), len(conv)]
            part["p1"], part["p2"] = part["s1"] - part["u"], part["s2"] - part["v"]  # the prefix without its last turn
            rest = None
            if batch is not None and cuts[-1] - cuts[-2] < _SEGMENT:  # may go on in the next batch
                rest = {c: part[c][cuts[-2] :].copy() for c in read}
                cuts.pop()
            names = list(zip(part["s1"].tolist(), part["s2"].tolist(), strict=True))
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(a, b, _SEGMENT):
                    upto = min(b, at + _SEGMENT)
                    columns = {c: part[c][at:upto].copy() for c in _EDGE}
                    whole = bool(pos[upto - 1] == part["length"][upto - 1])
                    trie.insert(int(conv[at]), int(pos[at]) + 1, names[at:upto], columns, whole)
                    if trie.held >= _HELD:
                        yield pa.RecordBatch.from_pydict(trie.expanded())
                        trie = ZFastTrie()
        if trie.start:
            yield pa.RecordBatch.from_pydict(trie.expanded())

    return rows.select(*read).mapInArrow(run, fields)


def _and_none(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _digests(ends: DataFrame) -> DataFrame:
    """(s1, s2, ends_sha256) of the members (s1, s2, conv_id), by ascending id.

    Ids are joined in ranges first, so that the one task which must read a node's members in a row gets them as few rows.
    """
    key = ["s1", "s2"]

    def blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held, name, size, least = [], None, 0, 0
        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if name is not None and (name != (a, b) or size > _BLOB):
                    made.append((*name, least, ",".join(held)))
                    held, size = [], 0
                if not held:
                    name, least = (a, b), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=[*key, "least", "ids"])
                made = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, least, ",".join(held))], names=[*key, "least", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            made = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if name == (a, b):
                    state.update(b",")
                else:
                    if name is not None:
                        made.append((*name, state.hexdigest()))
                    name, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=[*key, "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*name, state.hexdigest())], names=[*key, "ends_sha256"])

    joined = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    joined = joined.mapInArrow(blobs, "s1 long, s2 long, least long, ids string")
    return joined.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(digests, "s1 long, s2 long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one included.

    ``turns`` is (conv_id, pos from 1, w1, w2, bytes), ``conversations`` (conv_id, length); one without turns is a member of the root alone.
    Without conversations there are no nodes. Returns conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, members but one times bytes of the last text) and
    ends_sha256 (of the ids of the members that end there, ascending, joined by commas).
    """
    first = conversations.select("conv_id", F.lit(0).cast("long").alias("pos"), *(F.lit(0).cast("long").alias(c) for c in ("w1", "w2", "bytes")))
    rows = turns.select("conv_id", F.col("pos").cast("long"), "w1", "w2", "bytes").unionByName(first).join(conversations, "conv_id")
    columns = [
        F.col("conv_id"),
        F.col("pos"),
        F.xxhash64("pos", "w1").alias("u"),
        F.xxhash64("pos", "w2", F.lit(3)).alias("v"),
        F.col("bytes"),
        F.col("length").cast("long").alias("length"),
    ]
    signed = running(rows, "conv_id", [F.col("pos")], [F.col("pos")], columns, ["u", "v", "bytes"])
    rows = signed.select(
        "conv_id",
        "pos",
        "length",
        "bytes",
        F.col("sum_bytes").alias("upto"),
        F.col("sum_u").alias("s1"),
        F.col("sum_v").alias("s2"),
        "u",
        "v",
    )
    key = ["s1", "s2"]
    nodes = written(
        _task_nodes(rows)
        .groupBy(*key, "pos")
        .agg(
            F.sum("members").alias("n_convs"),
            F.min("least").alias("conv_id"),
            F.sum("ends").alias("ends"),
            *(F.max(c).alias(c) for c in ("p1", "p2", "bytes", "upto")),
        )
    )
    owners = nodes.groupBy("conv_id").agg(
        F.min(F.struct("pos", (F.col("upto") - F.col("bytes")).alias("before"))).alias("top"),
        F.max((F.col("n_convs") == F.col("ends")).cast("long")).alias("leaf"),
    )
    ends = rows.where("pos = length").select("conv_id", "length", *key, F.col("upto").alias("total"))
    members = written(
        ends.join(owners, "conv_id", "left").select(
            "conv_id",
            *key,
            F.coalesce("top.pos", F.col("length") + 1).alias("owned"),
            F.coalesce("top.before", "total").alias("before"),
            F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        )
    )
    saved = F.when(F.col("pos") < F.col("owned"), F.col("before") - F.col("upto") + F.col("bytes")).otherwise(0)
    below = (
        rows.join(members.drop(*key), "conv_id")
        .where("pos < owned OR leaf = 1")
        .groupBy(*key)
        .agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    )
    children = nodes.where("pos > 0").groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    digests = _digests(members.select(*key, "conv_id"))
    none = hashlib.sha256().hexdigest()
    return (
        nodes.join(below, key, "left")
        .join(children, key, "left")
        .join(digests, key, "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            "conv_id",
            F.col("pos").alias("depth"),
            F.when(F.col("pos") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
