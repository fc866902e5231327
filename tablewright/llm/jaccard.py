"""N-gram Jaccard join by signatures of partitioned feature domains.

A document is the set of its word shingles. Sets that reach the similarity are of
like size, so sizes are cut into bands, each twice as wide as the one before. For a
band, the domain of shingles is cut into a fixed number of parts, and what a set
has in one part, if anything, makes a signature. Two sets of a band differ in
a bounded number of shingles, so all but that many parts agree; a set with
more parts in use than that bound (its slack is the difference) shares a signature with
every set similar to it. Sets whose slack is not positive, and small ones, have
each shingle as a signature besides. A set also takes part in the band above if sets there
can be similar to it. No similar pair is lost.

Signatures are sent as packed blocks of buckets, one entry for each set of equal shingles in a
task. Similar sets share as many signatures as the slack of either says. Signatures of few sets
give pairs with the number of signatures they share; a pair is a candidate if that number and the
signatures of many sets, which are not paired, can reach the slack of both. Signatures of many
sets thus only matter to sets that have as many of them as their slack. Those are compared with the smallest
set of each such signature, and once components are known, those outside the
component of the smallest are a query set that runs against all of those sets, in blocks of bounded size.
Texts decide on every candidate, so the result is exact.

Null and empty texts have empty sets and link with nothing. Documents with equal
sets, repeated rows among them, are one class and are compared once. Rows with a null
id link through equal sets only. Columns that the input has besides are left
alone, and an empty table gives an empty one. Shingles are compared by 64-bit hashes.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.chunks import Chunk, appended, mix, packed_texts
from tablewright.llm.components import connected_components
from tablewright.llm.postings import FEW, LABEL_BITS, OWNER_BITS, blocks, bucket_bits, gathered, runs
from tablewright.llm.tokens import ragged
from tablewright.scratch import written

_U = np.uint64
SMALLEST_BAND = 24  # smaller sets have their shingles as signatures
SINGLES = 31  # the level of those
_PAIRS = 512  # verified together
_QUERY_SHINGLES = 1 << 21  # of the sets that are compared with all others at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Shingles:
    """Distinct shingles of the rows of a chunk, by row and hash."""

    def __init__(self, chunk: Chunk, size: int):
        lowered = Chunk(chunk.rows, _LOWER[chunk.data], chunk.offsets)
        offsets, words = lowered.word_offsets, np.diff(lowered.word_offsets)
        at, hashes = lowered.windows(size)
        rows = lowered.word_rows[at]
        with np.errstate(over="ignore"):
            for short in range(1, size):  # the whole sequence as one
                here = np.flatnonzero(words == short)
                if len(here):
                    total = np.full(len(here), short, _U)
                    for k in range(short):
                        total = mix(total * _U(0xD1342543DE82EF95) + lowered.word_hashes[offsets[here] + k])
                    rows, hashes = np.append(rows, here), np.append(hashes, total)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        self.rows, self.hashes = rows[new], hashes[new]
        self.sizes = np.bincount(self.rows, minlength=len(chunk)).astype(np.int64)
        self.offsets = np.append(0, np.cumsum(self.sizes))
        self.mixed = mix(self.hashes ^ _U(0x5DEECE66D))
        with np.errstate(over="ignore"):
            sums = np.append(np.zeros(1, _U), np.cumsum(self.mixed))
            total = sums[self.offsets[1:]] - sums[self.offsets[:-1]]
            self.digests = mix(total + self.sizes.astype(_U) * _U(0xD1342543DE82EF95))


def _levels(sizes: np.ndarray, per_cent: int) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """Level, sets that take part, parts, and for each of those the most shingles in which it and a similar set of the level differ."""
    level, low = 0, SMALLEST_BAND
    while len(sizes) and low * per_cent <= sizes.max() * 100:
        here = np.flatnonzero((sizes < 2 * low) & (sizes * 100 >= per_cent * low))
        if len(here):
            n = sizes[here]
            partner = np.minimum(n * 100 // per_cent, 2 * low - 1)
            yield level, here, -(-8 * low // 10), (n + partner) * (100 - per_cent) // (100 + per_cent)
        level, low = level + 1, low * 2


def signatures(sets: Shingles, per_cent: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Signatures with their rows, and (level, rows, slack) for each level."""
    found, owners, slacks = [], [], []
    alone = sets.sizes < SMALLEST_BAND
    with np.errstate(over="ignore"):
        for level, here, parts, differ in _levels(sets.sizes, per_cent):
            chosen = np.zeros(len(sets.sizes), bool)
            chosen[here] = True
            at = np.flatnonzero(chosen[sets.rows])
            rows = sets.rows[at]
            part = ((sets.hashes[at] >> _U(32)) * _U(parts)) >> _U(32)
            first = np.ones(len(at), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(first)
            value = mix(np.add.reduceat(sets.mixed[at], begin) + part[begin] * _U(0x9E3779B97F4A7C15) + _U(level))
            found.append((value >> _U(LABEL_BITS) << _U(LABEL_BITS)) | _U(level))
            owners.append(rows[begin])
            slack = np.bincount(owners[-1], minlength=len(sets.sizes))[here] - differ
            slacks.append((level, here, slack))
            alone[here[slack <= 0]] = True
        single = alone[sets.rows]
        found.append((sets.mixed[single] >> _U(LABEL_BITS) << _U(LABEL_BITS)) | _U(SINGLES))
        owners.append(sets.rows[single])
        here = np.flatnonzero(alone & (sets.sizes > 0))
        slacks.append((SINGLES, here, -(-sets.sizes[here] * per_cent // 100)))
    return np.concatenate(found), np.concatenate(owners), slacks


_FOUND = pa.schema([("many", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs of sets (a < b) with the number of signatures of few sets they share; (signature, set) for the others."""
    known, key, owner = gathered(table)
    if known:
        ones = np.ones(len(key), np.int64)
        return pa.table([pa.array(ones > 0), pa.array(key.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(ones)], schema=_FOUND)
    place, count = runs(key)
    many = count > FEW
    pairs = []
    for step in range(1, FEW):
        ahead = np.flatnonzero(~many & (place + step < count))
        pairs.append(np.stack([owner[ahead], owner[ahead + step]], axis=1))
    one, two = np.concatenate(pairs).T
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    begin = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)])
    shared = np.diff(np.append(begin, len(one)))
    pairs = np.stack([one[begin], two[begin]], axis=1).view(np.int64)
    flags = np.append(np.zeros(len(pairs), bool), np.ones(int(many.sum()), bool))
    a = np.append(pairs[:, 0], key[many].view(np.int64))
    b = np.append(pairs[:, 1], owner[many].view(np.int64))
    n = np.append(shared, np.ones(int(many.sum()), np.int64))
    return pa.table([pa.array(flags), pa.array(a), pa.array(b), pa.array(n)], schema=_FOUND)


def _described(docs: DataFrame, size: int, per_cent: int, column: str, keep: list[str]) -> DataFrame:
    """(doc_id, n_shingles, digest or null, slacks) of each document."""

    def measure(chunk: Chunk) -> dict:
        sets = Shingles(chunk, size)
        _, _, slacks = signatures(sets, per_cent)
        rows = np.concatenate([here for _, here, _ in slacks])
        order = np.argsort(rows, kind="stable")
        level = np.concatenate([np.full(len(here), lv) for lv, here, _ in slacks])[order]
        slack = np.concatenate([s for _, _, s in slacks])[order]
        offsets = np.searchsorted(rows[order], np.arange(len(chunk) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(level.astype(np.int32)), pa.array(slack.astype(np.int64))], names=["level", "slack"])
        return {
            "n_shingles": sets.sizes,
            "digest": pa.array(sets.digests.view(np.int64), mask=sets.sizes == 0),
            "slacks": pa.ListArray.from_arrays(pa.array(offsets), pairs),
        }

    fields = "n_shingles long, digest long, slacks array<struct<level:int,slack:long>>"
    return appended(docs, fields, measure, ["doc_id", *keep], column)


def _sets(packed: dict[int, pa.Scalar], size: int) -> dict[int, np.ndarray | None]:
    """Shingles of packed texts by digest; none where another text stands under a repeated id."""
    open_ = zstandard.ZstdDecompressor()
    digests = list(packed)
    texts = [open_.decompress(packed[d].as_py()) for d in digests]
    offsets = np.append(0, np.cumsum([len(x) for x in texts]))
    sets = Shingles(Chunk(None, np.frombuffer(b"".join(texts), np.uint8), offsets), size)
    real = sets.digests.view(np.int64).tolist()
    return {
        d: sets.hashes[sets.offsets[i] : sets.offsets[i + 1]] if real[i] == d else None for i, d in enumerate(digests)
    }


def _verified(pairs: DataFrame, texts: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Of ``pairs`` (a, b: digests) those that are similar, as (a, b, similar) rows; texts decide."""
    left = texts.select(F.col("digest").alias("a"), F.col("packed").alias("text_a"))
    right = texts.select(F.col("digest").alias("b"), F.col("packed").alias("text_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, _PAIRS) for i in range(0, batch.num_rows, _PAIRS)):
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                packed = dict(zip(a.tolist(), part.column("text_a"), strict=True)) | dict(zip(b.tolist(), part.column("text_b"), strict=True))
                sets = _sets(packed, size)
                ok = []
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    one, two = sets[x], sets[y]
                    if one is None or two is None:
                        ok.append(None)
                        continue
                    both = np.concatenate([one, two])
                    both.sort(kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok.append(100 * common >= per_cent * (len(both) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "similar"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return written(joined.mapInArrow(run, "a long, b long, similar boolean").where("similar is not null"))


def _against_all(queries: DataFrame, sets: DataFrame, size: int, per_cent: int) -> DataFrame | None:
    """Links (a, b) between ``queries`` and ``sets`` (both a, mine, packed) of other components, one for each set and component.

    The queries are broadcast in blocks of a bounded number of shingles.
    """
    n_blocks = -(-(queries.agg(F.sum("na")).first()[0] or 0) // _QUERY_SHINGLES)
    out = None
    for block in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("a"), F.lit(n_blocks)) == block).select("a", "mine", "packed").collect()
        held = {d: x for d, x in _sets({r.a: pa.scalar(r.packed) for r in part}, size).items() if x is not None}
        mine = {r.a: r.mine for r in part}
        ids = np.array(list(held), np.int64)
        sizes = np.array([len(x) for x in held.values()], np.int64)
        hashes, owner = np.concatenate([*held.values(), np.zeros(0, _U)]), np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(hashes, kind="stable")
        index = (ids, np.array([mine[d] for d in ids.tolist()], np.int64), sizes, hashes[order], owner[order])
        shared = queries.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            ids, mine, sizes, hashes, owner = shared.value
            for batch in batches:
                for part in (batch.slice(i, _PAIRS) for i in range(0, batch.num_rows, _PAIRS)):
                    a, own = part.column("a").to_pylist(), part.column("mine").to_pylist()
                    found = _sets(dict(zip(a, part.column("packed"), strict=True)), size)
                    links = []
                    for digest, component in zip(a, own, strict=True):
                        here = found[digest]
                        if here is None:
                            continue
                        low, high = np.searchsorted(hashes, here, "left"), np.searchsorted(hashes, here, "right")
                        common = np.bincount(owner[ragged(low, high - low)], minlength=len(ids))
                        close = (100 * common >= per_cent * (sizes + len(here) - common)) & (mine != component)
                        _, first = np.unique(mine[close], return_index=True)
                        links += [(min(digest, x), max(digest, x)) for x in ids[close][first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        here = sets.mapInArrow(run, "a long, b long")
        out = here if out is None else out.union(here)
    return None if out is None else written(out.distinct())


def jaccard_components(
    docs: DataFrame, size: int = 5, per_cent: int = 75, column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id: the smallest id reachable by links) for each document.

    Documents link if 100 times their common shingles reach ``per_cent`` times the shingles of both.
    ``keep`` names further columns of ``docs`` to return.
    """
    described = written(_described(docs, size, per_cent, column, keep or []))

    def produce(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sets = Shingles(chunk, size)
        return *signatures(sets, per_cent)[:2], sets.digests

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table)

    met = written(blocks(docs, column, bucket_bits(docs, column, 10), produce).groupBy("bucket").applyInArrow(meet, "many boolean, a long, b long, n long"))

    # One row for each class of equal sets; a handle is the part of the digest that blocks carry.
    classes = (
        described.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("slacks").alias("slacks"))
        .withColumn("handle", F.col("digest").bitwiseAND((1 << OWNER_BITS) - 1))
    )
    classes = written(classes)
    one = classes.select(F.col("handle").alias("ha"), F.col("digest").alias("a"), F.col("n").alias("na"))
    two = classes.select(F.col("handle").alias("hb"), F.col("digest").alias("b"), F.col("n").alias("nb"))
    alike = (F.col("na") * 100 >= F.col("nb") * per_cent) & (F.col("nb") * 100 >= F.col("na") * per_cent)

    level = F.col("sig").bitwiseAND((1 << LABEL_BITS) - 1).cast("int")
    many = met.where("many").select(F.col("a").alias("sig"), F.col("b").alias("ha")).distinct()
    many = many.join(one, "ha").select("sig", level.alias("level"), "a", "na")
    slack = classes.select(F.col("digest").alias("a"), F.explode("slacks").alias("s")).select("a", "s.level", "s.slack")
    have = many.groupBy("a", "level").agg(F.count("*").alias("have"))
    slack = written(slack.join(have, ["a", "level"], "left").withColumn("have", F.coalesce("have", F.lit(0))))
    need = slack.groupBy("a").agg(F.min(F.col("slack") - F.col("have")).alias("need"))

    few = met.where("not many").groupBy(F.col("a").alias("ha"), F.col("b").alias("hb")).agg(F.sum("n").alias("n"))
    few = few.join(one, "ha").join(need, "a").where("n >= need").drop("need")
    few = few.join(two, "hb").join(need.withColumnRenamed("a", "b"), "b").where("n >= need")
    few = few.where(alike & (F.col("a") != F.col("b")))

    # Signatures of many sets, for the sets that cannot do without them.
    bound = written(many.join(slack.where("have >= slack").select("a", "level"), ["a", "level"]).select("sig", "a", "na"))
    centres = bound.groupBy("sig").agg(F.min(F.struct("a", "na")).alias("c")).select("sig", F.col("c.a").alias("b"), F.col("c.na").alias("nb"))
    stars = bound.join(centres, "sig").where(alike & (F.col("a") != F.col("b")))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = written(few.select(*ordered).union(stars.select(*ordered)).distinct())

    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).union(bound.select(F.col("a").alias("digest")))
    wanted = wanted.distinct().join(classes.select("digest", "rep"), "digest").select("digest", F.col("rep").alias("doc_id"))
    # By id and digest, as an id may stand with several texts; a row that repeats both only repeats pairs.
    packed = packed_texts(docs, column, lambda chunk: Shingles(chunk, size).digests)
    texts = written(packed.join(wanted, ["doc_id", "digest"]).select("digest", "packed"))
    links = _verified(pairs, texts, size, per_cent).where("similar").select("a", "b")
    components = connected_components(links)

    # Sets that share a signature of many with its smallest set, but are in another component.
    own = components.select(F.col("node").alias("a"), F.col("component").alias("mine"))
    placed = bound.join(own, "a", "left").withColumn("mine", F.coalesce("mine", "a"))
    main = placed.join(centres.select("sig", F.col("b").alias("a")), ["sig", "a"]).select("sig", F.col("mine").alias("main"))
    apart = written(placed.join(main, "sig").where("mine <> main").select("a", "na", "mine").distinct())
    held = placed.select("a", "mine").distinct().join(texts.withColumnRenamed("digest", "a"), "a")
    more = _against_all(apart.join(texts.withColumnRenamed("digest", "a"), "a"), written(held), size, per_cent)
    if more is not None:
        links = links.union(more)
        components = connected_components(links)

    grouped = classes.join(components.select(F.col("node").alias("digest"), "component"), "digest", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "digest"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = grouped.join(smallest, "component").select("digest", "component_id")
    out = described.join(known, "digest", "left")
    return out.select("doc_id", *(keep or []), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
