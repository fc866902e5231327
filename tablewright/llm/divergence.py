"""How far the sources of a language differ from each other, and by which terms.

A language keeps the terms that enough of its documents hold. Kept terms are sorted and numbered, and made into minimal
acyclic transducers: automata that read the bytes of a term and add up its number in lexicographic order. The distinct
terms of each chunk of texts are streamed through them side by side, to count each kept term in each source. The most common terms,
a bounded number, form one transducer that is broadcast; a term it does not accept is counted within its task and sent to the shard that its hash
names, where a transducer of that shard's kept terms reads it. Counts travel packed, many in a row, and no transducer grows with the data.

Sums over pairs of sources are kept sparse: each kept term adds to the pairs of sources that both have it, inside a
task, and what a source's terms come to against one that lacks them depends on counts alone, of which few are distinct.
"""

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.chunks import Chunk, chunks, hashed, mix
from tablewright.llm.tokens import ragged
from tablewright.scratch import written

HOT_TERMS = 1 << 17  # in the transducer that is broadcast
HOT_BYTES = 64  # longest term there
SHARD_TERMS = 1 << 16
SCALE = 1_000_000_000
_HELD = 200_000  # counts that a task holds before it adds them up and may hand them on
_CHUNK = 4 << 20
_PAIRS = 1 << 20
_PACK = 256  # counts in a row
_PACK_BYTES = 1 << 16  # of their terms, beyond which a row ends
_BUNDLE_BYTES = 1 << 15  # of such rows that travel as one
_PACKED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.binary()), ("packed", pa.binary())])

_LOW = 2**32 - 1

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a chunk in a row, where each begins (and the end of the last), and the row of each.

    Terms are runs of ASCII letters and bytes from 128 on; A to Z are lower-cased.
    """
    data, offsets = chunk.data, chunk.offsets
    here = _IS_TERM[data]
    begins, ends = here.copy(), here.copy()
    begins[1:] &= ~here[:-1]
    ends[:-1] &= ~here[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], ends[last] = here[first], here[last]
    starts = np.flatnonzero(begins)
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=cuts[1:])
    rows = np.repeat(np.arange(len(chunk)), np.diff(np.searchsorted(starts, offsets)))
    return _LOWER[data[here]], cuts, rows


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers)


def _bytes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms in a row, and where each begins (and the end of the last)."""
    terms = terms.cast(pa.large_binary())
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def coded(chunk: Chunk, columns: list[str], seen: dict[tuple, int]) -> np.ndarray:
    """A number for each row's values of the columns, null as empty, that stays the same within a task."""
    values = zip(*(chunk.rows.column(c).cast(pa.string()).fill_null("").to_pylist() for c in columns), strict=True)
    return np.fromiter((seen.setdefault(v, len(seen)) for v in values), np.int64, len(chunk))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and how often each occurs; the array is sorted in place."""
    keys.sort()
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads], np.diff(np.append(heads, len(keys)))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and the sum of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads], np.add.reduceat(counts[order], heads) if len(keys) else counts


class _Held:
    """Counts of (group, term) that are added up whenever many have come together."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.n = 0

    def add(self, group: np.ndarray, term: pa.Array, n: np.ndarray) -> None:
        self.tables.append(pa.table({"group": group, "term": term, "n": n}))
        self.n += len(n)

    def taken(self) -> pa.Table | None:
        """All counts so far, once there are too many to go on with."""
        if self.n < _HELD:
            return None
        table = self.summed()
        if table.num_rows < _HELD // 2:
            self.tables, self.n = [table], table.num_rows
            return None
        self.tables, self.n = [], 0
        return table

    def summed(self) -> pa.Table:
        table = pa.concat_tables(self.tables).combine_chunks()
        terms = table["term"].combine_chunks().dictionary_encode()
        both, n = _added(table["group"].to_numpy() << 32 | terms.indices.to_numpy(), table["n"].to_numpy())
        return pa.table({"group": both >> 32, "term": terms.dictionary.take(pa.array(both & _LOW)), "n": n})


def _batches(table: pa.Table, seen: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
    langs = pa.array([g[0] for g in seen], pa.string())
    for a in range(0, table.num_rows, 50_000):
        part = table.slice(a, 50_000).combine_chunks()
        where = part["group"].combine_chunks()
        term = part["term"].combine_chunks().cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_pydict({"lang": langs.take(where), "term": term, "n": part["n"].combine_chunks()})


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): how many rows of a language hold a term. Null languages and texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = _Held(), {}
        for chunk in chunks(batches, "text", _CHUNK):
            data, cuts, rows = terms_of(chunk)
            terms = binaries(data, cuts).dictionary_encode()
            once, _ = _counted(rows << 32 | terms.indices.to_numpy())
            langs = coded(chunk, ["lang"], seen)
            where, n = _counted(langs[once >> 32] << 32 | once & _LOW)
            held.add(where >> 32, terms.dictionary.take(pa.array(where & _LOW)), n)
            if (table := held.taken()) is not None:
                yield from _batches(table, seen)
        if held.n:
            yield from _batches(held.summed(), seen)

    counts = docs.select("text", "lang").mapInArrow(run, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def numbered_terms(frequencies: DataFrame, least: int) -> DataFrame:
    """(lang, term, n, ordinal) of the terms in at least so many documents, written; ordinals ascend with lang, then with the term's UTF-8."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.arange(at, at + n)), pa.array(np.full(n, part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "at", "part"])
            at += n

    kept = frequencies.where(F.col("n") >= least).select("lang", "term", "n")
    ranged = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    table = written(ranged.mapInArrow(run, "lang string, term string, n long, at long, part int"))
    counts = {r.part: r["count"] for r in table.groupBy("part").count().collect()}  # one row a task
    before, shift = 0, []
    for part in sorted(counts):
        shift.append((part, before))
        before += counts[part]
    shifts = table.sparkSession.createDataFrame(shift or [(-1, 0)], "part int, shift long")
    return table.join(F.broadcast(shifts), "part").select("lang", "term", "n", (F.col("at") + F.col("shift")).alias("ordinal"))


class Transducer:
    """The minimal acyclic automaton of sorted terms of some languages, with the number of each.

    A term's number is the sum of the outputs of the steps that read it: for each step, the terms that come before all those behind it.
    Steps lie in one table of open addresses, by state and byte.
    """

    def __init__(self, terms: dict[str, list[bytes]], ordinals: dict[str, list[int]]):
        """``terms`` of each language in ascending order, each once, with their ``ordinals``."""
        self.register: dict[tuple, int] = {}
        self.words: list[int] = []  # accepted strings from each state
        self.steps: list[tuple] = []
        self.final: list[bool] = []
        self.begin: dict[str, int] = {}
        self.base: dict[str, int] = {}
        numbers: list[int] = []
        for lang, held in terms.items():
            self.begin[lang], self.base[lang] = self._built(held), len(numbers)
            numbers += ordinals[lang]
        self.ordinals = np.array(numbers, np.int64)
        self._lay()

    @classmethod
    def of(cls, held: dict) -> "Transducer":
        """From the attributes of another one."""
        made = cls.__new__(cls)
        made.__dict__ |= held
        return made

    def _state(self, final: bool, steps: list) -> int:
        key = (final, tuple(steps))
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.words)
            self.words.append(final + sum(self.words[to] for _, to in steps))
            self.steps.append(key[1])
            self.final.append(final)
        return state

    def _built(self, terms: list[bytes]) -> int:
        """The first state of an automaton of the terms, which shares its states with earlier ones."""
        open_: list[list] = [[False, []]]  # the states along the last term, not yet frozen
        last = b""
        for term in terms:
            common, most = 0, min(len(last), len(term))
            while common < most and last[common] == term[common]:
                common += 1
            for k in range(len(last), common, -1):
                final, steps = open_.pop()
                open_[-1][1].append((last[k - 1], self._state(final, steps)))
            open_ += [[False, []] for _ in range(len(term) - common)]
            open_[-1][0] = True
            last = term
        for k in range(len(last), 0, -1):
            final, steps = open_.pop()
            open_[-1][1].append((last[k - 1], self._state(final, steps)))
        return self._state(*open_[0])

    def _lay(self) -> None:
        source, byte, to, out = [], [], [], []
        for state, steps in enumerate(self.steps):
            before = int(self.final[state])
            for b, target in steps:
                source.append(state)
                byte.append(b)
                to.append(target)
                out.append(before)
                before += self.words[target]
        keys = np.array(source, np.int64) << 8 | np.array(byte, np.int64)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), size - 1
        self.keys = np.full(size, -1, np.int64)
        self.to, self.out = np.zeros(size, np.int32), np.zeros(size, np.int64)
        to, out, rest = np.array(to, np.int32), np.array(out, np.int64), np.arange(len(keys))
        at = self._slot(keys)
        while len(rest):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]
            mine = self.keys[at] == keys[rest]
            self.to[at[mine]], self.out[at[mine]] = to[rest[mine]], out[rest[mine]]
            rest, at = rest[~mine], (at[~mine] + 1) & self.mask
        self.final = np.array(self.final, bool)
        del self.register, self.words, self.steps

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def read(self, data: np.ndarray, cuts: np.ndarray, langs: np.ndarray, names: list[str]) -> np.ndarray:
        """The ordinal of each of the terms between the cuts, -1 for one that is not kept; ``langs`` has the place of each term's language in ``names``."""
        begin = np.array([self.begin.get(x, -1) for x in names], np.int64)
        base = np.array([self.base.get(x, 0) for x in names], np.int64)
        state, found = begin[langs], np.full(len(langs), -1, np.int64)
        at, lengths = cuts[:-1], np.diff(cuts)
        live = np.flatnonzero((state >= 0) & (lengths > 0))
        state, number, left, at = state[live], base[langs[live]], lengths[live], at[live]
        while len(live):
            keys = state << 8 | data[at]
            slot = self._slot(keys)
            held = self.keys[slot]
            odd = np.flatnonzero((held != keys) & (held != -1))
            while len(odd):
                slot[odd] = (slot[odd] + 1) & self.mask
                held[odd] = self.keys[slot[odd]]
                odd = odd[(held[odd] != keys[odd]) & (held[odd] != -1)]
            state, number, left = self.to[slot].astype(np.int64), number + self.out[slot], left - 1
            known = held == keys
            done = known & (left == 0)
            done[done] = self.final[state[done]]
            found[live[done]] = number[done]
            on = known & (left > 0)
            live, state, number, left, at = live[on], state[on], number[on], left[on], at[on] + 1
        hit = found >= 0
        found[hit] = self.ordinals[found[hit]]
        return found


def transducer(rows: Iterable[tuple[str, bytes, int]]) -> Transducer:
    """From (lang, term, ordinal) in any order."""
    terms: dict[str, list[bytes]] = {}
    ordinals: dict[str, list[int]] = {}
    for lang, term, ordinal in sorted(rows, key=lambda r: r[2]):
        terms.setdefault(lang, []).append(term)
        ordinals.setdefault(lang, []).append(ordinal)
    return Transducer(terms, ordinals)


def _hot(kept: DataFrame, most: int) -> list[tuple[str, bytes, int]]:
    """The most frequent terms that are not too long, ``most`` at the most: those above the lowest frequency class that still fits."""
    short = kept.where(F.octet_length("term") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 8)  # at most a few hundred classes
    total, floor = 0, None
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        floor = row.level
    if floor is None:
        return []
    return [(r.lang, r.term.encode(), r.ordinal) for r in short.where(level >= floor).select("lang", "term", "ordinal").collect()]


def _packed(both: np.ndarray, n: np.ndarray, width: int, n_shards: int, seen: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
    """Counts of ``group * width + ordinal`` as rows of a group and a shard, each with some pairs of an ordinal and its count."""
    group, ordinal = both // width, both % width
    order = np.argsort(group * n_shards + ordinal % n_shards, kind="stable")
    group, ordinal = group[order], ordinal[order]
    shard = ordinal % n_shards
    heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (shard[1:] != shard[:-1]))[: len(group)])
    sizes = np.diff(np.append(heads, len(group)))
    cut = -(-sizes // _PACK)
    heads = np.repeat(heads, cut) + ragged(np.zeros(len(cut), np.int64), cut) * _PACK
    pairs = np.stack([ordinal, n[order]], 1)
    names = [pa.array([g[i] for g in seen], pa.string()) for i in range(2)]
    for a in range(0, len(heads), 5_000):
        at = np.append(heads[a : a + 5_000], heads[a + 5_000] if a + 5_000 < len(heads) else len(group))
        where, m = pa.array(group[at[:-1]]), len(at) - 1
        buffers = [None, pa.py_buffer(((at - at[0]) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pairs[at[0] : at[-1]]))]
        columns = {"lang": names[0].take(where), "source": names[1].take(where), "terms": pa.nulls(m, pa.binary())}
        packed = pa.Array.from_buffers(pa.binary(), m, buffers)
        yield pa.RecordBatch.from_pydict(columns | {"place": pa.array(shard[at[:-1]]), "packed": packed})


def _places(terms: pa.Array, langs: np.ndarray, names: list[str], n_shards: int) -> np.ndarray:
    """The shard of each term; ``langs`` has the place of its language in ``names``."""
    data, cuts = _bytes(terms)
    salts = np.array([zlib.crc32(x.encode()) for x in names], np.uint64)
    with np.errstate(over="ignore"):
        return (mix(hashed(data, cuts[:-1], cuts[1:]) ^ salts[langs]) % np.uint64(n_shards)).astype(np.int64)


def _packed_terms(table: pa.Table, n_shards: int, seen: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
    """Counts of (group, term) as rows of a group and a shard, each with some terms in a row and pairs of a term's length and its count."""
    group, terms = table["group"].to_numpy(), table["term"].combine_chunks()
    names = [pa.array([g[i] for g in seen], pa.string()) for i in range(2)]
    shard = _places(terms, group, names[0].to_pylist(), n_shards)
    order = np.argsort(group * n_shards + shard)
    group, shard = group[order], shard[order]
    data, cuts = _bytes(terms.take(pa.array(order)))
    pairs = np.stack([np.diff(cuts), table["n"].to_numpy()[order]], 1)
    begins = np.append(True, (group[1:] != group[:-1]) | (shard[1:] != shard[:-1]))[: len(group)]
    cell = np.flatnonzero(begins)[np.cumsum(begins) - 1]  # where those of the same group and shard begin
    for block in ((np.arange(len(group)) - cell) // _PACK, (cuts[:-1] - cuts[cell]) // _PACK_BYTES):
        begins[1:] |= block[1:] != block[:-1]
    heads = np.append(np.flatnonzero(begins), len(group))
    for a in range(0, len(heads) - 1, 1_000):
        at = heads[a : a + 1_001]
        where, m = pa.array(group[at[:-1]]), len(at) - 1
        first, last = cuts[at[0]], cuts[at[-1]]
        words = [None, pa.py_buffer((cuts[at] - first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[first:last]))]
        sizes = [None, pa.py_buffer(((at - at[0]) * 16).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pairs[at[0] : at[-1]]))]
        columns = {"lang": names[0].take(where), "source": names[1].take(where), "terms": pa.Array.from_buffers(pa.binary(), m, words)}
        yield pa.RecordBatch.from_pydict(columns | {"place": pa.array(shard[at[:-1]]), "packed": pa.Array.from_buffers(pa.binary(), m, sizes)})


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the ordinal (or length) and the count of each pair."""
    held = packed.to_pylist()
    pairs = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(held)), [len(x) // 16 for x in held]), pairs[:, 0], pairs[:, 1]


def _bundled(batches: Iterable[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """Packed rows serialised, some of one shard in a row, so that many groups and shards do not make many rows."""
    held, size = [], 0

    def bundles() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        order = np.argsort(rows["place"].to_numpy())
        rows, place = rows.take(pa.array(order)), rows["place"].to_numpy()[order]
        begins = np.append(True, place[1:] != place[:-1])
        upto = np.cumsum(sum(pc.binary_length(rows[c]).fill_null(0).to_numpy().astype(np.int64) for c in ("terms", "packed")))
        block = (upto - upto[np.flatnonzero(begins)[np.cumsum(begins) - 1]]) // _BUNDLE_BYTES
        begins[1:] |= block[1:] != block[:-1]
        heads, rows = np.flatnonzero(begins), rows.select(_PACKED.names)
        made = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(place)], strict=True)]
        columns = {"bundle": pa.array(made, pa.binary()), "shard": pa.array(place[heads]), "kind": pa.array(np.full(len(heads), kind, np.int32))}
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 64 << 20:
            yield bundles()
            held, size = [], 0
    if held:
        yield bundles()


def _unbundled(bundles: pa.Array) -> Iterator[pa.RecordBatch]:
    """The packed rows, those of some bundles at a time."""
    for a in range(0, len(bundles), 256):
        rows = [pa.ipc.read_record_batch(pa.py_buffer(x), _PACKED) for x in bundles.slice(a, 256).to_pylist()]
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _coded_batch(batch: pa.RecordBatch, seen: dict[tuple, int]) -> np.ndarray:
    """As ``coded``, for the language and source of many rows."""
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    size = max(1, len(sources.dictionary))
    found, back = np.unique(langs.indices.to_numpy().astype(np.int64) * size + sources.indices.to_numpy(), return_inverse=True)
    lang, source = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
    return np.array([seen.setdefault((lang[x // size], source[x % size]), len(seen)) for x in found.tolist()], np.int64)[back]


def recount(docs: DataFrame, kept: DataFrame, hot_terms: int = HOT_TERMS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, ordinal, n, lang_n): occurrences of the kept terms (lang, term, n, ordinal) in each source and in the language, written.

    All counts of a term meet in one shard, which adds them up: those by ordinal in the shard that the ordinal names, packed, the others where the hash of
    their term sends them, with the kept terms of that hash.
    """
    spark = docs.sparkSession
    hot = _hot(kept, hot_terms)
    total = kept.count()
    vocabulary = spark.sparkContext.broadcast(transducer(hot).__dict__)  # arrays and dictionaries, of a bounded size
    names = ["lang", "source"]
    complete = total == len(hot)  # then nothing is left to send on
    width = max(1, total)
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total - len(hot)) / shard_terms))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, seen = Transducer.of(vocabulary.value), _Held(), {}
        keys, counts = [], []

        def summed(last: bool) -> Iterator[pa.RecordBatch]:
            both, n = _added(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [both], [n]
            if last or len(both) >= 2 * _HELD:
                yield from _bundled(_packed(both, n, width, n_shards, seen), 1)
                keys[:], counts[:] = [], []

        for chunk in chunks(batches, "text", _CHUNK):
            data, cuts, rows = terms_of(chunk)
            terms = binaries(data, cuts).dictionary_encode()
            one, n = _counted(coded(chunk, names, seen)[rows] << 32 | terms.indices.to_numpy())
            group, code = one >> 32, one & _LOW
            places: dict[str, int] = {}
            lang = np.array([places.setdefault(x, len(places)) for x, _ in seen], np.int64)[group]
            each, back = np.unique(lang << 32 | code, return_inverse=True)  # a term is read once in each language of the chunk
            found = reader.read(*_bytes(terms.dictionary.take(pa.array(each & _LOW))), each >> 32, list(places))[back]
            hit = found >= 0
            keys.append(group[hit] * width + found[hit])
            counts.append(n[hit])
            if sum(map(len, keys)) >= 4 * _HELD:
                yield from summed(False)
            if not complete:
                held.add(group[~hit], terms.dictionary.take(pa.array(code[~hit])), n[~hit])
                if (table := held.taken()) is not None:
                    yield from _bundled(_packed_terms(table, n_shards, seen), 2)
        if keys:
            yield from summed(True)
        if held.n:
            yield from _bundled(_packed_terms(held.summed(), n_shards, seen), 2)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            place = _places(batch["term"], langs.indices.to_numpy(), langs.dictionary.to_pylist(), n_shards)
            columns = [batch["lang"], batch["term"].cast(pa.binary()), batch["ordinal"], pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "terms", "ordinal", "shard"])

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, reader = None, [], None
        seen, keys, counts, most = {}, [], [], 4 * _HELD

        def summed() -> Iterator[pa.RecordBatch]:
            both, n = _added(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [], []
            group, ordinal = both // width, both % width
            order = np.argsort(ordinal)
            group, ordinal, n = group[order], ordinal[order], n[order]
            heads = np.flatnonzero(np.append(True, ordinal[1:] != ordinal[:-1])[: len(ordinal)])
            whole = np.repeat(np.add.reduceat(n, heads), np.diff(np.append(heads, len(n)))) if len(n) else n
            held = [pa.array([g[i] for g in seen], pa.string()) for i in range(len(names))]
            for a in range(0, len(n), 50_000):
                part = slice(a, a + 50_000)
                columns = [g.take(pa.array(group[part])) for g in held] + [pa.array(x[part]) for x in (ordinal, n, whole)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ordinal", "n", "lang_n"])

        for batch in batches:
            at = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != shard:
                    if keys:
                        yield from summed()
                    shard, words, reader, most = at[a], [], None, 4 * _HELD
                part = batch.slice(a, b - a)
                ordered = part.column("kind").to_numpy()  # the shard's kept terms, counts of known ordinals, counts of terms
                cut = np.searchsorted(ordered, [1, 2]).tolist()
                own, counted, rest = part.slice(0, cut[0]), part.slice(cut[0], cut[1] - cut[0]), part.slice(cut[1])
                words += zip(own["lang"].to_pylist(), own["terms"].to_pylist(), own["ordinal"].to_pylist(), strict=True)
                for rows in _unbundled(counted["bundle"]):
                    row, ordinal, n = _unpacked(rows["packed"])
                    keys.append(_coded_batch(rows, seen)[row] * width + ordinal)
                    counts.append(n)
                for rows in _unbundled(rest["bundle"]) if words else ():
                    reader = reader or transducer(words)
                    langs = rows["lang"].dictionary_encode()
                    row, length, n = _unpacked(rows["packed"])
                    data = np.frombuffer(b"".join(rows["terms"].to_pylist()), np.uint8)
                    found = reader.read(data, np.append(0, np.cumsum(length)), langs.indices.to_numpy()[row], langs.dictionary.to_pylist())
                    hit = found >= 0
                    keys.append(_coded_batch(rows, seen)[row[hit]] * width + found[hit])
                    counts.append(n[hit])
                if sum(map(len, keys)) >= most:
                    both, n = _added(np.concatenate(keys), np.concatenate(counts))
                    keys[:], counts[:], most = [both], [n], max(most, 2 * len(both))
        if keys:
            yield from summed()

    read = docs.select("text", "lang", "source")
    counts = read.mapInArrow(stream, "bundle binary, shard long, kind int")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("terms", "binary"), ("ordinal", "long"))]
    counts = counts.select("bundle", "shard", "kind", *empty)
    if not complete:
        own = kept.select("lang", "term", "ordinal").mapInArrow(placed, "lang string, terms binary, ordinal long, shard long")
        counts = counts.unionByName(own.withColumns({"bundle": F.lit(None).cast("binary"), "kind": F.lit(0)}))
    dealt = counts.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")
    return written(dealt.mapInArrow(shards, "lang string, source string, ordinal long, n long, lang_n long"))


def _share(count: str, total: str, kept: str) -> str:
    """p in exact arithmetic: counts up to 9 billion in long integers, larger ones in decimals."""
    small = f"{SCALE} * ({count} + 1) div ({total} + {kept})"
    large = f"{SCALE} * (CAST({count} AS DECIMAL(20, 0)) + 1) div CAST({total} + {kept} AS DECIMAL(20, 0))"
    return f"1 + CASE WHEN {count} < 9000000000 THEN {small} ELSE {large} END"


def _both_present(shares: DataFrame) -> DataFrame:
    """(lang, source, other, value): for terms that both sources have, by how much f differs from what it is taken for elsewhere.

    ``shares`` is (lang, source, ordinal, p, p0). A term's rows, at most one a source, stand together in a task; pairs are summed there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, seen = None, {}

        def summed(table: pa.Table) -> pa.RecordBatch:
            group = _coded_batch(table.combine_chunks().to_batches()[0], seen)
            at, p, zero = (table[c].to_numpy() for c in ("ordinal", "p", "p0"))
            heads = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
            sizes = np.diff(heads)
            size, begin = np.repeat(sizes, sizes), np.repeat(heads[:-1], sizes)
            keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            upto = np.cumsum(size)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, "right")))
                left, right = np.repeat(np.arange(a, b), size[a:b]), ragged(begin[a:b], size[a:b])
                other = left != right
                left, right = left[other], right[other]
                x, y, x0, y0 = p[left], p[right], zero[left], zero[right]
                value = (x - y) ** 2 // y - (x - y0) ** 2 // y0 - (x0 - y) ** 2 // y + (x0 - y0) ** 2 // y0
                key, back = np.unique(group[left] * len(seen) + group[right], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, back, value)
                keys.append(key)
                sums.append(total)
                a = b
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, np.concatenate(sums))
            names = list(seen)
            one, two = (key // max(1, len(seen))).tolist(), (key % max(1, len(seen))).tolist()
            columns = [pa.array([names[g][0] for g in one], pa.string()), pa.array([names[g][1] for g in one], pa.string())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([names[g][1] for g in two], pa.string()), pa.array(total)], names=["lang", "source", "other", "value"]
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if not table.num_rows:
                continue
            at = table["ordinal"].to_numpy()
            whole = int(np.searchsorted(at, at[-1])) if (at[1:] >= at[:-1]).all() else 0
            rest = table.slice(whole)  # its last term may go on in the next batch
            if whole:
                yield summed(table.slice(0, whole))
        if rest is not None and rest.num_rows:
            yield summed(rest)

    sorted_ = shares.select("lang", "source", "ordinal", "p", "p0").repartition("ordinal").sortWithinPartitions("ordinal")
    return sorted_.mapInArrow(run, "lang string, source string, other string, value long")


def source_divergence(
    docs: DataFrame, least: int = 3, ranks: int = 200, hot_terms: int = HOT_TERMS, shard_terms: int = SHARD_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with each other one of its language, part ``term`` names the terms that it has more often than the language.

    Every row is a document, repeated rows too; null text, lang and source are empty. A source without terms stands in all pairs; where a language keeps no
    term, they are 0. An empty table has no rows. Other columns are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = numbered_terms(document_frequencies(docs), least)
    counts = recount(docs, kept, hot_terms, shard_terms)
    kinds = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "present", "v")))
    zero = F.expr(f"CASE WHEN v > 0 THEN 1 + {SCALE} div (total + v) END")
    groups = written(groups.withColumn("p0", zero))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    terms = shares.select("lang", "source", "ordinal", "p", "v", "lang_n").join(whole, "lang")
    terms = terms.withColumn("q", F.expr(_share("lang_n", "lang_total", "v"))).where("p > q")
    terms = terms.withColumn("value", F.expr("(p - q) * (p - q) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("ordinal"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= ranks)
    named = terms.select("lang", "source", "ordinal", "value", "rank").join(kept.select("ordinal", "term"), "ordinal")
    named = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # f of a pair over all terms: those only one side has, then those neither has, then what those that both have change
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    one = groups.select("lang", "source", F.col("p0").alias("own"), F.col("present").alias("mine"), "v")
    two = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("theirs"), F.col("present").alias("its"))
    pairs = one.join(two, "lang").where("source <> other")
    key = ["lang", "source", "other"]
    only_one = pairs.join(alike, ["lang", "source"]).groupBy(*key).agg(F.sum(F.expr("terms * ((p - theirs) * (p - theirs) div theirs)")).alias("value"))
    only_two = pairs.join(alike.withColumnRenamed("source", "other"), ["lang", "other"])
    only_two = only_two.groupBy(*key).agg(F.sum(F.expr("terms * ((own - p) * (own - p) div p)")).alias("value"))
    neither = F.expr("CASE WHEN v > 0 THEN (v - mine - its) * ((own - theirs) * (own - theirs) div theirs) ELSE 0 END")
    parts = pairs.select(*key, neither.alias("value")).unionByName(only_one).unionByName(only_two).unionByName(_both_present(shares))
    paired = parts.groupBy(*key).agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("other"))
    paired = paired.withColumn("rank", F.row_number().over(order))
    paired = paired.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return paired.unionByName(named)
