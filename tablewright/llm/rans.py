"""Token ids in binary files, coded by a static range asymmetric numeral system.

All files share one table of token frequencies, counted over the whole corpus and
scaled to 2**20. A file is a sequence of independent blocks. In a block, 4096
lanes take one id each in turn; each lane has a 64-bit state, and states give off 32 bits at a
time to one stream. The index of a file holds, for every block, its
first id, its place and its checksum, so blocks can be decoded apart and from any block on.

File: the header, ``<4sIIQQQ``: magic, checksum of the table, checksum of the
index, numbers of documents, ids and blocks; the index: ids of documents (int64), flags for
null ids (uint8), token counts (int64), and for each block its first id, place, number of ids (int64) and
checksum (uint32); the blocks: final states of the lanes (uint64), then the words of the stream (uint32).

Archives are rows of a Parquet table in the shared folder, one file a row, as Spark
has no writer for other binary files; ``content`` is a file as described.

Null and empty texts hold the end id alone. Null ids come first. Rows that
repeat an id stand in the order of their texts. Columns that the input has
besides are left out, and an empty table gives no files.
"""

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.chunks import binary, chunks
from tablewright.llm.tokens import TOKEN_CHUNK, encoder
from tablewright.scratch import written

MAGIC = b"TWR1"
HEADER = "<4sIIQQQ"
SCALE_BITS = 20
LANES = 4096
BLOCK = 1 << 20
_U = np.uint64
_LOW = _U(1 << 31)
_BITS, _MASK = _U(SCALE_BITS), _U((1 << SCALE_BITS) - 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as shares of 2**20, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    out = np.where(counts > 0, np.maximum(counts * (size / max(total, 1)), 1).astype(np.int64), 0)
    while total and (rest := size - int(out.sum())):
        order = np.argsort(-out, kind="stable")
        if rest > 0:
            out[order[0]] += rest
        else:
            top = order[: np.count_nonzero(out > 1)]
            cut = np.minimum(out[top] - 1, np.maximum(1, out[top] * -rest // size))
            keep = np.cumsum(cut) <= -rest
            if not keep.any():
                cut[0], keep[0] = -rest, True
            out[top[keep]] -= cut[keep]
    return out


class Table:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(_U)
        self.start = (np.cumsum(frequencies) - frequencies).astype(_U)
        self.crc = zlib.crc32(frequencies.astype("<i8"))
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        return self._symbol


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """The last ids first, as decoding turns the order round."""
    lanes = min(LANES, len(ids))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, _U)
    frequency, start = table.frequency[ids], table.start[ids]
    limit = frequency << _U(63 - SCALE_BITS)
    given: list[np.ndarray] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, len(ids))
        x = state[: b - a]
        full = x >= limit[a:b]
        if full.any():
            given.append(x[full].astype(np.uint32))
            x = np.where(full, x >> _U(32), x)
        f = frequency[a:b]
        whole = x // f
        state[: b - a] = (whole << _BITS) + (x - whole * f) + start[a:b]
    words = np.concatenate(given[::-1]) if given else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_block(content: bytes, n: int, table: Table) -> np.ndarray:
    lanes = min(LANES, n)
    state = np.frombuffer(content, "<u8", lanes).astype(_U)
    words = np.frombuffer(content, "<u4", offset=8 * lanes).astype(_U)
    out, at = np.empty(n, np.uint32), 0
    symbol, frequency, start = table.symbol, table.frequency, table.start
    for a in range(0, n, lanes):
        b = min(a + lanes, n)
        x = state[: b - a]
        slot = x & _MASK
        s = symbol[slot.astype(np.int64)]
        out[a:b] = s
        x = frequency[s] * (x >> _BITS) + slot - start[s]
        short = x < _LOW
        many = int(np.count_nonzero(short))
        if many:
            x[short] = (x[short] << _U(32)) | words[at : at + many]
            at += many
        state[: b - a] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("a block does not end where it began")
    return out


def encode_file(doc_ids: np.ndarray, is_null: np.ndarray, counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    blocks, index, place = [], [], 0
    for a in range(0, len(ids), BLOCK):
        part = ids[a : a + BLOCK]
        blocks.append(encode_block(part, table))
        index.append((a, place, len(part), zlib.crc32(blocks[-1])))
        place += len(blocks[-1])
    head = b"".join(
        np.array(x, kind).tobytes()
        for x, kind in (
            (doc_ids, "<i8"), (is_null, "u1"), (counts, "<i8"),
            ([i[0] for i in index], "<i8"), ([i[1] for i in index], "<i8"), ([i[2] for i in index], "<i8"),
            ([i[3] for i in index], "<u4"),
        )
    )
    return struct.pack(HEADER, MAGIC, table.crc, zlib.crc32(head), len(counts), len(ids), len(blocks)) + head + b"".join(blocks)


def decode_file(content: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Ids of documents, null flags, token counts, and the ids of one block after the other, all checksums verified."""
    magic, table_crc, index_crc, n_docs, n_ids, n_blocks = struct.unpack_from(HEADER, content)
    at, fields = struct.calcsize(HEADER), []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<i8", n_blocks), ("<i8", n_blocks), ("<i8", n_blocks), ("<u4", n_blocks)):
        fields.append(np.frombuffer(content, kind, n, at))
        at += fields[-1].nbytes
    if magic != MAGIC or table_crc != table.crc or zlib.crc32(content[struct.calcsize(HEADER) : at]) != index_crc:
        raise ValueError("the file is damaged, or coded with another table")
    doc_ids, is_null, counts, _, places, lengths, crcs = fields
    if lengths.sum() != n_ids or counts.sum() != n_ids:
        raise ValueError("the index does not fit the file")

    def blocks() -> Iterator[np.ndarray]:
        ends = np.append(places[1:], len(content) - at)
        for a, b, n, crc in zip(places.tolist(), ends.tolist(), lengths.tolist(), crcs.tolist(), strict=True):
            block = content[at + a : at + b]
            if zlib.crc32(block) != crc:
                raise ValueError("a block is damaged")
            yield decode_block(block, n, table)

    return doc_ids, is_null, counts, blocks()


def write_archive(
    docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, docs_per_range: int = 4096, column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Files (``file_no``, ``n_docs``, ``n_ids``, ``content``) in ascending order of ids, and the frequencies (``token``, ``frequency``).

    Quantiles of the ids cut the corpus into ranges; each range is sorted in
    one task and tokenized into files of a few megabytes of text.
    """
    rows = docs.count()
    ranges = max(8, min(10_000, -(-rows // docs_per_range)))  # larger ranges beyond; the driver holds one cut for each
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            at = np.searchsorted(np.array(cuts, np.int64), keys.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            texts = [squeeze.compress(x) for x in binary(batch.column(column)).to_pylist()]
            yield pa.RecordBatch.from_pydict({"range": at.astype(np.int32), "doc_id": keys, "packed": pa.array(texts, pa.binary())})

    def tokenized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, squeeze, open_ = encoder(tokenizer), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        counts = np.zeros(vocabulary, np.int64)
        names = ["file_no", "doc_ids", "is_null", "counts", "ids", "frequencies"]
        seen: dict[int, int] = {}

        def file(span: int, keys: list, texts: list[bytes]) -> pa.RecordBatch:
            # ``keys`` and ``texts`` are one file's
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(x) for x in texts], out=offsets[1:])
            ids, at = tokens.encode(data, offsets)
            ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
            counts[:] += np.bincount(ids, minlength=vocabulary)
            number = (span << 24) + seen.get(span, 0)
            seen[span] = seen.get(span, 0) + 1
            made = [
                number,
                np.array([k or 0 for k in keys], "<i8").tobytes(),
                np.array([k is None for k in keys], np.uint8).tobytes(),
                np.diff(at).astype("<i8").tobytes(),
                squeeze.compress(ids.astype(width).tobytes()),
                None,
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([made[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in made[1:])], names=names
            )

        span, keys, texts, size = 0, [], [], 0
        for batch in batches:
            for r, key, text in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "packed")), strict=True):
                if keys and (r != span or size > TOKEN_CHUNK):
                    yield file(span, keys, texts)
                    keys, texts, size = [], [], 0
                span = r
                keys.append(key)
                texts.append(open_.decompress(text))
                size += len(texts[-1])
        if keys:
            yield file(span, keys, texts)
        tokens.rest()
        if counts.any():
            used = np.flatnonzero(counts)
            pairs = np.stack([used, counts[used]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), *(pa.array([None], pa.binary()) for _ in range(4)), pa.array([pairs], pa.binary())],
                names=names,
            )

    sent = docs.select("doc_id", column).mapInArrow(packed, "range int, doc_id long, packed binary")
    ordered = sent.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "doc_id", "packed")
    held = written(
        ordered.mapInArrow(
            tokenized, "file_no long, doc_ids binary, is_null binary, counts binary, ids binary, frequencies binary"
        )
    )

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                token, n = np.frombuffer(x, "<i8").reshape(-1, 2).T
                total[token] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": used, "n": total[used]})

    sums = held.where("frequencies is not null").select("frequencies").mapInArrow(counted, "token long, n long")
    totals = np.zeros(vocabulary, np.int64)
    for r in sums.groupBy("token").agg(F.sum("n").alias("n")).collect():  # at most one row for each token
        totals[r.token] = r.n
    frequency = scaled(totals)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequency)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, open_ = Table(shared.value), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = np.frombuffer(open_.decompress(r["ids"]), width).astype(np.uint32)
                fields = [np.frombuffer(r[c], k) for c, k in (("doc_ids", "<i8"), ("is_null", "u1"), ("counts", "<i8"))]
                content = encode_file(*fields, ids, table)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["file_no"]], pa.int64()),
                        pa.array([len(fields[0])], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([content], pa.binary()),
                    ],
                    names=["file_no", "n_docs", "n_ids", "content"],
                )

    parts = held.where("file_no is not null").select("file_no", "doc_ids", "is_null", "counts", "ids")
    files = written(parts.mapInArrow(coded, "file_no long, n_docs long, n_ids long, content binary"))
    used = np.flatnonzero(frequency)
    table = spark.createDataFrame(list(zip(used.tolist(), frequency[used].tolist(), strict=True)), "token long, frequency long")
    return files, table


def read_archive(files: DataFrame, table: DataFrame, vocabulary: int) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    frequency = np.zeros(vocabulary, np.int64)
    for r in table.collect():  # at most one row for each token
        frequency[r.token] = r.frequency
    shared = files.sparkSession.sparkContext.broadcast(frequency)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for number, content in zip(batch.column("file_no").to_pylist(), batch.column("content").to_pylist(), strict=True):
                doc_ids, is_null, counts, blocks = decode_file(content, table)
                ends = np.cumsum(counts)
                crc, doc, at, done = np.zeros(len(counts), np.int64), 0, 0, 0
                for block in blocks:
                    block = block.astype("<u4")
                    while at < done + len(block):
                        upto = min(int(ends[doc]), done + len(block))
                        crc[doc] = zlib.crc32(block[at - done : upto - done], int(crc[doc]))
                        at = upto
                        doc += at == ends[doc]
                    done += len(block)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file_no": np.full(len(counts), number, np.int64),
                        "doc_id": pa.array(doc_ids, pa.int64(), mask=is_null.astype(bool)),
                        "here": ends - counts,
                        "n_tokens": counts,
                        "ids_crc32": crc,
                    }
                )

    rows = files.select("file_no", "content").mapInArrow(
        decoded, "file_no long, doc_id long, here long, n_tokens long, ids_crc32 long"
    )
    # Ids before each file: sums of spans of files first, so that no task sees all files.
    sizes = files.select("file_no", "n_ids", (F.shiftright("file_no", 32)).alias("span"))
    spans = sizes.groupBy("span").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_span"))
    inside = Window.partitionBy("span").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(spans, "span")
    bases = bases.select("file_no", (F.col("before") + F.col("before_span")).alias("base"))
    joined = rows.join(bases, "file_no")
    return joined.select("doc_id", (F.col("here") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
