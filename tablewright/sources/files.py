"""CSV and Parquet files, and the manifest of a landing folder."""

import _hashlib
import ctypes
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import SourceError
from tablewright.operators.result import quoted

_INTEGER = r"^-?\d+$"
_FLOAT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^[-+]?inf$|^NaN$"
_BOOLEAN = "^(true|false)$"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession, path: str, infer_rows: int | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Comma-separated files with a header line.

    Columns are integers, floats, booleans or text; dates stay text. Types
    come from all rows of all files, or from ``infer_rows`` of them if given, and a later cell that
    does not fit its type is an error rather than a silent null. Files whose headers
    have another order are read by the names of their columns; headers with other names are an error.
    Files are split over many tasks, also where quoted cells hold line breaks, which ``multi_line=None`` finds out
    by itself: see ``split_records``. ``multi_line=True`` reads each file in one task.
    """
    headers, broken = _look(spark, path)
    if multi_line is None and broken and len(headers) == 1:
        records = split_records(spark, path)
        if records is not None:
            names = spark.read.options(header=True, escape='"', enforceSchema=False).csv(path).columns
            return _parsed(records, names, infer_rows)
    if multi_line is None:
        multi_line = broken
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "enforceSchema": False}
    reader = spark.read.options(**options)
    groups = [path] if len(headers) < 2 else [_paths(headers, h) for h in headers]
    texts = [reader.csv(g) for g in groups]
    if any(set(t.columns) != set(texts[0].columns) for t in texts):
        raise SourceError(f"the files in '{path}' do not share one set of columns")
    text = texts[0]
    for other in texts[1:]:
        text = text.unionByName(other)
    types = _infer(text if infer_rows is None else text.limit(infer_rows))
    frames = [spark.read.options(**options).schema(T.StructType([types[c] for c in t.columns])).csv(g) for t, g in zip(texts, groups)]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


# A line that begins a record, or one that begins inside quotes, ends inside quotes. Nothing is matched in two ways, so
# all repetitions are possessive, which also keeps Java from recursion.
_FIELDS = r"""(?:"(?:[^"]++|"")*+"[^,"]*+,|[^",][^,]*+,|,)*+"(?:[^"]++|"")*+$"""
_OPENS = rf"^{_FIELDS}"
_STAYS = r"""^(?:[^"]++|"")*+$"""
_REOPENS = rf"""^(?:[^"]++|"")*+"[^,"]*+,{_FIELDS}"""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of each split, with the state each ends in, by the state it begins in: inside quotes or not."""
    lines = spark.read.option("lineSep", "\n").text(path)
    has = F.contains("value", F.lit('"'))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.coalesce(has & F.col("value").rlike(_OPENS), F.lit(False)).alias("fresh"),
        (~has | F.col("value").rlike(_STAYS) | F.col("value").rlike(_REOPENS)).alias("inside"),
        "value",
    )


def split_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records (``record``) of CSV files without their headers, read in splits though cells hold line breaks.

    Whether a split begins inside a quoted cell follows from the splits before it. A first pass finds for each
    split in which of the two states it ends, for either state that it may begin in; these are
    put together on the driver, one small row a split. A second pass then cuts each split into records; what goes
    over the end of a split, a piece or two of each, is put together by file. None where this cannot be done: a header that goes over its line,
    or line ends other than ``\\n`` and ``\\r\\n``.
    """
    lines = _lines(spark, path)

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, first, odd = None, [False, True], False, False
        made: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "start", "fresh", "inside", "odd")]
            for file, start, fresh, inside, strange in zip(*columns, strict=True):
                if key != (file, start):
                    if key is not None:
                        made.append((*key, *states, first, odd))
                    key, states, first, odd = (file, start), [False, True], fresh, False
                states = [inside if s else fresh for s in states]
                odd = odd or strange
        if key is not None:
            made.append((*key, *states, first, odd))
        names = ["file", "start", "fresh", "inside", "first", "odd"]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=names)

    odd = F.contains(F.rtrim("value", F.lit("\r")), F.lit("\r")).alias("odd")
    found = lines.select("file", "start", "fresh", "inside", odd).mapInArrow(
        ends, "file string, start long, fresh boolean, inside boolean, first boolean, odd boolean"
    )
    begins: dict[tuple[str, int], bool] = {}
    state, last = False, None
    for row in sorted(found.collect(), key=lambda r: (r.file, r.start)):  # one row a split
        if row.odd or (row.start == 0 and row["first"]):
            return None
        state = state if row.file == last else False
        begins[row.file, row.start] = state
        state, last = (row.inside if state else row.fresh), row.file

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: a whole record; 1: what a split begins with, inside a record; 2: a record that a split does not end."""
        key, state, kind, held = None, False, 0, []
        made: list[tuple] = []

        def flush(kind: int) -> None:
            made.append((*key, kind, "\n".join(held)))
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "start", "fresh", "inside", "value")]
            for file, start, fresh, inside, value in zip(*columns, strict=True):
                if key != (file, start):
                    if held:
                        flush(1 if kind == 1 else 2)
                    key, state = (file, start), begins[file, start]
                    kind = 1 if state else 0
                    if start == 0:  # the header
                        state = False
                        continue
                held.append(value)
                state = inside if state else fresh
                if not state:
                    flush(3 if kind == 1 else 0)  # 3: the end of a record that an earlier split began
                    kind = 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=_PIECES)
                made.clear()
        if held:
            flush(1 if kind == 1 else 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=_PIECES)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, []
        for batch in batches:
            out = []
            for name, piece, kind in zip(*(batch.column(c).to_pylist() for c in ("file", "record", "kind")), strict=True):
                if held and (name != file or kind == 2):
                    out.append("\n".join(held))
                    held = []
                file = name
                held.append(piece)
                if kind == 3:
                    out.append("\n".join(held))
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], names=["record"])

    pieces = lines.mapInArrow(records, "file string, start long, kind long, record string")
    whole = pieces.where("kind = 0").select("record")
    # In a split, what ends or goes on an earlier record comes before what begins one.
    broken = pieces.where("kind > 0").repartition("file").sortWithinPartitions("file", "start", F.col("kind") == 2)
    return whole.unionByName(broken.mapInArrow(joined, "record string"))


_PIECES = ["file", "start", "kind", "record"]


def _parsed(records: DataFrame, names: list[str], infer_rows: int | None) -> DataFrame:
    """Records as columns, with types as ``read_csv`` finds them."""
    kept = records.select(F.rtrim("record", F.lit("\r")).alias("record")).where(F.trim("record") != "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = F.from_csv("record", F.lit(schema.simpleString()[7:-1].replace(":", " ")), {"escape": '"', "mode": "FAILFAST", "maxCharsPerColumn": "-1"})
    text = kept.select(cells.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    types = _infer(text if infer_rows is None else text.limit(infer_rows))
    return text.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in types])


def _look(spark: SparkSession, path: str) -> tuple[dict[str, list[str]], bool]:
    """The files of each header line, and whether a cell goes on in the next line.

    One pass over the lines: the first line of a file is the first of the task that reads
    its first block, and only a line with an odd number of quotes can go on.
    """
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"),
        "value",
        (quotes % 2 == 1).alias("open"),
    )
    files = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.bool_or("open").alias("open"))
    # One row for each distinct header.
    found = files.groupBy("header").agg(F.collect_list("file").alias("files"), F.bool_or("open").alias("open")).collect()
    return {r["header"]: sorted(r["files"]) for r in found}, any(r["open"] for r in found)


def _paths(headers: dict[str, list[str]], header: str) -> list[str]:
    """Paths that are read as they are, though they may hold signs of a glob."""
    return [_literal(f) for f in headers[header]]


def _literal(file: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _infer(text: DataFrame) -> T.StructType:
    wanted: list[Column] = []
    for name in text.columns:
        c = F.col(quoted(name))
        wanted += [F.count(c), F.count_if(c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull())]
        wanted += [F.count_if(c.rlike(_FLOAT)), F.count_if(F.lower(c).rlike(_BOOLEAN))]
    found = list(text.agg(*wanted).first()) if wanted else []
    fields = []
    for i, name in enumerate(text.columns):
        some, integers, floats, booleans = found[4 * i : 4 * i + 4]
        dtype: T.DataType = T.StringType()
        if some and integers == some:
            dtype = T.LongType()
        elif some and floats == some:
            dtype = T.DoubleType()
        elif some and booleans == some:
            dtype = T.BooleanType()
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def kind_of(name: Column) -> Column:
    """Source kind from a file name; null for an extension that is not supported."""
    lower = F.lower(name)
    return (
        F.when(lower.endswith(".csv"), "csv")
        .when(lower.endswith(".parquet"), "parquet")
        .when(lower.endswith(".xlsx") | lower.endswith(".xls"), "xlsx")
    )


def safe_name(name: Column) -> Column:
    """File name with only letters, digits, dot, underscore and hyphen, and no leading dot."""
    cleaned = F.ltrim(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.lit("."))
    return F.when(cleaned == "", "upload").otherwise(cleaned)


def _openssl() -> ctypes.CDLL:
    """The library behind hashlib. Its SHA-256 context is plain bytes, which another process can go on from."""
    return ctypes.CDLL(getattr(_hashlib, "__file__", None))


def split_digests(spark: SparkSession, lengths: dict[str, int]) -> dict[str, str]:
    """The SHA-256 of whole files, given by ``_metadata.file_path`` and length, though a task reads one split of a file.

    A digest is sequential, so the splits of a file are read one after the other, each in a job of its own that all
    files share; the context of the digest, some hundred bytes, goes from each to the next. Splits are
    read as lines ended by ``\\n`` alone, whose bytes Spark leaves as they are. It drops a byte order mark at the beginning and the last line end;
    both follow from the length, so two contexts are kept, one of them after such a mark.
    """
    context = spark.sparkContext
    columns = [F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")]
    files = {f: spark.read.option("lineSep", "\n").text(_literal(f)).select(*columns) for f in lengths}
    counts = {f: df.rdd.getNumPartitions() for f, df in files.items()}

    def updated(state: bytes, data: bytes) -> bytes:
        import _hashlib
        import ctypes

        held = ctypes.create_string_buffer(bytes(state), 256)
        ctypes.CDLL(getattr(_hashlib, "__file__", None)).SHA256_Update(held, data, ctypes.c_size_t(len(data)))
        return held.raw

    def going_on(file: str, state: tuple) -> DataFrame:
        def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, marked, lines, size, last = state
            for batch in batches:
                for data in (b"\n" if lines and batch.num_rows else b"", b"\n".join(batch.column("line").to_pylist())):
                    plain, marked, size = updated(plain, data), updated(marked, data), size + len(data)
                lines += batch.num_rows
                for start in batch.column("start").unique().to_pylist():
                    if start < last:
                        raise ValueError("the splits of a file are not in order")
                    last = start
            after = [file, plain, marked, lines, size, last]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in after], names=names)

        names = ["file", "plain", "marked", "lines", "size", "last"]
        return files[file].mapInArrow(step, "file string, plain binary, marked binary, lines long, size long, last long")

    fresh = ctypes.create_string_buffer(256)
    _openssl().SHA256_Init(fresh)
    # By file: the contexts without and with a byte order mark, lines and bytes so far, where the last split began.
    state = {f: (fresh.raw, updated(fresh.raw, b"\xef\xbb\xbf"), 0, 0, 0) for f in lengths}
    for turn in range(max(counts.values())):
        now = [f for f in lengths if turn < counts[f]]
        together = context.union([going_on(f, state[f]).rdd for f in now])
        begins = [sum(counts[f] for f in now[:i]) for i in range(len(now))]
        ran = context.runJob(together, list, [begin + turn for begin in begins])  # one row a file
        state.update({file: tuple(after) for file, *after in ran})
    out = {}
    for file, (plain, marked, _, size, _) in state.items():
        left = lengths[file] - size  # 1: the last line is ended; 3: there is a byte order mark; 4: both
        if left not in (0, 1, 3, 4):
            raise SourceError(f"'{file}' has {lengths[file]} bytes, not those that were read")
        held = ctypes.create_string_buffer(updated(marked if left > 1 else plain, b"\n" if left in (1, 4) else b""), 256)
        digest = ctypes.create_string_buffer(32)
        _openssl().SHA256_Final(digest, held)
        out[file] = digest.raw.hex()
    return out


# Names that Spark's text reader unpacks, so that its lines are not the bytes of the file.
_PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$"


def file_manifest(
    spark: SparkSession, path: str, size_cap: int | None = None, whole_bytes: int = 128 * 1024 * 1024
) -> DataFrame:
    """One line per file of a landing folder: names, kind, size, digest, and what is wrong with it.

    Files above ``size_cap``, if given, are listed from the directory alone; their content is
    never read, as the size filter is applied before the file is opened. Files up to ``whole_bytes`` are read as one
    cell. Larger ones are digested split by split when the manifest is made, see ``split_digests``; only those
    that Spark would unpack are read as one cell at any size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size_cap = 2**63 - 1 if size_cap is None else size_cap
    size = F.col("length")
    digested = F.sha2("content", 256).alias("sha256")
    fitting = files.filter(size <= min(size_cap, whole_bytes)).select("path", "length", digested)
    too_large = files.filter(size > size_cap).select("path", "length", F.lit(None).cast("string"))
    named = fitting.unionAll(too_large)
    # One row a file above whole_bytes.
    large = files.filter((size > whole_bytes) & (size <= size_cap)).select("path", "length", F.col("_metadata.file_path").alias("file")).collect()
    split = [r for r in large if hasattr(_openssl(), "SHA256_Update") and not re.search(_PACKED, r.file)]
    if split:
        found = split_digests(spark, {r.file: r.length for r in split})
        named = named.unionAll(spark.createDataFrame([(r.path, r.length, found[r.file]) for r in split], named.schema))
    rest = [_literal(r.file) for r in large if r not in split]
    if rest:
        named = named.unionAll(spark.read.format("binaryFile").load(rest).select("path", "length", digested))
    base = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    named = named.withColumn("original_name", base)
    name = F.col("original_name")
    kind = kind_of(name)
    return named.select(
        "path",
        "original_name",
        safe_name(name).alias("safe_name"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("dataset_name"),
        kind.alias("kind"),
        F.col("length").alias("size_bytes"),
        "sha256",
        F.when(kind.isNull(), "unsupported file extension")
        .when(F.col("length") > size_cap, "file too large")
        .alias("error"),
    )


def require_supported(manifest: DataFrame) -> DataFrame:
    """The manifest, or an error that names the first file which cannot be taken."""
    bad = manifest.filter(F.col("error").isNotNull()).orderBy("path").first()
    if bad is not None:
        raise SourceError(f"{bad['error']}: '{bad['original_name']}'")
    return manifest
