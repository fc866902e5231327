"""Which columns, or combinations of columns, identify a row.

Combinations are tried level by level, smaller ones first. A combination is only looked at if it
can be a key at all: it holds no key found before, and the distinct counts of what it is made of, multiplied, reach the
number of rows. Those that are left share one scan with a sketch each, and only those
whose sketch comes near enough are counted exactly. Where no value may repeat, combinations are not sketched: all rows of some values of
their column of most values are looked at instead, a part of the table, and those that repeat nothing there are counted.
"""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import OperationError
from tablewright.operators.dedupe import row_keys
from tablewright.operators.result import data_columns, quoted, require_columns

_SKETCH = 12  # the sketches have 2**12 places, which errs by 1.6 per cent
_SLACK = 0.08  # a sketch may lie so far off before a combination is given up
_SLICES = 16  # a key must hold in a slice of the rows as well, which has all rows of its values
_TOGETHER = 200  # sketches of one scan
_COUNTED = 32  # combinations counted in one shuffle
_NO_KEYS = (T.FloatType, T.DoubleType, T.BooleanType, T.ArrayType, T.StructType, T.MapType, T.VariantType, T.BinaryType)

KEYS = "columns array<string>, rows long, distinct_count long, duplicates long"


def key_candidates(df: DataFrame) -> list[str]:
    """Columns whose type may identify something: no fractions, flags, bytes or nested values."""
    return [c for c in data_columns(df) if not isinstance(df.schema[c].dataType, _NO_KEYS)]


def find_keys(
    df: DataFrame,
    columns: list[str] | None = None,
    max_size: int = 3,
    min_share: float = 1.0,
    normalize_text: bool = False,
    all_levels: bool = False,
) -> list[dict]:
    """Minimal combinations of at most ``max_size`` columns with at least ``min_share`` x rows distinct values.

    With a share of 1 these are the keys of the table; a lower one also finds what was meant as a key but has
    some repeated rows. Columns with more nulls than the share leaves open are no part of a key; a null is a value like others in the rest.
    ``normalize_text`` compares text as ``dedupe`` does. The search ends at the first size
    that has keys unless ``all_levels``. Counts are exact; combinations come by size, then in the order of the columns.
    An empty table has no keys.
    """
    columns = key_candidates(df) if columns is None else require_columns(df, columns, "find_keys")
    if max_size < 1 or not 0 < min_share <= 1:
        raise OperationError("'max_size' is at least 1, and 'min_share' above 0 and at most 1")
    if not columns:
        return []
    keys = dict(zip(columns, row_keys(df, columns, normalize_text), strict=True))
    row = df.agg(F.count(F.lit(1)), *[F.count(quoted(c)) for c in columns]).first()
    rows, some = row[0], dict(zip(columns, row[1:], strict=True))
    place = {c: f"{'k' if some[c] == rows else 'g'}{i}" for i, c in enumerate(columns)}  # g: with gaps
    cells = df.select(*[keys[c].alias(place[c]) for c in columns])
    usable = [c for c in columns if rows - some[c] <= (1 - min_share) * rows]
    wanted = min_share * rows
    if not rows:
        return []
    bound: dict[tuple, float] = {(): 1.0}  # at most so many distinct values, if the sketches keep what they promise
    found: list[dict] = []
    for size in range(1, max_size + 1):
        open_ = []
        for combination in combinations(usable, size):
            if any(set(f["columns"]) <= set(combination) for f in found):
                continue
            if size > 1:
                parts = [(combination[:i] + combination[i + 1 :], (combination[i],)) for i in range(size)]
                bound[combination] = min([rows, *(bound[a] * bound[b] for a, b in parts if a in bound and b in bound)])
                if bound[combination] < wanted:
                    continue
            open_.append(combination)
        near = []
        sketched = open_ if size == 1 or min_share < 1 else []
        for at in range(0, len(sketched), _TOGETHER):
            some_ = sketched[at : at + _TOGETHER]
            sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*_marked([place[c] for c in x])), _SKETCH)) for x in some_]
            for combination, distinct in zip(some_, cells.agg(*sketches).first(), strict=True):
                bound[combination] = distinct * (1 + _SLACK)
                if distinct * (1 + _SLACK) >= wanted:
                    near.append(combination)
        near = near if sketched else open_
        if min_share == 1:
            near = _unrepeated(cells, near, place, bound)
        for at in range(0, len(near), _COUNTED):
            some_ = near[at : at + _COUNTED]
            for combination, (_, distinct) in zip(some_, _counted(cells, [[place[c] for c in x] for x in some_], spread=True), strict=True):
                bound[combination] = min(bound[combination], distinct)
                if distinct >= wanted:
                    found.append({"columns": list(combination), "rows": rows, "distinct_count": distinct, "duplicates": rows - distinct})
        if found and not all_levels:
            break
    return found


def _unrepeated(cells: DataFrame, combinations_: list[tuple], place: dict[str, str], bound: dict[tuple, float]) -> list[tuple]:
    """Those combinations that repeat no value in a slice of the rows, which is cheaper to look at than all rows.

    A slice is cut by the column of most values, so that rows with one value of the combination are in it together.
    """
    by_column: dict[str, list[tuple]] = {}
    for x in combinations_:
        by_column.setdefault(max(x, key=lambda c: bound[(c,)]), []).append(x)
    left = set()
    for column, mine in by_column.items():
        rows = cells.where(F.pmod(F.xxhash64(place[column]), F.lit(_SLICES)) == 0)
        rows = rows.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a table may be few files
        for at in range(0, len(mine), _COUNTED):
            some = mine[at : at + _COUNTED]
            held = _counted(rows, [[place[c] for c in x] for x in some])
            left |= {x for x, (n, distinct) in zip(some, held, strict=True) if n == distinct}
    return [x for x in combinations_ if x in left]


def _counted(cells: DataFrame, combinations_: list[list[str]], spread: bool = False) -> list[tuple[int, int]]:
    """Rows and distinct values of each combination, all counted in one shuffle by digests of 128 bits.

    Different digests are of different values, so a key that is found is one. Values that hardly
    repeat are ``spread`` before they are counted, as a first count in each task would hold nearly all of them and add up nothing.
    """
    if not combinations_:
        return []
    digests = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(1), *_marked(x)).alias("a"), F.xxhash64(F.lit(2), *_marked(x)).alias("b"))
            for i, x in enumerate(combinations_)
        ]
    )
    rows = cells.select(F.inline(digests))
    rows = rows.repartition("i", "a", "b") if spread else rows
    values = rows.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.i: (r.n, r.distinct) for r in values.groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    return [counts.get(i, (0, 0)) for i in range(len(combinations_))]


def _marked(names: list[str]) -> list:
    """Cells with a mark for null, which hashes skip, where there are nulls."""
    return [c for name in names for c in ((F.col(name), F.col(name).isNull()) if name.startswith("g") else (F.col(name),))]


def key_report(df: DataFrame, **how) -> DataFrame:
    """The keys that ``find_keys`` finds, as a table."""
    return df.sparkSession.createDataFrame([tuple(k.values()) for k in find_keys(df, **how)], KEYS)


def null_cells(df: DataFrame, columns: list[str]):
    """How many of the columns are null in a row."""
    empty = F.lit(0)
    for c in columns:
        empty = empty + F.col(quoted(c)).isNull().cast("int")
    return empty
