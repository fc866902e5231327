"""How often each value occurs in each column: the table behind profiles, modes and top lists.

All columns are unpivoted into (column, value) cells and counted in one
shuffle. Counting starts on the map side, so a value that fills a third of a
column travels once per task. Values keep their type: there is one value slot
per type in the table, which spares numbers the detour through text.

Long text is counted under its beginning and a digest, so whole documents
neither travel nor are sorted. Where the text itself is asked for, it is
fetched for the few values that are left.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.result import quoted

LONG = 64  # bytes from which text is counted by digest
HEAD = 32  # characters of it that stay, for the order
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _as_cell(df: DataFrame, column: str) -> tuple[Column, T.DataType]:
    dtype = df.schema[column].dataType
    c = F.col(quoted(column))
    if isinstance(dtype, _INTEGRAL):
        return c.cast("bigint"), T.LongType()
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c), T.StringType()
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c, T.StringType()
    return c, dtype


def _all_null(slots: list[str]) -> Column:
    missing = F.lit(True)
    for s in slots:
        missing = missing & F.col(s).isNull()
    return missing


@dataclass(frozen=True)
class Frequencies:
    """``table`` has ``column`` (position as text), one slot ``v0, v1, ...`` per type, and ``n``.

    With text among the columns it also has ``digest``, set where the slot holds just the beginning.
    """

    table: DataFrame
    columns: list[str]
    slot_types: list[T.DataType]
    slot_of: list[int]
    cells: DataFrame

    @property
    def slots(self) -> list[str]:
        return [f"v{i}" for i in range(len(self.slot_types))]

    def is_null(self) -> Column:
        return _all_null(self.slots)

    def as_text(self) -> Column:
        return F.coalesce(*[F.col(s).cast("string") for s in self.slots])

    @property
    def text_slot(self) -> str | None:
        kinds = [isinstance(t, T.StringType) for t in self.slot_types]
        return f"v{kinds.index(True)}" if any(kinds) else None

    def _texts(self) -> list[tuple[str, str]]:
        """Position and cell of each column of text."""
        return [(str(i), f"c{i}") for i, k in enumerate(self.slot_of) if f"v{k}" == self.text_slot]

    def text_ranges(self) -> DataFrame:
        """``column``, ``lowest`` and ``highest`` of each column of text, in one scan that shuffles no rows."""
        lines = [F.struct(F.lit(i).alias("column"), F.min(c).alias("lowest"), F.max(c).alias("highest")) for i, c in self._texts()]
        return self.cells.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))

    def extreme(self, pick) -> Column:
        """Smallest or largest value as text, except of text columns; NaN only where nothing else is there."""
        found = [F.lit(None).cast("string")]
        for s, dtype in zip(self.slots, self.slot_types):
            if s == self.text_slot:
                continue
            c = F.col(s)
            if isinstance(dtype, (T.FloatType, T.DoubleType)):
                c = F.coalesce(pick(F.when(~F.isnan(c), c)), pick(c))
            else:
                c = pick(c)
            found.append(c.cast("string"))
        return F.coalesce(*found)

    def top(self, n: int) -> DataFrame:
        """The ``n`` most frequent values of each column, ties by value, nulls first.

        Spark keeps only ``n`` rows per column and task before the shuffle of
        this window, so a column with very many values does not pile up.
        """
        order = [F.desc("n"), *[F.asc_nulls_first(s) for s in self.slots]]
        by_column = W.partitionBy("column").orderBy(*order)
        if self.text_slot is None:
            return self.table.withColumn("rank", F.row_number().over(by_column)).filter(F.col("rank") <= n)
        # Values that agree in count and beginning share a rank, so none that may win is lost here.
        near = self.table.withColumn("rank", F.rank().over(by_column)).filter(F.col("rank") <= n).drop("rank")
        near = near.join(self._fetched(near), ["column", "digest"], "left")
        near = near.withColumn(self.text_slot, F.coalesce("text", self.text_slot)).drop("text", "digest")
        return near.withColumn("rank", F.row_number().over(by_column)).filter(F.col("rank") <= n)

    def _fetched(self, near: DataFrame) -> DataFrame:
        """``column``, ``digest`` and ``text`` of the long values in ``near``.

        Their beginnings are few, at most as many for each column as ranks were asked for, so
        they are broadcast; only text that begins alike is shuffled, once a task and value.
        """
        heads = near.filter("digest IS NOT NULL").select("column", F.col(self.text_slot).alias("head")).distinct()
        texts = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("text")) for i, c in self._texts()])
        long = self.cells.select(F.inline(texts)).filter(F.octet_length("text") > LONG)
        alike = long.withColumn("head", F.left("text", F.lit(HEAD))).join(F.broadcast(heads), ["column", "head"], "left_semi")
        return alike.groupBy("column", F.sha2("text", 256).alias("digest")).agg(F.min("text").alias("text"))


def frequencies(df: DataFrame, columns: list[str], nulls: bool = True) -> Frequencies:
    """Count each distinct value of each column; ``nulls`` says whether null is a value."""
    cells, types, slot_of, digests = [], [], [], []
    for i, column in enumerate(columns):
        cell, dtype = _as_cell(df, column)
        if dtype not in types:
            types.append(dtype)
        slot_of.append(types.index(dtype))
        cells.append(cell.alias(f"c{i}"))
        if isinstance(dtype, T.StringType):
            digests.append(f"c{i}")
    whole = df.select(*cells)
    long = {c: F.octet_length(c) > LONG for c in digests}
    heads = {c: F.when(long[c], F.left(c, F.lit(HEAD))).otherwise(F.col(c)).alias(c) for c in digests}
    marks = [F.when(long[c], F.sha2(c, 256)).alias(f"d{c}") for c in digests]
    empty = [F.lit(None).cast(t).alias(f"e{k}") for k, t in enumerate(types)]
    keys = [f"v{k}" for k in range(len(types))] + (["digest"] if digests else [])
    if digests:
        empty.append(F.lit(None).cast("string").alias("none"))
    sources = ", ".join(
        "("
        + ", ".join(f"c{i}" if k == slot_of[i] else f"e{k}" for k in range(len(types)))
        + (f", dc{i}" if f"c{i}" in digests else ", none" if digests else "")
        + f") AS `{i}`"
        for i in range(len(columns))
    )
    unpivoted = df.sparkSession.sql(
        f"SELECT * FROM {{cells}} UNPIVOT INCLUDE NULLS (({", ".join(keys)}) FOR `column` IN ({sources}))",
        cells=whole.select(*[heads.get(c, F.col(c)) for c in whole.columns], *marks, *empty),
    )
    if not nulls:
        unpivoted = unpivoted.filter(~_all_null([f"v{k}" for k in range(len(types))]))
    table = unpivoted.groupBy("column", *keys).agg(F.count(F.lit(1)).alias("n"))
    return Frequencies(table, list(columns), types, slot_of, whole)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the lowest one on a tie; all-null columns are absent."""
    if not columns:
        return {}
    counted = frequencies(df, columns, nulls=False)
    found = {}
    for row in counted.top(1).collect():
        i = int(row["column"])
        found[columns[i]] = row[f"v{counted.slot_of[i]}"]
    return found
