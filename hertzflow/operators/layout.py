"""Ordered rows: the base of every row-frame operator.

A window over one long series is one task. Here rows are ordered once by a range
shuffle over (series, order), get a gap-free global position, and are then
windowed in chunks of positions. A chunk carries copies of the few rows before
and after it that its frames can reach, so a bounded ROWS frame gives the same
result as the window over the whole series, while no task holds more than a
chunk. Range bounds are sampled from the data: a hot series, a hot hour or a
burst of rows is split like any other run of rows. ``order`` must be unique
within a series; add an id column as tie-break.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import work_path

POS = "_pos"
CHUNK = "_chunk"
_LOCAL = "_local"
_PART = "_part"
_SEED = "_seed"
_LAYOUT_SCHEMA = (
    "columns string, series array<string>, `order` array<string>, "
    "parts array<struct<part: bigint, start: bigint>>, total bigint"
)

MIN_CHUNK = 1024
# Window partitions up to this many rows are held as plain rows in memory; it is the
# default of spark.sql.windowExec.buffer.in.memory.threshold.
WINDOW_BUFFER = 4096
FAN_IN = 1024
TOP_LEVEL = 100_000


@dataclass(frozen=True)
class Frames:
    """Rows with their halo copies, and the window they are to be read with."""

    rows: DataFrame
    window: WindowSpec
    chunk_rows: int
    haloed: bool

    def over(self, start: int, end: int) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    def trim(self, rows: DataFrame) -> DataFrame:
        """Drop the halo copies once all windows are computed."""
        if self.haloed:
            rows = rows.where(F.expr(f"{POS} div {self.chunk_rows}") == F.col(CHUNK))
        return rows.drop(CHUNK)


@dataclass(frozen=True)
class OrderedRows:
    df: DataFrame
    series: tuple[str, ...]
    order: tuple[str, ...]
    total: int
    chunk_rows: int | None = None

    def with_df(self, df: DataFrame) -> OrderedRows:
        """Same positions, other columns. ``df`` may hold fewer rows: any for ``running``,
        for ``framed`` only if those left of a series are an unbroken run."""
        return OrderedRows(df, self.series, self.order, self.total, self.chunk_rows)

    def chunk_size(self, before: int = 0, after: int = 0) -> int:
        if self.chunk_rows:
            return max(self.chunk_rows, 1)
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        halo = before + after + 1
        floor = max(MIN_CHUNK, 4 * halo)
        return max(floor, min(WINDOW_BUFFER - halo, self.total // (8 * cores)))

    def _levels(self, first: int) -> list[int]:
        """Block sizes of a prefix scan: totals of totals until few enough are left."""
        levels, left = [first], self.total // first
        while left > TOP_LEVEL:
            levels.append(FAN_IN)
            left //= FAN_IN
        return levels

    def framed(self, before: int = 0, after: int = 0) -> Frames:
        """Chunked rows whose frames reach ``before`` rows back and ``after`` rows on."""
        size = self.chunk_size(before, after)
        haloed = bool(before or after)
        if haloed:
            chunk = F.explode(F.expr(f"sequence(({POS} - {after}) div {size}, ({POS} + {before}) div {size})"))
        else:
            chunk = F.expr(f"{POS} div {size}")
        window = Window.partitionBy(CHUNK, *self.series).orderBy(POS)
        return Frames(self.df.withColumn(CHUNK, chunk), window, size, haloed)

    def running(
        self,
        specs: Mapping[str, tuple[str, Column]],
        *,
        backward: bool = False,
        exclusive: bool = False,
        initial: DataFrame | None = None,
    ) -> DataFrame:
        """Add running values along each series: ``{name: (kind, expr)}``.

        ``kind`` is ``last`` (last non-null value), ``sum``, ``min`` or ``max``.
        ``initial`` gives a start value per series under the same names.

        The rows are read twice, for the block totals and for the result. Put
        this on a written table or a projection of one, not on costly steps.
        """
        df = self.df.withColumns({name: expr for name, (_, expr) in specs.items()})
        kinds = {name: kind for name, (kind, _) in specs.items()}
        levels = self._levels(self.chunk_size())
        return _scan(df, list(self.series), POS, kinds, levels, backward, exclusive, initial)

    def carry(self, points: DataFrame, names: Sequence[str], initial: DataFrame | None = None) -> DataFrame:
        """Give each row the last non-null values of the points at or before its position.

        ``points`` holds the series, a position and ``names``. Points sort just
        before the row of their position, so no join is needed.
        """
        slot = "_slot"
        rows = self.df.withColumn(slot, F.col(POS) * 2 + 1).withColumn("_is_row", F.lit(True))
        marks = points.select(*self.series, (F.col(POS) * 2).alias(slot), *names)
        both = rows.unionByName(marks, allowMissingColumns=True)
        kinds = {name: "last" for name in names}
        size = self.chunk_size()
        levels = [2 * size, *self._levels(size)[1:]]
        out = _scan(both, list(self.series), slot, kinds, levels, False, False, initial)
        return out.where("_is_row").drop(slot, "_is_row")


def order_rows(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    *,
    chunk_rows: int | None = None,
    partitions: int | None = None,
    path: str | None = None,
) -> OrderedRows:
    """Order ``df`` by (series, order) and number its rows from 0 without gaps.

    The ordered rows are written once: both the partition counts and every later
    reader must see the same range bounds, and bounds are sampled anew whenever
    the shuffle is planned anew. With ``path`` the layout is kept there, and
    ``open_rows`` finds it again without ordering anything.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in (*series, *order)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    local = ranged.sortWithinPartitions(*keys).withColumn(_LOCAL, F.monotonically_increasing_id())
    root = path or work_path(spark, "ordered")
    local.write.mode("overwrite").parquet(f"{root}/rows")
    local = spark.read.schema(local.schema).parquet(f"{root}/rows")

    # One row per range partition: bounded by the task count of the shuffle.
    counts = sorted(local.groupBy(F.shiftright(_LOCAL, 33)).count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    if path:
        row = (local.schema.json(), list(series), list(order), starts, total)
        # Written last: a folder with it holds a complete layout.
        spark.createDataFrame([row], _LAYOUT_SCHEMA).write.mode("overwrite").json(f"{root}/layout")
    return _placed(local, series, order, starts, total, chunk_rows)


def open_rows(spark: SparkSession, path: str, *, chunk_rows: int | None = None) -> OrderedRows:
    """A layout kept by ``order_rows(..., path=path)``."""
    row = spark.read.schema(_LAYOUT_SCHEMA).json(f"{path}/layout").first()
    schema = StructType.fromJson(json.loads(row.columns))
    local = spark.read.schema(schema).parquet(f"{path}/rows")
    return _placed(local, row.series, row.order, [tuple(p) for p in row.parts], row.total, chunk_rows)


def _placed(local: DataFrame, series, order, starts, total, chunk_rows) -> OrderedRows:
    columns = [c for c in local.columns if c != _LOCAL]
    offsets = local.sparkSession.createDataFrame(starts, f"{_PART} bigint, _start bigint")
    position = F.col(_LOCAL).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    rows = local.withColumn(_PART, F.shiftright(_LOCAL, 33)).join(F.broadcast(offsets), _PART)
    rows = rows.withColumn(POS, position).select(*columns, POS)
    return OrderedRows(rows, tuple(series), tuple(order), total, chunk_rows)


def _total(kind: str, name: str, pos: str, backward: bool) -> Column:
    if kind == "last":
        pick = F.min_by if backward else F.max_by
        return pick(F.col(name), F.when(F.col(name).isNotNull(), F.col(pos)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](name)


def _over(kind: str, name: str, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(name, ignorenulls=True).over(window)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](name).over(window)


def _scan(df, series, pos, kinds, blocks, backward, exclusive, initial):
    """Prefix scan in levels: totals per block are scanned first and enter each
    block as one seed row, so no level windows an unbounded group."""
    if blocks:
        block_col = f"{pos}_block"
        df = df.withColumn(block_col, F.expr(f"{pos} div {blocks[0]}"))
        totals = df.groupBy(*series, block_col).agg(
            *[_total(kind, name, pos, backward).alias(name) for name, kind in kinds.items()]
        )
        seeds = _scan(totals, series, block_col, kinds, blocks[1:], backward, True, initial)
        window = Window.partitionBy(block_col, *series)
    else:
        seeds = initial
        window = Window.partitionBy(*series) if series else Window.partitionBy(F.lit(0))
    rows = df.withColumn(_SEED, F.lit(False))
    if seeds is not None:
        edge = (1 << 62) if backward else -1
        rows = rows.unionByName(
            seeds.withColumn(_SEED, F.lit(True)).withColumn(pos, F.lit(edge).cast("bigint")),
            allowMissingColumns=True,
        )
    ordering = F.col(pos).desc() if backward else F.col(pos).asc()
    frame = window.orderBy(ordering).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = rows.withColumns({name: _over(kind, name, frame) for name, kind in kinds.items()})
    out = out.where(~F.col(_SEED)).drop(_SEED)
    return out.drop(f"{pos}_block") if blocks else out


def series_row_number(ordered: OrderedRows, name: str = "row_number") -> OrderedRows:
    """Number rows from 1 within each series."""
    start = ordered.running({name: ("min", F.col(POS))})
    return ordered.with_df(start.withColumn(name, F.col(POS) - F.col(name) + 1))
