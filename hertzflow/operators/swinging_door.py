"""Swinging-door compression and the ramp rate between kept points."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from ..storage import stage
from .layout import POS, OrderedRows

SEGMENT_ROWS = 86_400
BLOCK, MAX_BLOCK = 16, 8192
SAMPLE_BLOCKS = 64
# What a scan expects of a segment: already run from this state, door open through it, or
# in step with its own kept points.
KNOWN, OPEN, FALLS_IN = range(3)
SLOPE = "slope"


def _run(t, v, width, at, low, high, known=None, offset=0):
    """Pivots after the one at 0, from the point ``at`` and the corridor before it.

    Returns their mask, and the last pivot with its corridor. From a pivot on nothing
    before it matters: at one that ``known`` (from ``offset``) has too, None is
    returned in place of pivot and corridor, and the rest is as known.
    """
    n = len(v)
    mask = np.zeros(n, dtype=bool)
    times, points = t.tolist(), v.tolist()
    start, size = 0, BLOCK
    while at < n:
        if at <= start + BLOCK:
            # Short runs are quicker point by point.
            gap, rise = times[at] - times[start], points[at] - points[start]
            if gap > 0 and low * gap <= rise <= high * gap:
                low, high, at = max(low, (rise - width) / gap), min(high, (rise + width) / gap), at + 1
                continue
            start = at - 1 if gap > 0 else at
        else:
            # A block of points at once, with the corridor as it is before each of them.
            gap, rise = t[at : at + size] - t[start], v[at : at + size] - v[start]
            with np.errstate(divide="ignore", invalid="ignore"):
                lows = np.maximum.accumulate(np.concatenate([[low], (rise - width) / gap]))
                highs = np.minimum.accumulate(np.concatenate([[high], (rise + width) / gap]))
                same_time = gap <= 0
                ends = same_time | ~((lows[:-1] * gap <= rise) & (rise <= highs[:-1] * gap))
            k = int(ends.argmax())
            if not ends[k]:
                at, size, low, high = at + len(gap), min(2 * size, MAX_BLOCK), lows[-1], highs[-1]
                continue
            # No slope exists between points of one instant: keep both. Else the point
            # before the one that closed the corridor is kept, and that one is seen again.
            start = at + k if same_time[k] else at + k - 1
        at, size, low, high = start + 1, BLOCK, -np.inf, np.inf
        mask[start] = True
        if known is not None and start >= offset and known[start - offset]:
            mask[start:] = known[start - offset :]
            return mask, None
    return mask, (start, low, high)


def door_pivots(seconds: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """Mask of the points to keep: the corridor of ``width`` around the line from the
    last kept point narrows with every point; when it closes, the previous one is kept."""
    t, v = np.asarray(seconds, dtype=float), np.asarray(values, dtype=float)
    if not len(v):
        return np.zeros(0, dtype=bool)
    mask, _ = _run(t, v, width, 1, -np.inf, np.inf)
    mask[[0, len(v) - 1]] = True
    return mask


def _state(t, v, start, low, high) -> list[float]:
    """Pivot, corridor and last point: all that later points need."""
    return [float(x) for x in (t[start], v[start], low, high, t[-1], v[-1])]


def _resumed(t, v, width, into, known, left):
    """Pivots of a segment from the state ``into`` before it, whether the point just
    before the segment is one, and the state ``left``, given an earlier run's pivots and state."""
    pivot_t, pivot_v, low, high, last_t, last_v = into
    # The last point is the pivot itself, or lies after it.
    ahead = [(pivot_t, pivot_v)] if last_t == pivot_t else [(pivot_t, pivot_v), (last_t, last_v)]
    k = len(ahead)
    t = np.concatenate([[x for x, _ in ahead], t])
    v = np.concatenate([[x for _, x in ahead], v])
    mask, end = _run(t, v, width, k, low, high, known, k)
    return mask[k:], bool(k == 2 and mask[1]), left if end is None else _state(t, v, *end)


def _sample(t: np.ndarray, v: np.ndarray) -> tuple[list[float], list[float]]:
    """First, last, lowest and highest point of each of ``SAMPLE_BLOCKS`` blocks, in order."""
    size = -(-len(v) // SAMPLE_BLOCKS)
    at = np.concatenate([[lo, lo + v[lo : lo + size].argmin(), lo + v[lo : lo + size].argmax(), min(lo + size, len(v)) - 1] for lo in range(0, len(v), size)])
    at = np.unique(at)
    return t[at].tolist(), v[at].tolist()


def _passes(row: dict, state: list[float], width: float) -> list[float] | None:
    """The state behind a segment if, as far as its sample tells, the door stays open in it."""
    t, v = np.array([state[0], *row["sample_t"]]), np.array([state[1], *row["sample_v"]])
    mask, end = _run(t, v, width, 1, state[2], state[3])
    return None if mask.any() or end[0] else _state(t, v, *end)


def _in_order(series: list[str], step, columns: list[str]):
    """A function over sorted batches: ``step(state, row)`` gives the next state and an output row;
    the state is None where a series begins. One segment's row is held at a time."""

    def rows(batches):
        last, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                own = tuple(None if pd.isna(row[c]) else row[c] for c in series)
                state = state if last == (own,) else None
                last = (own,)
                state, made = step(state, row)
                out.append({**{c: row[c] for c in (*series, "_segment")}, **made})
            yield pd.DataFrame(out, columns=columns)

    return rows


def swinging_door(
    ordered: OrderedRows, ts: str, value: str, width: float = DEFAULTS.door_width, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """The kept points, with the slope per second from the kept point before.

    Between kept points the straight line stays within ``width`` of every value. The
    result is that of the door over the whole series, whatever ``segment_rows`` is.

    1. Segments of ``segment_rows`` values are compressed in parallel, as if each began
       with a kept point.
    2. A scan over the segments, a few numbers and a sample of points each, foretells the
       last kept point before every segment: either the door stays open through a segment,
       or the segment falls in with what it kept by itself.
    3. Where the door stays open, the segment's share of the corridor is taken from all its
       points in parallel, and a second scan makes the exact state before every segment.
    4. All segments are run from that state in parallel, each only until it keeps a point
       that it kept before.

    What was foretold wrongly is known after that, and steps 2 to 4 are repeated with it.
    Noisy, flat and straight series take one round whatever their length; doors that close
    less than once a segment take one per closing that the samples did not show. No task
    holds more than a segment; the scans stream one row per segment.
    """
    series = list(ordered.series)
    known = ordered.df.where(F.col(value).isNotNull()).select(*series, POS, ts, value)
    numbered = ordered.with_df(known).running({"_n": ("sum", F.lit(1).cast("bigint"))})
    segment = F.expr(f"(_n - 1) div {segment_rows}").alias("_segment")
    points = stage(numbered.select(*series, POS, ts, value, segment, (F.unix_micros(ts) / 1e6).alias("_s")), "door-points")
    slim = points.select(*series, "_segment", POS, "_s", F.col(value).cast("double").alias("_v"))
    key = [*series, "_segment"]
    kinds = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in series)
    named = f"{kinds}{', ' if series else ''}_segment bigint"
    found = "pivots binary, keeps boolean, into array<double>, left array<double>"
    first = "own array<double>, sample_t array<double>, sample_v array<double>"

    def row(pdf, mask, keeps, into, left):
        pivots = np.flatnonzero(mask).astype(np.int32).tobytes()
        return pdf[key].iloc[:1].assign(pivots=[pivots], keeps=[keeps], into=[into], left=[left])

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        t, v = pdf["_s"].to_numpy(), pdf["_v"].to_numpy()
        mask, end = _run(t, v, width, 1, -np.inf, np.inf)
        mask[0] = True
        state, sample = _state(t, v, *end), _sample(t, v)
        return row(pdf, mask, False, None, state).assign(own=[state], sample_t=[sample[0]], sample_v=[sample[1]])

    def share(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """What a segment's points make of the corridor around a pivot before it."""
        if not len(told) or not len(pdf):
            return pd.DataFrame(columns=[*key, "low", "high"])
        pivot_t, pivot_v = told["state"].iloc[0][:2]
        gap, rise = pdf["_s"].to_numpy() - pivot_t, pdf["_v"].to_numpy() - pivot_v
        with np.errstate(divide="ignore", invalid="ignore"):
            low, high = ((rise - width) / gap).max(), ((rise + width) / gap).min()
        return pdf[key].iloc[:1].assign(low=[low], high=[high])

    def again(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told) or not len(pdf):
            return pd.DataFrame(columns=[*key, "pivots", "keeps", "into", "left"])
        pdf, f = pdf.sort_values(POS), told.iloc[0]
        before = _mask(f["pivots"], len(pdf))
        into = [float(x) for x in f["now"]]
        mask, keeps, left = _resumed(pdf["_s"].to_numpy(), pdf["_v"].to_numpy(), width, into, before, list(f["left"]))
        return row(pdf, mask, keeps, into, left)

    def beside(a: DataFrame, b: DataFrame, step: int, how: str) -> DataFrame:
        """``a`` with the columns of the segment ``step`` from it in ``b``."""
        b = b.withColumnsRenamed({c: f"_b_{c}" for c in key})
        same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in series]
        on = reduce(lambda x, y: x & y, same, F.col("_segment") + step == F.col("_b__segment"))
        return a.join(b, on, how).drop(*[f"_b_{c}" for c in key])

    def scanned(rows: DataFrame, step, made: str) -> DataFrame:
        dealt = rows.repartition(*series) if series else rows.repartition(1)
        columns = [*key, *(c.split()[0] for c in made.split(", "))]
        return dealt.sortWithinPartitions(*key).mapInPandas(_in_order(series, step, columns), f"{named}, {made}")

    def foretold(state, row):
        """The state before a segment, and what becomes of it there."""
        if state is None:
            return list(row["left"]), {"kind": KNOWN, "state": None}
        if row["into"] is not None and list(row["into"][:2]) == state[:2]:
            # All that lies behind a pivot follows from it.
            return list(row["left"]), {"kind": KNOWN, "state": state}
        behind = _passes(row, state, width)
        return (behind, {"kind": OPEN, "state": state}) if behind else (list(row["own"]), {"kind": FALLS_IN, "state": state})

    def exact(state, row):
        now = {"now": state, "kind": row["kind"]}
        if row["kind"] == KNOWN:
            return list(row["left"]), now
        if row["kind"] == FALLS_IN:
            return list(row["own"]), now
        return [*state[:2], max(state[2], row["low"]), min(state[3], row["high"]), *row["own"][4:]], now

    heads = stage(slim.groupBy(*key).applyInPandas(alone, f"{named}, {found}, {first}"), "door-segments")
    fixed, done = heads.select(*key, "own", "sample_t", "sample_v"), heads.drop("own", "sample_t", "sample_v")
    while True:
        told = stage(scanned(beside(done.drop("pivots"), fixed, 0, "inner"), foretold, "kind int, state array<double>"), "door-foretold")
        if told.where(F.col("kind") != KNOWN).isEmpty():
            break
        opened = told.where(F.col("kind") == OPEN).select(*key, "state")
        some = beside(slim, opened.select(*key), 0, "left_semi")
        shares = some.groupBy(*key).cogroup(opened.groupBy(*key)).applyInPandas(share, f"{named}, low double, high double")
        rows = beside(beside(done.select(*key, "left"), fixed.select(*key, "own"), 0, "inner"), told.select(*key, "kind"), 0, "inner")
        states = stage(scanned(beside(rows, shares, 0, "left"), exact, "now array<double>, kind int"), "door-states")
        changed = beside(done, states.where(F.col("kind") != KNOWN).drop("kind"), 0, "inner")
        changed = stage(changed, "door-changed")
        some = beside(slim, changed.select(*key), 0, "left_semi")
        redone = some.groupBy(*key).cogroup(changed.groupBy(*key)).applyInPandas(again, f"{named}, {found}")
        done = stage(beside(done, changed.select(*key), 0, "left_anti").unionByName(redone), "door-segments")
    ends = beside(done, done.select(*key, F.col("keeps").alias("next")), 1, "left")

    def kept(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        pdf, f = pdf.sort_values(POS), found.iloc[0]
        mask = _mask(f["pivots"], len(pdf))
        # The last point of a series is kept as well.
        mask[-1] |= f["next"] is None or pd.isna(f["next"]) or bool(f["next"])
        out = pdf[mask].copy()
        at, v = out["_s"].to_numpy(), out[value].to_numpy(dtype=float)
        into = f["into"]
        before = (np.nan, np.nan) if into is None else (into[4], into[5]) if f["keeps"] else (into[0], into[1])
        gap, rise = np.diff(at, prepend=before[0]), np.diff(v, prepend=before[1])
        out[SLOPE] = np.divide(rise, gap, out=np.full(len(gap), np.nan), where=gap > 0)
        return out[[*series, POS, ts, value, SLOPE]]

    columns = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in (*series, POS, ts, value))
    return points.groupBy(*key).cogroup(ends.groupBy(*key)).applyInPandas(kept, f"{columns}, {SLOPE} double")


def _mask(pivots: bytes, n: int) -> np.ndarray:
    mask = np.zeros(n, dtype=bool)
    mask[np.frombuffer(pivots, np.int32)] = True
    return mask


def every_point(ordered: OrderedRows, ts: str, value: str) -> DataFrame:
    """All points with a value, with the slope per second from the one before."""
    known = ordered.df.where(F.col(value).isNotNull()).select(*ordered.series, POS, ts, value)
    point = F.struct(F.unix_micros(ts).alias("at"), F.col(value).alias("v"))
    rows = ordered.with_df(known).running({"_before": ("last", point)}, exclusive=True)
    seconds = (F.unix_micros(ts) - F.col("_before.at")) / 1e6
    slope = F.when(seconds > 0, (F.col(value) - F.col("_before.v")) / seconds)
    return rows.withColumn(SLOPE, slope).drop("_before")


def ramp_rate(
    ordered: OrderedRows,
    ts: str,
    value: str,
    width: float | None = DEFAULTS.door_width,
    name: str = "ramp_rate",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Slope into the last kept point, carried to every row.

    Rows before the first slope take that one; 0 where a series has none.
    ``width=None`` keeps every point.
    """
    points = every_point(ordered, ts, value) if width is None else swinging_door(ordered, ts, value, width, segment_rows)
    slopes = points.where(F.col(SLOPE).isNotNull() & ~F.isnan(SLOPE) & (F.abs(SLOPE) != float("inf")))
    slopes = stage(slopes.select(*ordered.series, POS, F.col(SLOPE).alias(name)), "slopes")
    first = slopes.groupBy(*ordered.series).agg(F.min_by(name, POS).alias(name))
    return ordered.carry(slopes, [name], first).withColumn(name, F.coalesce(name, F.lit(0.0)))
