"""Queries for selection, joins in time, resampling and row-frame features."""

from __future__ import annotations

from pyspark.sql import functions as F

from hertzflow.operators import asof, resample, select, windows
from hertzflow.operators.layout import POS, series_row_number
from hertzflow.operators.swinging_door import ramp_rate, swinging_door

from .base import (
    BASE_SQL,
    SCORED_SQL,
    SIGNAL_SQL,
    THRESHOLD,
    W,
    daily,
    events,
    hourly,
    laid_out,
    out,
    query,
    r,
    rounded,
    scored,
    signal,
    table,
)

# ---- projection, filter, ordering ------------------------------------------------


@query("p1_column_pruning", "SELECT ts, value FROM events")
def p1(spark, sf):
    return table(spark, sf, "events").select("ts", "value")


@query(
    "p2_renewable_ratio",
    BASE_SQL + f"SELECT event_id, {r('wind_speed * 3000.0 / 35000.0', 'renewable_penetration_ratio')} FROM base",
)
def p2(spark, sf):
    rows = laid_out(spark, sf).df
    return out(rows.select("event_id", select.renewable_ratio().alias("renewable_penetration_ratio")))


@query(
    "p3_calendar_parts",
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute FROM events",
)
def p3(spark, sf):
    return events(spark, sf).withColumns(select.calendar_parts("ts")).select("event_id", "hour", "minute")


@query(
    "p4_drop_incomplete",
    BASE_SQL + f"SELECT event_id, {r('solar_radiation', 'solar_radiation')} FROM base WHERE solar_radiation IS NOT NULL "
    "AND wind_speed IS NOT NULL AND inertia_cost IS NOT NULL",
)
def p4(spark, sf):
    return out(laid_out(spark, sf).df.dropna(), "event_id", "solar_radiation")


@query("p5_targeted_drop", BASE_SQL + "SELECT event_id, inertia_cost FROM base WHERE solar_radiation IS NOT NULL")
def p5(spark, sf):
    return laid_out(spark, sf).df.dropna(subset=["solar_radiation"]).select("event_id", "inertia_cost")


@query(
    "p6_temporal_split",
    """
    SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-21' THEN 'calibration'
      WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' WHEN ts < TIMESTAMP '2024-01-29' THEN 'test' END AS split
    FROM events
    """,
)
def p6(spark, sf):
    ts = [F.to_timestamp(F.lit(d)) for d in ("2024-01-21", "2024-01-29", "2024-01-18")]
    label = select.split_label("ts", ts[0], ts[1], (ts[2], ts[0]))
    return events(spark, sf).select("event_id", label.alias("split"))


@query("p7_available_days", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")
def p7(spark, sf):
    return select.available_days(table(spark, sf, "events"), "ts")


@query("p7_day_slice", "SELECT event_id, ts, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'")
def p7_slice(spark, sf):
    return out(select.day_slice(events(spark, sf).select("event_id", "ts", "value"), "ts", "2024-01-09"))


@query(
    "p8_time_of_day",
    "SELECT event_id, ts FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 15 * 60 + 52 AND 16 * 60 + 55",
)
def p8(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return rows.where(select.time_of_day("ts", 15 * 60 + 52, 16 * 60 + 55))


@query("p9_sort_by_time", "SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id")
def p9(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "event_type").orderBy("ts", "event_id")


@query(
    "p10_keep_first",
    """SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""",
)
def p10(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return select.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"])


_DIRTY_SQL = (
    "WITH "
    + SIGNAL_SQL
    + """,
dirty AS (SELECT *, CASE WHEN grid_frequency < 49.78 THEN NULL WHEN grid_frequency < 49.8 THEN NULL
  WHEN grid_frequency < 49.82 THEN NULL ELSE grid_frequency END AS x FROM sig)
"""
)


@query(
    "p11_clean_and_fill",
    _DIRTY_SQL
    + f"""SELECT event_id, {r(f'''coalesce(last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)''', 'x')} FROM dirty""",
)
def p11(spark, sf):
    x = F.col("grid_frequency")
    dirty = (
        F.when(x < 49.78, F.lit(float("inf")))
        .when(x < 49.8, F.lit(float("nan")))
        .when(x < 49.82, F.lit(None))
        .otherwise(x)
    )
    ordered = laid_out(spark, sf)
    return out(windows.clean_and_fill(ordered.with_df(ordered.df.withColumn("x", dirty)), "x"), "event_id", "x")


@query(
    "p12_every_nth",
    "WITH "
    + SIGNAL_SQL
    + f""", n AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series) AS c FROM sig)
    SELECT event_id, series FROM n WHERE (rn - 1) % greatest(1, c // 60) = 0""",
)
def p12(spark, sf):
    numbered = series_row_number(laid_out(spark, sf))
    return windows.every_nth(numbered, 60).select("event_id", "series")


@query(
    "p13_seeded_sample",
    "SELECT event_id, value FROM events ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 100",
)
def p13(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return select.seeded_sample(rows, ["event_id"], 100, 42)


@query(
    "p13_sample_per_group",
    """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id) AS n FROM events) WHERE n <= 50""",
)
def p13_group(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return select.seeded_sample_per_group(rows, ["event_type"], ["event_id"], 50, 42)


# ---- joins in time ---------------------------------------------------------------


@query(
    "j1_asof_backward",
    "WITH "
    + SIGNAL_SQL
    + f"""SELECT s.event_id, {r('s.grid_frequency', 'grid_frequency')}, {r('hourly.wind_speed', 'wind_speed')},
    {r('hourly.solar_radiation', 'solar_radiation')} FROM sig s ASOF LEFT JOIN hourly ON s.timestamp >= hourly.h""",
)
def j1(spark, sf):
    joined = asof.asof_join(signal(spark, sf), hourly(spark, sf), "timestamp")
    return out(joined, "event_id", "grid_frequency", "wind_speed", "solar_radiation")


def _all_and_others(spark, sf):
    """Every event, and the events that are no clicks, to carry along."""
    e = events(spark, sf)
    clicks = e.select("event_id", "user_id", "ts")
    views = e.where("event_type <> 'click'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return clicks, views


@query(
    "j1_asof_sorted",
    """SELECT c.event_id, c.user_id, c.ts, v.event_id AS view_id, v.value AS view_value
    FROM events c ASOF LEFT JOIN
    (SELECT * FROM events WHERE event_type <> 'click') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def j1_sorted(spark, sf):
    clicks, views = _all_and_others(spark, sf)
    return out(
        asof.asof_join(
            clicks, views, "ts", right_on="view_ts", by=["user_id"], tie=["view_id"], left_tie=["event_id"], strategy="sorted"
        )
    )


@query(
    "j1_asof_null_keys",
    """SELECT c.event_id, c.k, v.event_id AS view_id FROM
    (SELECT *, CASE WHEN user_id % 5 > 0 THEN user_id END AS k FROM events) c ASOF LEFT JOIN
    (SELECT *, CASE WHEN user_id % 3 > 0 THEN user_id END AS k FROM events WHERE event_type <> 'click') v ON c.k = v.k AND c.ts >= v.ts""",
)
def j1_null_keys(spark, sf):
    """Null keys match nothing, whichever way the join goes."""
    rows, others = _all_and_others(spark, sf)
    rows = rows.select("event_id", "ts", F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("k"))
    others = others.select("view_ts", "view_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("k"))
    joined = asof.asof_join(rows, others, "ts", right_on="view_ts", by=["k"], tie=["view_id"], left_tie=["event_id"])
    return joined.select("event_id", "k", "view_id")


@query(
    "j2_asof_tolerance",
    """SELECT c.event_id, c.user_id, c.ts,
      CASE WHEN epoch_us(c.ts) - epoch_us(v.ts) <= 86400000000 THEN v.event_id END AS view_id,
      CASE WHEN epoch_us(c.ts) - epoch_us(v.ts) <= 86400000000 THEN v.value END AS view_value
    FROM events c ASOF LEFT JOIN
    (SELECT * FROM events WHERE event_type <> 'click') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def j2(spark, sf):
    clicks, views = _all_and_others(spark, sf)
    return out(
        asof.asof_join(
            clicks,
            views,
            "ts",
            right_on="view_ts",
            by=["user_id"],
            tie=["view_id"],
            left_tie=["event_id"],
            tolerance_seconds=86_400,
        )
    )


@query(
    "j3_asof_daily",
    "WITH "
    + SIGNAL_SQL
    + """SELECT s.event_id, d.inertia_cost FROM sig s
    ASOF LEFT JOIN (SELECT * FROM daily WHERE isodow(d) <= 5) d ON s.timestamp >= d.d""",
)
def j3(spark, sf):
    """Business-day values: a weekend carries the Friday on."""
    business = daily(spark, sf).where(F.weekday("timestamp") <= 4)
    return asof.asof_join(signal(spark, sf), business, "timestamp").select("event_id", "inertia_cost")


@query(
    "j4_nearest_row",
    "WITH "
    + SIGNAL_SQL
    + f"""SELECT day, series, event_id, timestamp, {r('grid_frequency', 'grid_frequency')} FROM (
      SELECT *, CAST(timestamp AS DATE) AS day, row_number() OVER (PARTITION BY series, CAST(timestamp AS DATE) ORDER BY
        abs(epoch_us(timestamp) - epoch_us(CAST(date_trunc('day', timestamp) AS TIMESTAMP) + INTERVAL 12 HOUR)),
        timestamp, event_id) AS n FROM sig) WHERE n = 1""",
)
def j4(spark, sf):
    rows = signal(spark, sf).withColumn("day", F.to_date("timestamp"))
    noon = rows.select("day").distinct().withColumn("target", F.col("day").cast("timestamp") + F.expr("interval 12 hours"))
    near = asof.nearest_row(rows, noon, "timestamp", "target", ["day"], ["day"], ["series"], ["event_id"])
    return out(near, "day", "series", "event_id", "timestamp", "grid_frequency")


@query(
    "j5_equi_attach",
    "WITH "
    + SIGNAL_SQL
    + f"""SELECT s.event_id, {r('coalesce(h.solar_radiation, 0.0)', 'solar_radiation')} FROM sig s
    LEFT JOIN (SELECT * FROM hourly WHERE solar_radiation > 50) h ON CAST(date_trunc('hour', s.timestamp) AS TIMESTAMP) = h.h""",
)
def j5(spark, sf):
    left = signal(spark, sf).withColumn("at", F.date_trunc("hour", "timestamp")).select("event_id", "at")
    right = hourly(spark, sf).where("solar_radiation > 50").select(F.col("timestamp").alias("at"), "solar_radiation")
    return out(asof.attach(left, right, ["at"], {"solar_radiation": 0.0}), "event_id", "solar_radiation")


@query(
    "j6_upsample_linear",
    "WITH "
    + SIGNAL_SQL
    + f""", k AS (SELECT h, wind_speed, lead(h) OVER (ORDER BY h) AS nh, lead(wind_speed) OVER (ORDER BY h) AS nw FROM hourly),
    g AS (SELECT *, unnest(generate_series(0, coalesce((epoch_us(nh) - epoch_us(h) - 1) // 60000000, 0))) AS i FROM k)
    SELECT h + to_seconds(i * 60) AS timestamp,
      {r('CASE WHEN i = 0 THEN wind_speed ELSE wind_speed + (nw - wind_speed) * ((i * 60000000) / (epoch_us(nh) - epoch_us(h))) END', 'wind_speed')}
    FROM g""",
)
def j6(spark, sf):
    knots = hourly(spark, sf).withColumn("station", F.lit("all"))
    grid = resample.upsample_linear(knots, ["station"], "timestamp", ["wind_speed"], step_seconds=60)
    return out(grid, "timestamp", "wind_speed")


@query(
    "j6_fill_linear",
    "WITH "
    + SIGNAL_SQL
    + f""", k AS (SELECT h, solar_radiation AS v,
      max(CASE WHEN solar_radiation IS NOT NULL THEN h END) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ph,
      min(CASE WHEN solar_radiation IS NOT NULL THEN h END) OVER (ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nh
      FROM hourly)
    SELECT k.h AS timestamp, {r('''CASE WHEN k.v IS NOT NULL THEN k.v WHEN k.nh IS NULL THEN p.solar_radiation
      ELSE p.solar_radiation + (n.solar_radiation - p.solar_radiation) / (epoch_us(k.nh) - epoch_us(k.ph))
        * (epoch_us(k.h) - epoch_us(k.ph)) END''', 'solar_radiation')}
    FROM k LEFT JOIN hourly p ON p.h = k.ph LEFT JOIN hourly n ON n.h = k.nh""",
)
def j6_fill(spark, sf):
    knots = hourly(spark, sf).withColumn("station", F.lit("all"))
    return out(resample.fill_linear(knots, ["station"], "timestamp", ["solar_radiation"]), "timestamp", "solar_radiation")


@query(
    "j6_asof_interpolated",
    "WITH "
    + SIGNAL_SQL
    + f""", k AS (SELECT h, wind_speed, lead(h) OVER (ORDER BY h) AS nh, lead(wind_speed) OVER (ORDER BY h) AS nw FROM hourly),
    j AS (SELECT s.event_id, k.*, (epoch_us(s.timestamp) - epoch_us(k.h)) // 1000000 * 1000000 AS e
      FROM sig s ASOF LEFT JOIN k ON s.timestamp >= k.h)
    SELECT event_id, {r('CASE WHEN nh IS NULL OR e = 0 THEN wind_speed ELSE wind_speed + (nw - wind_speed) * (e / (epoch_us(nh) - epoch_us(h))) END', 'wind_speed')}
    FROM j""",
)
def j6_at(spark, sf):
    slow = hourly(spark, sf).select("timestamp", "wind_speed")
    rows = resample.asof_interpolated(signal(spark, sf), slow, "timestamp", ["wind_speed"])
    return out(rows, "event_id", "wind_speed")


# ---- row-frame features ----------------------------------------------------------


def _framed(spark, sf, before, after, *steps):
    """Event id and the columns of each step, where a step maps frames to columns."""
    frames = laid_out(spark, sf).framed(before, after)
    rows, names = frames.rows, []
    for step in steps:
        columns = step(frames)
        rows, names = rows.withColumns(columns), [*names, *columns]
    return out(frames.trim(rows), "event_id", *[n for n in names if not n.startswith("_")])


_F = "grid_frequency"
_SIG = "WITH " + SIGNAL_SQL


@query("w1_first_difference", _SIG + f"SELECT event_id, {r(f'grid_frequency - lag(grid_frequency) OVER ({W})', 'diff')} FROM sig")
def w1(spark, sf):
    return _framed(spark, sf, 1, 0, lambda f: {"diff": windows.first_difference(f, _F)})


@query(
    "w2_smoothed_rocof",
    _SIG
    + f""", d AS (SELECT *, grid_frequency - lag(grid_frequency) OVER ({W}) AS diff FROM sig)
    SELECT event_id, {r(f'coalesce(avg(diff) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0)', 'rocof')} FROM d""",
)
def w2(spark, sf):
    return _framed(
        spark,
        sf,
        6,
        0,
        lambda f: {"_diff": windows.first_difference(f, _F)},
        lambda f: {"rocof": windows.smoothed_rate(f, "_diff")},
    )


def _vol_sql(k, x="grid_frequency"):
    frame = f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {k} THEN stddev_samp({x}) {frame} ELSE 0.0 END"


@query(
    "w3_volatility",
    _SIG + "SELECT event_id, " + ", ".join(r(_vol_sql(k), f"volatility_{k}s") for k in (10, 30, 60)) + " FROM sig",
)
def w3(spark, sf):
    return _framed(
        spark,
        sf,
        60,
        0,
        *[lambda f, i=i: windows.volatility_steps(f, _F, (10, 30, 60))[i] for i in range(3)],
    )


@query(
    "w4_lags",
    _SIG
    + "SELECT event_id, "
    + ", ".join(r(f"coalesce(lag(grid_frequency, {k}) OVER ({W}), 50.0)", f"lag_{k}s") for k in (1, 5, 60))
    + " FROM sig",
)
def w4(spark, sf):
    return _framed(spark, sf, 60, 0, lambda f: {f"lag_{k}s": windows.lagged(f, _F, k) for k in (1, 5, 60)})


@query(
    "w5_lead_target",
    _SIG
    + f""", t AS (SELECT event_id, lead(grid_frequency, 10) OVER ({W}) AS y FROM sig)
    SELECT event_id, {r('y', 'target_freq_next')} FROM t WHERE y IS NOT NULL""",
)
def w5(spark, sf):
    return _framed(spark, sf, 0, 10, lambda f: {"target_freq_next": windows.led(f, _F)}).dropna()


@query(
    "w6_instability_label",
    _SIG
    + f""", t AS (SELECT event_id, lead(grid_frequency, 10) OVER ({W}) AS y FROM sig)
    SELECT event_id, CAST(CASE WHEN y > 50.2 OR y < 49.8 THEN 1 ELSE 0 END AS TINYINT) AS target_is_unstable FROM t""",
)
def w6(spark, sf):
    return _framed(spark, sf, 0, 10, lambda f: {"target_is_unstable": windows.instability_label(windows.led(f, _F))})


def door_sql(source: str, width: float = 0.5) -> str:
    """The door of the table ``source``, point by point, and its kept points as ``knots``."""
    return (
        BASE_SQL.replace("WITH", "WITH RECURSIVE", 1)
        + f""", src AS ({source if ' ' in source else f'SELECT * FROM {source}'}),
    pts AS MATERIALIZED (SELECT series, event_id, timestamp, wind_speed AS v, epoch_us(timestamp) / 1e6 AS t,
      row_number() OVER ({W}) AS n FROM src WHERE wind_speed IS NOT NULL),
    door AS (
      SELECT series, n, t, v, t AS pt, v AS pv, n AS pn, n AS also, CAST('-infinity' AS DOUBLE) AS low, CAST('infinity' AS DOUBLE) AS high
      FROM pts WHERE n = 1
      UNION ALL
      SELECT series, n, t, v,
        CASE WHEN stays THEN pt WHEN gap > 0 AND t > lt THEN lt ELSE t END,
        CASE WHEN stays THEN pv WHEN gap > 0 AND t > lt THEN lv ELSE v END,
        CASE WHEN stays THEN pn WHEN gap > 0 AND t > lt THEN n - 1 ELSE n END,
        CASE WHEN NOT stays AND gap > 0 AND t <= lt THEN n - 1 END,
        CASE WHEN stays THEN greatest(low, (rise - {width}) / gap) WHEN gap > 0 AND t > lt THEN (v - lv - {width}) / (t - lt) ELSE CAST('-infinity' AS DOUBLE) END,
        CASE WHEN stays THEN least(high, (rise + {width}) / gap) WHEN gap > 0 AND t > lt THEN (v - lv + {width}) / (t - lt) ELSE CAST('infinity' AS DOUBLE) END
      FROM (SELECT *, gap > 0 AND low * gap <= rise AND rise <= high * gap AS stays
        FROM (SELECT p.series, p.n, p.t, p.v, d.pt, d.pv, d.pn, d.low, d.high, d.t AS lt, d.v AS lv, p.t - d.pt AS gap, p.v - d.pv AS rise
          FROM door d JOIN pts p ON p.series = d.series AND p.n = d.n + 1))
    ),
    kept AS (SELECT series, pn AS n FROM door UNION SELECT series, also FROM door WHERE also IS NOT NULL
      UNION SELECT series, max(n) FROM door GROUP BY series),
    knots AS (SELECT pts.*, CASE WHEN t > lag(t) OVER k THEN (v - lag(v) OVER k) / (t - lag(t) OVER k) END AS slope
      FROM pts JOIN kept USING (series, n) WINDOW k AS (PARTITION BY series ORDER BY n)),
    ramped AS (SELECT src.*, coalesce(last_value(slope IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(slope IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS ramp_rate
      FROM src LEFT JOIN (SELECT event_id, slope FROM knots) USING (event_id) WINDOW o AS ({W}))
    """
    )


@query(
    "w7_swinging_door",
    door_sql("base") + f"SELECT series, timestamp, {r('v', 'wind_speed')}, {r('slope', 'slope')} FROM knots",
)
def w7(spark, sf):
    return out(swinging_door(laid_out(spark, sf), "timestamp", "wind_speed", 0.5), "series", "timestamp", "wind_speed", "slope")


@query(
    "w8_ramp_rate",
    BASE_SQL
    + f""", k AS (SELECT *, (wind_speed - lag(wind_speed) OVER ({W})) /
      nullif((epoch_us(timestamp) - epoch_us(lag(timestamp) OVER ({W}))) / 1e6, 0) AS s FROM base)
    SELECT event_id, {r(f'''coalesce(last_value(s IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(s IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)''', 'ramp_rate')} FROM k""",
)
def w8(spark, sf):
    return out(ramp_rate(laid_out(spark, sf), "timestamp", "wind_speed", None), "event_id", "ramp_rate")


@query("w8_ramp_rate_door", door_sql("base") + f"SELECT event_id, {r('ramp_rate', 'ramp_rate')} FROM ramped")
def w8_door(spark, sf):
    return out(ramp_rate(laid_out(spark, sf), "timestamp", "wind_speed", 0.5), "event_id", "ramp_rate")


@query(
    "w9_trailing_sequence",
    _SIG
    + f""", t AS (SELECT event_id, count(*) OVER f AS n, first_value(grid_frequency) OVER f AS a, grid_frequency AS z,
      sum(grid_frequency) OVER f AS s, lead(CASE WHEN grid_frequency < 49.8 THEN 1 ELSE 0 END) OVER ({W}) AS l
      FROM sig WINDOW f AS ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT event_id, {r('a', 'oldest')}, {r('z', 'newest')}, {r('s', 'total', 6)}, l AS next_label
    FROM t WHERE n = 30 AND l IS NOT NULL""",
)
def w9(spark, sf):
    ordered = laid_out(spark, sf)
    labelled = ordered.with_df(ordered.df.withColumn("label", F.when(F.col(_F) < THRESHOLD, 1).otherwise(0)))
    seq = windows.sequences(labelled, [_F], 30, "label")
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    rows = seq.select(
        "event_id",
        F.element_at("sequence", 1).alias("oldest"),
        F.element_at("sequence", -1).alias("newest"),
        rounded(total, 6).alias("total"),
        "next_label",
    )
    return out(rows)


@query(
    "w10_countdown",
    _SIG
    + f""", n AS (SELECT *, row_number() OVER ({W}) AS rn FROM sig)
    SELECT event_id, min(CASE WHEN grid_frequency < 49.8 THEN rn END)
      OVER ({W} ROWS BETWEEN CURRENT ROW AND 299 FOLLOWING) - rn AS countdown FROM n""",
)
def w10(spark, sf):
    return windows.countdown_rows(laid_out(spark, sf), _F).select("event_id", "countdown")


@query(
    "w11_context_slice",
    _SIG
    + f""", n AS (SELECT *, row_number() OVER ({W}) AS rn FROM sig),
    f AS (SELECT series, event_id AS focus_id, rn AS frn FROM (SELECT *, row_number() OVER (PARTITION BY series,
      CAST(timestamp AS DATE) ORDER BY grid_frequency, timestamp, event_id) AS k FROM n) WHERE k = 1)
    SELECT f.focus_id, n.event_id, n.rn - f.frn AS "offset" FROM n JOIN f
      ON n.series = f.series AND n.rn BETWEEN f.frn - 300 AND f.frn + 10""",
)
def w11(spark, sf):
    ordered = laid_out(spark, sf)
    rows = ordered.df.withColumn("day", F.to_date("timestamp")).select("series", "day", "timestamp", "event_id", _F, POS)
    low = windows.nadir(rows, ["series", "day"], _F, ["timestamp", "event_id"])
    focus = low.select("series", F.col("event_id").alias("focus_id"), POS)
    return windows.context_slices(ordered, focus, "focus_id", 300, 10).select("focus_id", "event_id", "offset")


@query(
    "w12_first_alert",
    SCORED_SQL
    + f"""SELECT series, day, CAST(alerted AS BOOLEAN) AS alerted, event_id, timestamp, {r('lower', 'lower')} FROM (
      SELECT *, CAST(timestamp AS DATE) AS day, max(CASE WHEN lower < 49.8 THEN 1 ELSE 0 END)
        OVER (PARTITION BY series, CAST(timestamp AS DATE)) AS alerted,
        row_number() OVER (PARTITION BY series, CAST(timestamp AS DATE) ORDER BY
          CASE WHEN lower < 49.8 THEN 0 ELSE 1 END, CASE WHEN lower < 49.8 THEN 0.0 ELSE lower END, timestamp, event_id) AS n
      FROM scored) WHERE n = 1""",
)
def w12(spark, sf):
    rows = scored(spark, sf).select("series", F.to_date("timestamp").alias("day"), "event_id", "timestamp", "lower")
    first = windows.first_alert(rows, ["series", "day"], F.col("lower") < THRESHOLD, "lower", ["timestamp", "event_id"])
    return out(first)


@query(
    "w13_nadir",
    _SIG
    + f"""SELECT series, day, event_id, timestamp, {r('grid_frequency', 'grid_frequency')} FROM (
      SELECT *, CAST(timestamp AS DATE) AS day, row_number() OVER (PARTITION BY series, CAST(timestamp AS DATE)
      ORDER BY grid_frequency, timestamp, event_id) AS n FROM sig) WHERE n = 1""",
)
def w13(spark, sf):
    rows = signal(spark, sf).select("series", F.to_date("timestamp").alias("day"), "event_id", "timestamp", _F)
    return out(windows.nadir(rows, ["series", "day"], _F, ["timestamp", "event_id"]))


@query(
    "w14_advance_warning",
    SCORED_SQL
    + f""", g AS (SELECT series, CAST(timestamp AS DATE) AS day, min(CASE WHEN lower < 49.75 THEN timestamp END) AS alert_at,
      min(CASE WHEN grid_frequency < 49.8 THEN timestamp END) AS breach_at,
      arg_min(timestamp, (grid_frequency, timestamp, event_id)) AS nadir_at FROM scored GROUP BY 1, 2)
    SELECT *, {r('(epoch_us(breach_at) - epoch_us(alert_at)) / 1e6', 'warning_to_breach_s', 6)},
      {r('(epoch_us(nadir_at) - epoch_us(alert_at)) / 1e6', 'warning_to_nadir_s', 6)} FROM g""",
)
def w14(spark, sf):
    rows = scored(spark, sf).withColumn("day", F.to_date("timestamp"))
    warned = windows.advance_warning(
        rows, ["series", "day"], "timestamp", _F, F.col("lower") < 49.75, THRESHOLD, ["timestamp", "event_id"]
    )
    return out(warned, decimals=6)


@query(
    "w15_breach_episodes",
    _SIG
    + f""", c AS (SELECT *, CASE WHEN grid_frequency < 49.8 AND NOT coalesce(lag(grid_frequency < 49.8) OVER ({W}), false)
      THEN 1 ELSE 0 END AS s FROM sig),
    i AS (SELECT *, sum(s) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
    SELECT series, min(timestamp) AS start_at, max(timestamp) AS end_at, count(*) AS breach_rows, {r('min(grid_frequency)', 'lowest')}
    FROM i WHERE grid_frequency < 49.8 GROUP BY series, run""",
)
def w15(spark, sf):
    return out(windows.breach_episodes(laid_out(spark, sf), "timestamp", _F, THRESHOLD))
