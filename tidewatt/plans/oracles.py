"""The same queries in DuckDB SQL, written independently of the Spark jobs.

Common table expressions are kept as small functions; each query names the
ones it needs and they are put together by ``sql``.
"""

from __future__ import annotations

import math

from ..schema import DAY_NAMES, DETECTOR_COLUMNS, FEATURE_COLUMNS

# Easter Sundays of the years that the orders table covers (a public table,
# so that the rule in the calendar module is checked against dates).
EASTER = {
    1994: "1994-04-03", 1995: "1995-04-16", 1996: "1996-04-07", 1997: "1997-03-30", 1998: "1998-04-12",
    1999: "1999-04-04", 2000: "2000-04-23", 2001: "2001-04-15", 2002: "2002-03-31",
    2023: "2023-04-09", 2024: "2024-03-31", 2025: "2025-04-20",
}
FIXED_DAYS = ["01-01", "01-09", "05-01", "11-03", "11-04", "11-05", "11-10", "11-28", "12-08", "12-25"]
ROUNDED = 6


def r(expression: str, digits: int = ROUNDED, name: str | None = None) -> str:
    """Rounded, and without a negative zero."""
    rounded = f"(round({expression}, {digits}) + 0.0)"
    return f"{rounded} AS {name}" if name else rounded


def rs(columns, digits: int = ROUNDED) -> str:
    return ", ".join(r(c, digits, c) for c in columns)


def holidays(first: int, last: int) -> str:
    days = []
    for year in range(first, last + 1):
        days += [f"(DATE '{year}-{d}')" for d in FIXED_DAYS]
        days += [f"(DATE '{EASTER[year]}' - 47)", f"(DATE '{EASTER[year]}' - 2)"]
    return f"""given AS (SELECT CAST(d AS DATE) AS d FROM (VALUES {', '.join(days)}) v(d)),
    holidays AS (SELECT d FROM given UNION SELECT d + 1 FROM given WHERE isodow(d) = 7)"""


def hourly(key: str = "event_type") -> str:
    return f"""hourly AS (
      SELECT CAST({key} AS VARCHAR) AS series_id, date_trunc('hour', ts) AS t, round(sum(value), 6) AS load,
             round(avg(value), 6) AS temperature, CAST(count(*) AS DOUBLE) AS humidity
      FROM events GROUP BY ALL)"""


def dense(key: str = "event_type") -> str:
    return hourly(key) + """,
    axis AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM hourly),
    names AS (SELECT DISTINCT series_id FROM hourly),
    dense AS (
      SELECT n.series_id, a.t, coalesce(h.load, 0.0) AS load, coalesce(h.temperature, 0.0) AS temperature,
             coalesce(h.humidity, 0.0) AS humidity
      FROM names n CROSS JOIN axis a LEFT JOIN hourly h ON h.series_id = n.series_id AND h.t = a.t)"""


def dense_days() -> str:
    return """daily AS (
      SELECT date_trunc('day', o_orderdate) AS t, round(sum(o_totalprice), 6) AS load,
             round(avg(o_totalprice), 6) AS temperature, CAST(count(*) AS DOUBLE) AS humidity
      FROM orders GROUP BY ALL),
    axis AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM daily),
    dense AS (
      SELECT 'orders' AS series_id, CAST(a.t AS TIMESTAMP) AS t, coalesce(d.load, 0.0) AS load,
             coalesce(d.temperature, 0.0) AS temperature, coalesce(d.humidity, 0.0) AS humidity
      FROM axis a LEFT JOIN daily d ON d.t = a.t)"""


def dense_days_by(key: str) -> str:
    """Each value of ``key`` a series, from its own first to its own last day."""
    return f"""daily AS (
      SELECT CAST({key} AS VARCHAR) AS series_id, date_trunc('day', o_orderdate) AS t, round(sum(o_totalprice), 6) AS load,
             round(avg(o_totalprice), 6) AS temperature, CAST(count(*) AS DOUBLE) AS humidity
      FROM orders GROUP BY ALL),
    axis AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM daily GROUP BY series_id),
    dense AS (
      SELECT a.series_id, CAST(a.t AS TIMESTAMP) AS t, coalesce(d.load, 0.0) AS load,
             coalesce(d.temperature, 0.0) AS temperature, coalesce(d.humidity, 0.0) AS humidity
      FROM axis a LEFT JOIN daily d ON d.series_id = a.series_id AND d.t = a.t)"""


def angle(part: str, period: int, wave: str) -> str:
    return f"{wave}(2 * {math.pi!r} * {part} / {period})"


CYCLES = ", ".join(
    f"{angle(part, period, wave)} AS {name}_{wave}"
    for name, part, period in (("hour", "hour(t)", 24), ("dayofweek", "(isodow(t) - 1)", 7), ("month", "month(t)", 12))
    for wave in ("sin", "cos")
)
PARTS = ("CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS day_of_week, "
         "CAST(month(t) AS INTEGER) AS month")
LAGS = ", ".join(f"lag(load, {k}) OVER w AS lag_{k}" for k in (1, 24, 168))
ROLLING = """CASE WHEN count(load) OVER w24 = 24 THEN avg(load) OVER w24 END AS rolling_mean_24,
      CASE WHEN count(load) OVER w24 = 24 THEN stddev_samp(load) OVER w24 END AS rolling_std_24,
      CASE WHEN count(load) OVER w168 = 168 THEN avg(load) OVER w168 END AS rolling_mean_168"""
WINDOWS = """WINDOW w AS (PARTITION BY series_id ORDER BY t),
      w24 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
      w168 AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"""


def features(source: str | None = None, years: tuple[int, int] = (2023, 2025), key: str = "event_type") -> str:
    base = source or dense(key)
    return f"""{base}, {holidays(*years)},
    wide AS (SELECT *, {PARTS}, CAST(isodow(t) >= 6 AS INTEGER) AS is_weekend, {CYCLES}, {LAGS}, {ROLLING},
             CAST(CAST(t AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday
             FROM dense {WINDOWS}),
    feat AS (SELECT * FROM wide WHERE lag_168 IS NOT NULL AND rolling_mean_168 IS NOT NULL
             AND rolling_std_24 IS NOT NULL)"""


def split(base: str) -> str:
    return base + """,
    numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos,
                 count(*) OVER (PARTITION BY series_id) AS n FROM feat),
    cutoffs AS (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.85::DOUBLE) AS BIGINT) AS b
             FROM numbered),
    split_rows AS (SELECT *, CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'val' ELSE 'test' END AS split,
              CASE WHEN pos < a THEN pos WHEN pos < b THEN pos - a ELSE pos - b END AS split_pos,
              CASE WHEN pos < a THEN a WHEN pos < b THEN b - a ELSE n - b END AS split_n
              FROM cutoffs)"""


SPLIT_EVENTS = split(features())
SPLIT_USERS = split(features(key="user_id"))
SPLIT_ORDERS = split(features(dense_days(), (1994, 2002)))
SPLIT_PRIORITY = split(features(dense_days_by("o_orderpriority"), (1994, 2002)))


def scaled(columns, source: str, bounds: str, also: str) -> str:
    """Min-max scaled columns; a constant column becomes 0."""
    made = ", ".join(
        f"CASE WHEN b.max_{c} = b.min_{c} THEN s.{c} - b.min_{c} "
        f"ELSE (s.{c} - b.min_{c}) / (b.max_{c} - b.min_{c}) END AS {c}" for c in columns)
    return f"SELECT s.series_id, s.t, {also}, {made} FROM {source} s JOIN {bounds} b USING (series_id)"


def minmax(columns, source: str, where: str = "TRUE") -> str:
    made = ", ".join(f"CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}" for c in columns)
    return f"SELECT series_id, {made} FROM {source} WHERE {where} GROUP BY series_id"


def detector(base: str = SPLIT_EVENTS, method: str = "p99", stride: int = 24) -> str:
    """Filter, scale, profile, errors, threshold, flags over the whole table."""
    gap = " + ".join(f"abs(c.{x} - p.{x})" for x in DETECTOR_COLUMNS)
    means = ", ".join(f"avg({x}) AS {x}" for x in DETECTOR_COLUMNS)
    threshold = "quantile_cont(error, 0.99)" if method == "p99" else "max(error) * 1.05"

    def cells(name: str, source: str) -> str:
        return f"""{name} AS (SELECT c.*, k.window_id, c.pos - k.window_id * {stride} AS off FROM {source} c,
          LATERAL (SELECT unnest(generate_series(greatest(0, -((23 - c.pos) // {stride})), c.pos // {stride}))
                   AS window_id) k
          WHERE c.pos - k.window_id * {stride} BETWEEN 0 AND 23 AND k.window_id * {stride} + 24 <= c.n)"""

    def errors(name: str, source: str) -> str:
        return f"""{name} AS (SELECT c.series_id, c.window_id, min(c.t) AS start_ts, max(c.t) AS end_ts,
          sum({gap}) / 408 AS error FROM {source} c JOIN prof p ON p.series_id = c.series_id AND p.off = c.off
          GROUP BY c.series_id, c.window_id)"""

    return f"""{base},
    normal AS (SELECT * FROM split_rows WHERE split = 'train'
               AND abs(load - rolling_mean_24) <= 3 * rolling_std_24),
    normal_rows AS (SELECT * REPLACE (row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos,
                    count(*) OVER (PARTITION BY series_id) AS n) FROM normal),
    bounds AS ({minmax(DETECTOR_COLUMNS, 'normal')}),
    train_scaled AS ({scaled(DETECTOR_COLUMNS, 'normal_rows', 'bounds', 's.pos, s.n')}),
    all_scaled AS ({scaled(DETECTOR_COLUMNS, 'split_rows', 'bounds', 's.pos, s.n, s.split, s.split_pos, s.split_n')}),
    {cells('train_cells', 'train_scaled')},
    prof AS (SELECT series_id, off, {means} FROM train_cells GROUP BY series_id, off),
    {errors('train_errors', 'train_cells')},
    limits AS (SELECT series_id, {threshold} AS threshold, avg(error) AS mean, stddev_pop(error) AS std,
               quantile_cont(error, 0.95) AS p95, quantile_cont(error, 0.99) AS p99, max(error) AS max_error,
               '{method}' AS method FROM train_errors GROUP BY series_id),
    {cells('all_cells', 'all_scaled')},
    {errors('errors', 'all_cells')},
    flagged AS (SELECT e.*, l.threshold, e.error > l.threshold AS is_anomaly, {severity('e.error', 'l.threshold')} AS severity,
                {severity('e.error', 'l.threshold', 'l.std', (1, 2))} AS sigma_severity
                FROM errors e JOIN limits l USING (series_id))"""


def severity(error: str, threshold: str, unit: str | None = None, cuts=(0.25, 0.75)) -> str:
    excess = f"({error} - {threshold}) / {unit or threshold}"
    return (f"CASE WHEN {error} <= {threshold} THEN 'normal' WHEN {excess} < {cuts[0]} THEN 'low' "
            f"WHEN {excess} < {cuts[1]} THEN 'medium' ELSE 'high' END")


SERVED = "greatest(0.0, round(load, 2))"


def naive(horizon: int, key: str = "event_type") -> str:
    return dense(key) + f""",
    ends AS (SELECT series_id, max(t) AS origin_ts, count(*) AS n FROM dense GROUP BY series_id),
    naive AS (SELECT d.series_id, e.origin_ts,
              CAST(date_diff('hour', e.origin_ts, d.t + INTERVAL 168 HOUR) AS INTEGER) AS step,
              d.t + INTERVAL 168 HOUR AS ts, {SERVED} AS yhat
              FROM dense d JOIN ends e USING (series_id)
              WHERE d.t > e.origin_ts - INTERVAL 168 HOUR AND e.n >= 168
              AND d.t + INTERVAL 168 HOUR <= e.origin_ts + INTERVAL {horizon} HOUR)"""


PAIRS = SPLIT_ORDERS + """,
    targets AS MATERIALIZED (SELECT o.series_id, o.split, o.t AS origin_ts, s.step, o.split_pos + s.step AS y_pos,
      o.split_pos + s.step - 168 AS p_pos
      FROM split_rows o CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step) s
      WHERE o.split_pos >= 167 AND o.split_pos + 24 < o.split_n),
    with_y AS MATERIALIZED (SELECT o.*, y.load AS y FROM targets o JOIN split_rows y
      ON y.series_id = o.series_id AND y.split = o.split AND y.split_pos = o.y_pos),
    pairs AS (SELECT o.series_id, o.split, o.origin_ts, CAST(o.step AS INTEGER) AS step, o.y, p.load AS yhat
      FROM with_y o JOIN split_rows p ON p.series_id = o.series_id AND p.split = o.split AND p.split_pos = o.p_pos)"""
METRICS = """count(*) AS n_pairs, round(avg(abs(y - greatest(0, yhat))), {d}) AS mae,
      round(sqrt(avg((y - greatest(0, yhat)) * (y - greatest(0, yhat)))), {d}) AS rmse,
      round(avg(2 * abs(y - greatest(0, yhat)) / (abs(y) + abs(greatest(0, yhat)) + 1e-8)) * 100, {d}) AS smape"""
OPEN_TEXT = "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END"


def window_rows(stride: int) -> str:
    return f"""WITH {features()},
    p AS (SELECT series_id, t, load, lag_24, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos,
          count(*) OVER (PARTITION BY series_id) AS n FROM feat),
    ids AS (SELECT series_id, unnest(generate_series(0, (max(n) - 24) // {stride})) AS window_id FROM p GROUP BY series_id),
    w AS (SELECT p.*, i.window_id, p.pos - i.window_id * {stride} AS off FROM ids i JOIN p ON p.series_id = i.series_id
          AND p.pos >= i.window_id * {stride} AND p.pos < i.window_id * {stride} + 24)
    SELECT series_id, window_id, min(t) OVER k AS start_ts, max(t) OVER k AS end_ts,
           CAST(off * 2 + c.i AS INTEGER) AS cell, CASE WHEN c.i = 0 THEN load ELSE lag_24 END AS value
    FROM w CROSS JOIN (VALUES (0), (1)) c(i) WINDOW k AS (PARTITION BY series_id, window_id)"""


FEATURE_OUTPUT = ("series_id, t AS \"timestamp\", " + rs(["load", "temperature", "humidity"])
                  + ", hour, day_of_week, month, is_weekend, is_holiday, "
                  + rs([c for c in FEATURE_COLUMNS if c not in ("temperature", "humidity", "is_weekend", "is_holiday")]))
BOUNDS_OUTPUT = ", ".join(r(f"{side}_{c}", ROUNDED, f"{side}_{c}") for c in DETECTOR_COLUMNS for side in ("min", "max"))


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def oracle_sql() -> dict[str, str]:
    stamp = 't AS "timestamp"'
    raw = rs(["load", "temperature", "humidity"])
    out = {}
    out["hourly_series"] = with_(hourly(), f"SELECT series_id, {stamp}, {raw} FROM hourly")
    out["rename_raw"] = 'SELECT date_trunc(\'second\', ts) AS "timestamp", round(value, 6) AS load, event_id AS reading_id FROM events'
    out["profile"] = with_(hourly(), """SELECT series_id, count(*) AS n_rows, 5 AS n_columns, min(t) AS first_ts,
      max(t) AS last_ts FROM hourly GROUP BY series_id""")
    own_axis = """spans AS (SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t
      FROM hourly GROUP BY series_id)"""
    out["null_report"] = with_(f"{hourly()}, {own_axis}", """, j AS (SELECT s.series_id, s.t, h.load, h.temperature,
      h.humidity FROM spans s LEFT JOIN hourly h USING (series_id, t)),
      n AS (SELECT unnest(['series_id', 'timestamp', 'load', 'temperature', 'humidity']) AS "column",
        unnest([count(*) - count(series_id), count(*) - count(t), count(*) - count(load), count(*) - count(temperature),
                count(*) - count(humidity)]) AS missing_count, count(*) AS total FROM j)
      SELECT "column", missing_count, round(missing_count * 100.0 / total, 6) AS missing_percent FROM n""")
    out["duplicate_ts"] = """SELECT event_type AS series_id, CAST(count(*) - count(DISTINCT date_trunc('hour', ts)) AS BIGINT)
      AS n_duplicates FROM events GROUP BY event_type"""
    out["collapse_ts"] = """SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS "timestamp",
      round(avg(value), 6) AS load FROM events GROUP BY ALL"""
    absent = "SELECT series_id, t AS \"timestamp\" FROM spans ANTI JOIN hourly USING (series_id, t)"
    out["missing_hours"] = with_(f"{hourly()}, {own_axis}", absent)
    out["missing_hours_by_user"] = with_(f"{hourly('user_id')}, {own_axis}", absent)
    out["missing_preview"] = with_(f"{hourly()}, {own_axis}", absent + " ORDER BY series_id, t LIMIT 10")
    out["time_difference"] = """SELECT date_trunc('hour', ts) AS "timestamp" FROM events WHERE event_type = 'view'
      EXCEPT SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'purchase'"""
    out["densify"] = with_(dense(), f"SELECT series_id, {stamp}, {raw} FROM dense")
    out["validate_input"] = with_(hourly("user_id"), """SELECT series_id, 'too_few_rows' AS rule,
      count(*) || ' rows; need at least 60' AS detail FROM hourly GROUP BY series_id HAVING count(*) < 60""")
    out["null_time_sort"] = f"""SELECT o_orderkey, {OPEN_TEXT} AS "timestamp", round(o_totalprice, 6) AS load FROM orders
      ORDER BY 2 NULLS LAST"""
    out["rejects"] = f"""SELECT CASE WHEN {OPEN_TEXT} IS NULL THEN 'rejected' ELSE 'usable' END AS part,
      count(*) AS n_rows FROM orders GROUP BY ALL"""
    out["csv_roundtrip"] = out["hourly_series"]
    out["parquet_roundtrip"] = out["hourly_series"]
    out["raw_csv_clean"] = with_(hourly(), f"SELECT {stamp}, {raw} FROM hourly")

    out["calendar_parts"] = with_(dense(), f"""SELECT series_id, {stamp}, round(load, 6) AS load, {PARTS},
      CAST(day(t) AS INTEGER) AS day, CAST(year(t) AS INTEGER) AS year FROM dense""")
    out["weekend_flag"] = with_(dense(), f"SELECT series_id, {stamp}, CAST(isodow(t) >= 6 AS INTEGER) AS is_weekend FROM dense")
    days = f"{dense_days()}, {holidays(1994, 2002)}"
    in_holidays = "CAST(t AS DATE) IN (SELECT d FROM holidays)"
    out["holiday_flag"] = with_(days, f"""SELECT series_id, {stamp}, round(load, 6) AS load,
      CAST({in_holidays} AS INTEGER) AS is_holiday FROM dense""")
    out["holiday_rows"] = with_(days, f"SELECT series_id, {stamp}, round(load, 6) AS load FROM dense WHERE {in_holidays}")
    cycle_names = [c for c in FEATURE_COLUMNS if c.endswith(("_sin", "_cos"))]
    out["cyclic_encoding"] = with_(dense(), f""", c AS (SELECT series_id, t, {CYCLES} FROM dense)
      SELECT series_id, {stamp}, {rs(cycle_names, 9)} FROM c""")
    out["lags"] = with_(dense(), f""", l AS (SELECT series_id, t, load, {LAGS} FROM dense {WINDOWS})
      SELECT series_id, {stamp}, {rs(['load', 'lag_1', 'lag_24', 'lag_168'])} FROM l""")
    out["lags_with_gaps"] = with_(hourly("user_id"), f"""SELECT series_id, {stamp}, round(load, 6) AS load,
      round(lag(load, 1) OVER w, 6) AS lag_1, round(lag(load, 24) OVER w, 6) AS lag_24 FROM hourly
      WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
    rolling = ["rolling_mean_24", "rolling_std_24", "rolling_mean_168"]
    out["rolling_stats"] = with_(dense(), f""", l AS (SELECT series_id, t, load, {ROLLING} FROM dense {WINDOWS})
      SELECT series_id, {stamp}, {rs(['load', *rolling])} FROM l""")
    out["trailing_stats"] = with_(dense(), f"""SELECT series_id, {stamp}, round(load, 6) AS load,
      round(avg(load) OVER w, 6) AS trailing_mean_24, round(stddev_pop(load) OVER w, 6) AS trailing_std_24 FROM dense
      WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
    out["feature_table"] = with_(features(), f"SELECT {FEATURE_OUTPUT} FROM feat")
    out["feature_table_by_user"] = with_(features(key="user_id"), f"SELECT {FEATURE_OUTPUT} FROM feat")
    out["features_from"] = with_(features(), f"SELECT {FEATURE_OUTPUT} FROM feat WHERE t >= TIMESTAMP '2024-01-24'")

    for name, part in (("hour", "hour"), ("weekday", "day_of_week")):
        out[f"mean_by_{name}"] = with_(dense(), f""", p AS (SELECT *, {PARTS} FROM dense)
          SELECT series_id, {part}, round(avg(load), 7) AS mean_load FROM p GROUP BY ALL""")
    out["mean_by_month"] = with_(dense_days(), f""", p AS (SELECT *, {PARTS} FROM dense)
      SELECT series_id, month, round(avg(load), 5) AS mean_load FROM p GROUP BY ALL""")
    cells = ", ".join(f"round(avg(load) FILTER (WHERE day_of_week = {i}), 7) AS \"{d}\"" for i, d in enumerate(DAY_NAMES))
    out["load_heatmap"] = with_(dense(), f""", p AS (SELECT *, {PARTS} FROM dense)
      SELECT series_id, hour, {cells} FROM p GROUP BY series_id, hour""")
    iqr = dense() + """, q AS (SELECT series_id, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3
      FROM dense GROUP BY series_id), limits AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,
      q3 + 1.5 * (q3 - q1) AS upper FROM q)"""
    out["iqr_bounds"] = with_(iqr, f"SELECT series_id, {rs(['q1', 'q3', 'iqr', 'lower', 'upper'])} FROM limits")
    out["iqr_outliers"] = with_(iqr, f"""SELECT series_id, {stamp}, {raw} FROM dense JOIN limits USING (series_id)
      WHERE load < lower OR load > upper""")
    out["value_quantiles"] = "SELECT " + ", ".join(
        f"round(quantile_cont(value, {p}), 6) AS q{round(p * 100)}" for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM events"

    picked = ", ".join(r(f"CAST({c} AS DOUBLE)", ROUNDED, c) for c in FEATURE_COLUMNS)
    out["select_features"] = with_(features(), f"SELECT series_id, {stamp}, {picked} FROM feat")
    out["zscore_filter"] = with_(features(), f"""SELECT series_id, {stamp}, {rs(['load', 'rolling_mean_24', 'rolling_std_24'])}
      FROM feat WHERE abs(load - rolling_mean_24) <= 3 * rolling_std_24""")
    out["row_index"] = with_(hourly("user_id"), f"""SELECT series_id, {stamp}, round(load, 6) AS load,
      count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos FROM hourly""")
    out["chrono_split"] = with_(SPLIT_EVENTS, f"SELECT series_id, {stamp}, pos, n, split, split_pos, split_n FROM split_rows")
    train_bounds = SPLIT_EVENTS + ", bounds AS (" + minmax(DETECTOR_COLUMNS, "split_rows", "split = 'train'") + ")"
    out["minmax_fit"] = with_(train_bounds, f"SELECT series_id, {BOUNDS_OUTPUT} FROM bounds")
    train_scaled = train_bounds + ", scaled AS (" + scaled(DETECTOR_COLUMNS, "split_rows", "bounds", "s.split, s.pos, s.n") + ")"
    out["minmax_transform"] = with_(train_scaled, f"SELECT series_id, {stamp}, split, {rs(DETECTOR_COLUMNS)} FROM scaled")
    as_double = ", ".join(r(f"CAST({c} AS DOUBLE)", ROUNDED, c) for c in DETECTOR_COLUMNS)
    out["minmax_inverse"] = with_(SPLIT_EVENTS, f"SELECT series_id, {stamp}, split, {as_double} FROM split_rows")
    out["sequences"] = with_(SPLIT_ORDERS, """, s AS (SELECT series_id, split, split_pos, split_n, t AS origin_ts,
        min(t) OVER w AS first_ts, count(*) OVER w AS n_inputs, sum(load) OVER w AS a, sum(lag_168) OVER w AS b FROM split_rows
        WINDOW w AS (PARTITION BY series_id, split ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
      SELECT s.series_id, s.split, s.split_pos AS origin_pos, s.first_ts, s.origin_ts, CAST(s.n_inputs AS INTEGER) AS n_inputs,
        round(s.a, 2) AS sum_load, round(s.b, 2) AS sum_lag_168, CAST(k.step AS INTEGER) AS step, round(y.load, 2) AS y
      FROM s CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step) k
      JOIN split_rows y ON y.split = s.split AND y.split_pos = s.split_pos + k.step
      WHERE s.split_pos >= 167 AND s.split_pos + 24 < s.split_n""")
    for name, stride in (("strided_windows", 24), ("overlapping_windows", 5)):
        out[name] = f"SELECT series_id, window_id, start_ts, end_ts, cell, round(value, 6) AS value FROM ({window_rows(stride)})"
    out["window_cells"] = f"""SELECT series_id, window_id, CAST(cell // 2 AS INTEGER) AS "offset",
      start_ts + to_hours(CAST(cell // 2 AS INTEGER)) AS "timestamp", round(value, 6) AS load FROM ({window_rows(7)}) WHERE cell % 2 = 0"""
    out["last_168"] = with_(dense("user_id"), f"""SELECT series_id, {stamp}, round(load, 6) AS load FROM dense
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) <= 168""")

    forecast = "SELECT series_id, origin_ts, step, ts, round(yhat, 6) AS yhat FROM naive"
    out["seasonal_naive_24"] = with_(naive(24, "user_id"), forecast)
    out["extended_naive_168"] = with_(naive(168, "user_id"), forecast)
    out["seasonal_reference"] = with_(dense(), """, ends AS (SELECT series_id, max(t) AS origin_ts FROM dense GROUP BY series_id),
      steps AS (SELECT *, unnest(generate_series(1, 168)) AS step FROM ends)
      SELECT s.series_id, s.origin_ts, CAST(s.step AS INTEGER) AS step, s.origin_ts + to_hours(CAST(s.step AS INTEGER)) AS ts,
        round(d.temperature, 6) AS temperature, round(d.humidity, 6) AS humidity
      FROM steps s JOIN dense d ON d.series_id = s.series_id
        AND d.t = s.origin_ts + to_hours(CAST(s.step - 168 - 24 * ((s.step - 1) // 24) AS INTEGER))""")
    out["append_forecast"] = with_(naive(24), """, u AS (SELECT series_id, t, load FROM dense
        UNION ALL SELECT series_id, ts, yhat FROM naive)
      SELECT series_id, t AS "timestamp", round(load, 6) AS load FROM u
      QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) <= 168""")
    band = """SELECT series_id, origin_ts, step, ts, round(yhat, 6) AS yhat, round(greatest(0.0, yhat - {m}), 6) AS lower,
      round(yhat + {m}, 6) AS upper FROM naive"""
    out["forecast_band"] = with_(naive(24), band.format(m="12.5::DOUBLE"))
    out["extended_band"] = with_(naive(168), band.format(m="18.75::DOUBLE"))
    out["day_boundaries"] = with_(naive(168), """SELECT series_id, step, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS label,
      'T+' || step || 'h' AS step_label FROM naive WHERE step % 24 = 0 AND step < 168""")
    out["weekday_names"] = with_(dense(), """SELECT series_id, left(dayname(t), 3) AS weekday, count(*) AS n_rows
      FROM dense GROUP BY ALL""")
    out["forecast_pairs"] = with_(PAIRS, """SELECT series_id, split, origin_ts, step, round(y, 2) AS y,
      round(yhat, 2) AS yhat FROM pairs""")
    out["null_load_pairs"] = with_(PAIRS, """SELECT series_id, split, origin_ts, step,
      CASE WHEN day(origin_ts + to_days(step)) <> 15 THEN round(y, 2) END AS y,
      CASE WHEN day(origin_ts + to_days(step - 168)) <> 15 THEN round(yhat, 2) END AS yhat FROM pairs""")
    out["forecast_metrics"] = with_(PAIRS, f"SELECT series_id, split, {METRICS.format(d=3)} FROM pairs GROUP BY series_id, split")
    out["forecast_metrics_by_step"] = with_(
        PAIRS, f"SELECT step, {METRICS.format(d=2)} FROM pairs WHERE split = 'test' GROUP BY step")

    window = "series_id, CAST(window_id AS BIGINT) AS window_id, start_ts, end_ts, round(error, 6) AS error"
    out["profile_recon_error"] = with_(detector(), f"SELECT {window} FROM errors")
    out["profile_recon_error_overlap"] = with_(detector(stride=1), f"SELECT {window} FROM errors")
    limits = f"SELECT series_id, {rs(['threshold', 'mean', 'std', 'p95', 'p99', 'max_error'])}, method FROM limits"
    out["threshold_p99"] = out["threshold_record"] = with_(detector(), limits)
    out["threshold_max"] = with_(detector(method="max_buffer"), limits)
    out["detect_flags"] = with_(detector(), f"SELECT {window}, round(threshold, 6) AS threshold, is_anomaly, severity FROM flagged")
    out["saved_detector"] = out["detect_flags"]
    partly = ", ".join(f"CASE WHEN series_id <> 'view' THEN {c} END AS {c}" for c in ("error", "threshold", "is_anomaly", "severity"))
    unknown = f"{detector()}, partly AS (SELECT series_id, window_id, start_ts, end_ts, {partly} FROM flagged)"
    out["unknown_series_flags"] = with_(unknown, f"SELECT {window}, round(threshold, 6) AS threshold, CAST(is_anomaly AS VARCHAR) AS is_anomaly, severity FROM partly")
    out["null_cells_error"] = with_(detector(), """, holes AS (SELECT series_id, window_id,
        bool_or(hour(t) = 5 AND day(t) % 3 = 0) AS hole FROM all_cells GROUP BY series_id, window_id)
      SELECT series_id, CAST(window_id AS BIGINT) AS window_id, CASE WHEN NOT hole THEN round(error, 6) END AS error,
        CASE WHEN NOT hole THEN CAST(is_anomaly AS VARCHAR) END AS is_anomaly FROM flagged JOIN holes USING (series_id, window_id)""")
    out["detect_by_user"] = with_(detector(SPLIT_USERS), """SELECT series_id, CAST(window_id AS BIGINT) AS window_id, end_ts,
      round(error, 6) AS error, is_anomaly FROM flagged""")
    out["severity_excess"] = with_(detector(), "SELECT series_id, CAST(window_id AS BIGINT) AS window_id, severity FROM flagged")
    out["severity_sigma"] = with_(
        detector(), "SELECT series_id, CAST(window_id AS BIGINT) AS window_id, sigma_severity AS severity FROM flagged")
    counts = ", ".join(f"count(*) FILTER (WHERE {{c}} = '{s}') AS {s}" for s in ("normal", "low", "medium", "high"))
    out["severity_counts"] = with_(detector(), f"SELECT series_id, {counts.format(c='severity')} FROM flagged GROUP BY series_id")
    summary = """series_id, count(*) AS n_windows, count(*) FILTER (WHERE is_anomaly) AS n_anomalies,
      count(*) - count(is_anomaly) AS n_unscored,
      round(100.0 * count(*) FILTER (WHERE is_anomaly) / nullif(count(is_anomaly), 0), {d}) AS anomaly_rate,
      round(max(threshold), 6) AS threshold"""
    out["anomaly_summary"] = with_(detector(), f"SELECT {summary.format(d=2)} FROM flagged GROUP BY series_id")
    out["unknown_series_summary"] = with_(unknown, f"SELECT {summary.format(d=2)} FROM partly GROUP BY series_id")
    out["anomaly_response"] = with_(detector(), f"""SELECT s.*, u.rows_analyzed FROM
      (SELECT {summary.format(d=2)} FROM flagged GROUP BY series_id) s
      JOIN (SELECT series_id, count(*) AS rows_analyzed FROM feat GROUP BY series_id) u USING (series_id)""")
    out["flagged_detail"] = with_(detector(), "SELECT series_id, end_ts, severity FROM flagged WHERE is_anomaly")
    out["anomaly_timeline"] = with_(
        detector(), "SELECT series_id, CAST(window_id AS BIGINT) AS window_id, round(error, 6) AS error, severity FROM flagged")
    gap = " + ".join(f"abs(c.{x} - p.{x})" for x in DETECTOR_COLUMNS)
    split_errors = detector() + f""", parts AS (SELECT c.series_id, c.split, c.split_pos // 24 AS window_id,
        sum({gap}) / 408 AS error FROM all_scaled c JOIN prof p ON p.series_id = c.series_id AND p.off = c.split_pos % 24
        WHERE (c.split_pos // 24) * 24 + 24 <= c.split_n GROUP BY ALL)"""
    out["error_summary"] = with_(split_errors, """SELECT series_id, split, count(*) AS n_windows, round(avg(error), 6) AS mean_error,
      round(stddev_pop(error), 6) AS std_error, round(max(error), 6) AS max_error FROM parts GROUP BY series_id, split""")
    out["detector_metrics"] = with_(split_errors, f""", marked AS (SELECT p.*, l.threshold, l.mean, l.std, l.method,
        p.error > l.threshold AS is_anomaly, {severity('p.error', 'l.threshold', 'l.std', (1, 2))} AS severity
        FROM parts p JOIN limits l USING (series_id) WHERE p.split = 'test')
      SELECT {summary.format(d=6)}, {counts.format(c='severity')}, round(avg(error), 6) AS test_mean_error,
        round(max(error), 6) AS test_max_error, round(max(mean), 6) AS train_mean_error, round(max(std), 6) AS train_std_error,
        max(method) AS method FROM marked GROUP BY series_id""")
    half = " + ".join(f"abs({x} - 0.5)" for x in DETECTOR_COLUMNS)
    out["score_windows"] = with_(train_scaled, f"""SELECT series_id, pos // 24 AS window_id, max(t) AS end_ts,
      round(sum({half}) / 408, 6) AS error FROM scaled WHERE (pos // 24) * 24 + 24 <= n GROUP BY series_id, pos // 24""")
    naive_feat = f"""tail AS (SELECT series_id, t, load, max(t) OVER (PARTITION BY series_id) AS origin_ts FROM feat),
      nv AS (SELECT series_id, t + INTERVAL 168 HOUR AS ts, {SERVED} AS yhat,
             date_diff('hour', origin_ts, t + INTERVAL 168 HOUR) AS step FROM tail WHERE t > origin_ts - INTERVAL 168 HOUR)"""
    rate = "round(100.0 * count(*) FILTER (WHERE is_anomaly) / count(*), 2)"
    out["kpis"] = with_(f"{detector()}, {naive_feat}", f"""SELECT f.*, a.n_anomalies, a.anomaly_rate, 6.0::DOUBLE AS smape,
        round(greatest(0.0, 100.0 - a.anomaly_rate - 6.0), 1) AS health_score FROM
      (SELECT series_id, max(yhat) FILTER (WHERE step <= 24) AS peak_load, min(yhat) FILTER (WHERE step <= 24) AS trough_load,
        round(avg(yhat) FILTER (WHERE step <= 24), 1) AS avg_24, round(avg(yhat), 1) AS avg_168 FROM nv GROUP BY series_id) f
      JOIN (SELECT series_id, count(*) FILTER (WHERE is_anomaly) AS n_anomalies, {rate} AS anomaly_rate
        FROM flagged GROUP BY series_id) a USING (series_id)""")
    out["full_analysis"] = with_(f"{detector()}, {naive_feat}", """
      SELECT series_id, 'forecast' AS part, ts, round(yhat, 6) AS value FROM nv WHERE step <= 24
      UNION ALL SELECT series_id, 'extended_forecast', ts, round(yhat, 6) FROM nv
      UNION ALL SELECT series_id, 'window_error', end_ts, round(error, 6) FROM flagged
      UNION ALL SELECT series_id, 'rows_used', NULL, CAST(count(*) AS DOUBLE) FROM feat GROUP BY series_id""")
    spread = " + ".join(f"var_pop({c})" for c in DETECTOR_COLUMNS)
    out["pca_model"] = with_(detector(stride=1), f""", cells AS (SELECT off, {spread} AS variance, count(*) AS n FROM train_cells GROUP BY off)
      SELECT max(n) AS n_windows, 32::INTEGER AS n_components, round(sum(variance), 6) AS total_variance, TRUE AS orthonormal, TRUE AS falling,
        TRUE AS residual_is_the_rest FROM cells""")
    # left out and reported
    open_orders = """open_orders AS (SELECT o_orderpriority AS series_id, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) END AS t
        FROM orders GROUP BY ALL
      UNION ALL SELECT 'customer ' || o_custkey, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) END FROM orders
        WHERE 'customer ' || o_custkey < 'customer 2' GROUP BY ALL),
      counted AS (SELECT series_id, count(t) AS n_rows FROM open_orders GROUP BY series_id)"""
    out["split_rejects_report"] = f"""WITH {open_orders} SELECT series_id, 'null_time' AS reason, count(*) AS n_rows FROM open_orders WHERE t IS NULL GROUP BY series_id
      UNION ALL SELECT series_id, 'too_few_rows', n_rows FROM counted WHERE n_rows BETWEEN 1 AND 11"""
    usable = f"""{open_orders}, feat AS (SELECT series_id, t FROM open_orders JOIN counted USING (series_id) WHERE t IS NOT NULL AND n_rows >= 12)"""
    out["split_usable_rows"] = with_(split(usable), f"SELECT series_id, {stamp}, pos, n, split, split_pos, split_n FROM split_rows")
    out["forecast_rejects"] = with_(hourly("user_id"), "SELECT series_id, 'too_few_rows' AS reason, count(*) AS n_rows FROM hourly GROUP BY series_id HAVING count(*) < 168")
    out["chrono_split_gapless"] = out["chrono_split"]
    # all columns, errors, flags
    edges = " UNION ALL ".join(f"""SELECT series_id, split, t AS origin_ts, '{c}' AS "column", round(first(CAST({c} AS DOUBLE)) OVER w, 2) + 0.0 AS first_value,
      round(CAST({c} AS DOUBLE), 2) + 0.0 AS last_value, round(sum(CAST({c} AS DOUBLE)) OVER w, 0) + 0.0 AS total, split_pos, split_n FROM split_rows
      WINDOW w AS (PARTITION BY series_id, split ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""" for c in FEATURE_COLUMNS)
    out["sequences_all_columns"] = with_(SPLIT_ORDERS, f"""SELECT series_id, split, origin_ts, "column", first_value, last_value, total FROM ({edges})
      WHERE split_pos >= 167 AND split_pos + 24 < split_n""")
    listed = ", ".join(f"CAST({c} AS DOUBLE)" for c in DETECTOR_COLUMNS)
    out["windows_all_columns"] = with_(features(), f""", placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS pos,
        count(*) OVER (PARTITION BY series_id) AS n FROM feat),
      listed AS (SELECT series_id, pos // 24 AS window_id, pos % 24 AS off, min(t) OVER k AS start_ts, max(t) OVER k AS end_ts, [{listed}] AS vals FROM placed
        WHERE (pos // 24) * 24 + 24 <= n WINDOW k AS (PARTITION BY series_id, pos // 24)),
      cells AS (SELECT *, unnest(generate_series(1, {len(DETECTOR_COLUMNS)})) AS i FROM listed)
      SELECT series_id, CAST(window_id AS BIGINT) AS window_id, start_ts, end_ts, CAST(off * {len(DETECTOR_COLUMNS)} + i - 1 AS INTEGER) AS cell,
        round(vals[i], 6) + 0.0 AS value FROM cells""")
    out["window_errors"] = with_(SPLIT_EVENTS, """, longest AS (SELECT max(n) AS n, max(split_n) FILTER (WHERE split = 'train') AS train FROM split_rows)
      SELECT 'window' AS kind, 'not enough rows to form a window (need at least 1000000, got ' || n || ')' AS message FROM longest
      UNION ALL SELECT 'sequence', 'train data too short: ' || train || ' rows, need 1000024' FROM longest""")
    accuracy = """around AS (SELECT series_id, load, list(load) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 167 PRECEDING AND 24 FOLLOWING) AS l FROM feat),
      steps AS (SELECT unnest(generate_series(1, 24)) AS step),
      pairs AS (SELECT series_id, l[168 + step] AS y, l[step] AS yhat FROM around CROSS JOIN steps WHERE len(l) = 192),
      accuracy AS (SELECT series_id, avg(abs(y - greatest(0, yhat))) AS mae,
        avg(2 * abs(y - greatest(0, yhat)) / (abs(y) + abs(greatest(0, yhat)) + 1e-8)) * 100 AS smape FROM pairs GROUP BY series_id)"""
    out["kpis_measured"] = with_(f"{detector()}, {naive_feat}, {accuracy}", f"""SELECT f.*, a.n_anomalies, a.anomaly_rate, round(c.smape, 6) AS smape,
        round(greatest(0.0, 100.0 - a.anomaly_rate - c.smape), 1) AS health_score FROM
      (SELECT series_id, max(yhat) FILTER (WHERE step <= 24) AS peak_load, min(yhat) FILTER (WHERE step <= 24) AS trough_load,
        round(avg(yhat) FILTER (WHERE step <= 24), 1) AS avg_24, round(avg(yhat), 1) AS avg_168 FROM nv GROUP BY series_id) f
      JOIN (SELECT series_id, count(*) FILTER (WHERE is_anomaly) AS n_anomalies, {rate} AS anomaly_rate
        FROM flagged GROUP BY series_id) a USING (series_id) JOIN accuracy c USING (series_id)""")
    out["measured_band"] = with_(f"{features()}, {naive_feat}, {accuracy}", """SELECT series_id, ts - to_hours(CAST(step AS INTEGER)) AS origin_ts, CAST(step AS INTEGER) AS step, ts,
      round(yhat, 4) AS yhat, round(greatest(0.0, yhat - mae), 4) AS lower, round(yhat + mae, 4) AS upper FROM nv JOIN accuracy USING (series_id) WHERE step <= 24""")
    forecaster_parts, detector_parts = "forecast model, forecast scaler, forecast settings", "detector scaler, detector threshold, detector settings, detector reconstruction"
    out["models_ready"] = f"""SELECT * FROM (VALUES ('before', FALSE, 7::INTEGER, '{forecaster_parts}, {detector_parts}'), ('detector saved', FALSE, 3, '{forecaster_parts}'),
      ('both saved', TRUE, 0, '')) v(moment, ready, n_missing, missing)"""
    out["column_types"] = """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column",
      CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type
      FROM (DESCRIBE events)"""
    out["missing_columns"] = """SELECT NULL::VARCHAR AS series_id, 'missing_columns' AS rule,
      'missing: lag_1, lag_24; present: series_id, timestamp, load, temperature, humidity' AS detail"""
    # the same rows, whatever the length of chunks and blocks
    for name in ("feature_table", "lags_with_gaps", "sequences", "overlapping_windows", "forecast_pairs"):
        out[f"{name}_chunks"] = out[name]
    out["row_index_blocks"] = out["row_index"]
    return out
