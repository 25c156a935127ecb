"""SQL of the queries with a forecaster trained in rounds.

Sums of products, every round of gradient descent (a recursive query on
lists), scores and the chained forecast are written out in SQL, so that fitted
models are checked number by number like everything else.
"""

from __future__ import annotations

from ..operators.rounds import MIN_DELTA, MIN_VARIANCE, Settings, search_points
from ..schema import FEATURE_COLUMNS, MIN_RATE, RATE_FACTOR, RATE_PATIENCE, TARGET_COLUMN
from .oracles import CYCLES, METRICS, PAIRS, SPLIT_ORDERS, SPLIT_PRIORITY, minmax, scaled

CYCLE_NAMES = [c for c in FEATURE_COLUMNS if c.endswith(("_sin", "_cos"))]
BACK = (24, 48, 168)
INPUTS = [*FEATURE_COLUMNS, *(f"target_{c}" for c in CYCLE_NAMES), *(f"load_{k}_before" for k in BACK)]
K = len(INPUTS)


def cycles(time: str, prefix: str) -> str:
    """Sine and cosine of hour, weekday and month of ``time``."""
    return CYCLES.replace("(t)", f"({time})").replace(" AS ", f" AS {prefix}")


def frame(split_rows: str = SPLIT_ORDERS) -> str:
    """(origin, step) rows with scaled inputs, and each as the list x = [1, inputs..., label]."""
    columns = [*FEATURE_COLUMNS, TARGET_COLUMN]
    return f"""{split_rows},
    bounds AS MATERIALIZED ({minmax(columns, 'split_rows', "split = 'train'")}),
    sc AS ({scaled(columns, 'split_rows', 'bounds', 's.split, s.split_pos, s.split_n')}),
    origins AS MATERIALIZED (SELECT * FROM (SELECT *, list(load) OVER (PARTITION BY series_id, split ORDER BY split_pos
        ROWS BETWEEN 167 PRECEDING AND 24 FOLLOWING) AS around FROM sc) WHERE split_pos >= 167 AND split_pos + 24 < split_n),
    steps AS (SELECT unnest(generate_series(1, 24)) AS step),
    cut AS (SELECT o.* EXCLUDE (t, load), o.t AS origin_ts, s.step, o.t + to_days(CAST(s.step AS INTEGER)) AS ts,
      {', '.join(f'around[{168 - k} + s.step] AS load_{k}_before' for k in BACK)}, around[168 + s.step] AS label
      FROM origins o CROSS JOIN steps s),
    frame AS MATERIALIZED (SELECT series_id, split, origin_ts, step, ts, [1.0::DOUBLE, {', '.join(f'CAST({c} AS DOUBLE)' for c in INPUTS)}, label] AS x
      FROM (SELECT *, {cycles('ts', 'target_')} FROM cut))"""


def sums(split_rows: str = SPLIT_ORDERS) -> str:
    """``stats``: one row with the mean products m (train) and h (val), and from them centre, scale, a and b."""
    n = K + 2
    cells = ", ".join("[" + ", ".join(f"sum(x[{min(i, j)}] * x[{max(i, j)}])" for j in range(1, n + 1)) + "]" for i in range(1, n + 1))
    each = f"generate_series(1, {K})"
    return f"""{frame(split_rows)},
    products AS (SELECT split, [{cells}] AS p FROM frame WHERE split <> 'test' GROUP BY split),
    means AS (SELECT split, list_transform(p, lambda r: list_transform(r, lambda v: v / p[1][1])) AS m FROM products),
    both_ AS (SELECT (SELECT m FROM means WHERE split = 'train') AS m, (SELECT m FROM means WHERE split = 'val') AS h),
    variances AS (SELECT *, list_transform({each}, lambda i: m[i + 1][i + 1] - m[1][i + 1] * m[1][i + 1]) AS variance FROM both_),
    scales AS (SELECT *, list_transform(variance, lambda v: CASE WHEN v > {MIN_VARIANCE} THEN sqrt(v) ELSE 1.0 END) AS scale,
      list_transform(variance, lambda v: CASE WHEN v > {MIN_VARIANCE} THEN 1.0 ELSE 0.0 END) AS live FROM variances),
    stats AS MATERIALIZED (SELECT m, h, scale, list_sum(live) AS n_live,
      list_transform({each}, lambda i: list_transform({each}, lambda j:
        live[i] * live[j] * (m[i + 1][j + 1] - m[1][i + 1] * m[1][j + 1]) / (scale[i] * scale[j]))) AS a,
      list_transform({each}, lambda i: live[i] * (m[i + 1][{n}] - m[1][i + 1] * m[1][{n}]) / scale[i]) AS b FROM scales)"""


def rounds(points: list[Settings], base: str | None = None, name: str = "run", given: str | None = None) -> str:
    """``name``: a row for each trial and round; ``signed`` is [intercept, weights..., -1]."""
    fields = ("learning_rate", "momentum", "l2", "warmup", "rounds", "patience")
    values = ", ".join(f"({i}, " + ", ".join(f"{getattr(p, f)!r}" for f in fields) + ")" for i, p in enumerate(points))
    settings = given or f"SELECT trial, CAST(learning_rate AS DOUBLE) AS learning_rate, CAST(momentum AS DOUBLE) AS momentum, CAST(l2 AS DOUBLE) AS l2, warmup, rounds, patience FROM (VALUES {values}) p(trial, {', '.join(fields)})"
    each = f"generate_series(1, {K})"
    quadratic = "list_dot_product(list_transform({q}, lambda r: list_dot_product(r, signed)), signed)"
    return f"""{base or sums()},
    {name}_settings AS ({settings}),
    {name} AS MATERIALIZED (WITH RECURSIVE walk AS (
      SELECT trial, 0 AS round, learning_rate AS rate, 0.0::DOUBLE AS used, list_transform({each}, lambda i: 0.0::DOUBLE) AS v,
        list_transform({each}, lambda i: 0.0::DOUBLE) AS step, NULL::DOUBLE[] AS signed, 0.0::DOUBLE AS loss, 0.0::DOUBLE AS val_loss,
        'infinity'::DOUBLE AS best, 0 AS best_round, 0 AS wait, 0 AS flat FROM {name}_settings
      UNION ALL
      SELECT trial, round, CASE WHEN NOT better AND flat + 1 >= {RATE_PATIENCE} THEN greatest(rate * {RATE_FACTOR}, {MIN_RATE}) ELSE rate END, used, v, step,
        signed, loss, val_loss, CASE WHEN better THEN val_loss ELSE best END, CASE WHEN better THEN round ELSE best_round END,
        CASE WHEN better THEN 0 ELSE wait + 1 END, CASE WHEN better OR flat + 1 >= {RATE_PATIENCE} THEN 0 ELSE flat + 1 END
      FROM (SELECT *, val_loss < best - {MIN_DELTA} AS better
      FROM (SELECT *, {quadratic.format(q='m')} AS loss, {quadratic.format(q='h')} AS val_loss
      FROM (SELECT *, list_concat([m[1][{K + 2}] - list_dot_product(w, m[1][2:{K + 1}])], w, [-1.0::DOUBLE]) AS signed
      FROM (SELECT *, list_transform({each}, lambda i: v[i] / scale[i]) AS w
      FROM (SELECT * REPLACE (list_transform({each}, lambda i: v[i] + step[i]) AS v)
      FROM (SELECT * REPLACE (list_transform({each}, lambda i: momentum * step[i] - used / greatest(1, n_live)
          * (2.0 * (list_dot_product(a[i], v) - b[i]) + 2.0 * l2 * v[i])) AS step)
      FROM (SELECT walk.trial, walk.round + 1 AS round, walk.rate, CASE WHEN warmup > 0 THEN walk.rate * least(1.0, (walk.round + 1) / warmup) ELSE walk.rate END AS used,
          walk.v, walk.step, walk.best, walk.best_round, walk.wait, walk.flat, p.momentum, p.l2, stats.*
        FROM walk JOIN {name}_settings p USING (trial) CROSS JOIN stats WHERE walk.round < p.rounds AND walk.wait < p.patience)))))))
    ) SELECT trial, round, used, signed, loss, val_loss, best_round FROM walk WHERE round > 0),
    {name}_last AS (SELECT trial, max(round) AS rounds, arg_max(best_round, round) AS best_round FROM {name} GROUP BY trial),
    {name}_kept AS MATERIALIZED (SELECT r.trial, l.rounds, l.best_round, r.signed, r.val_loss FROM {name} r JOIN {name}_last l ON r.trial = l.trial AND r.round = l.best_round)"""


def searched() -> str:
    """All trials, and ``run``: the rounds of the best one's settings."""
    trials = rounds(search_points(), name="trial")
    full = Settings()
    return rounds([], f"""{trials},
    tried AS MATERIALIZED (SELECT k.trial, any_value(k.rounds) AS rounds, any_value(k.best_round) AS best_round, any_value(k.val_loss) AS val_loss,
      avg(abs(list_dot_product(k.signed, f.x))) AS val_mae FROM trial_kept k CROSS JOIN frame f WHERE f.split = 'val' GROUP BY k.trial)""",
                  given=f"""SELECT trial, p.learning_rate, p.momentum, p.l2, p.warmup, {full.rounds} AS rounds, {full.patience} AS patience
      FROM trial_settings p JOIN tried USING (trial) ORDER BY val_mae, trial LIMIT 1""")


def history(base: str) -> str:
    return f"""{base},
    maes AS (SELECT r.round, avg(abs(list_dot_product(r.signed, f.x))) AS val_mae FROM run r CROSS JOIN frame f WHERE f.split = 'val' GROUP BY r.round),
    history AS (SELECT 'forecaster' AS run_id, CAST(round AS INTEGER) AS epoch, unnest(['loss', 'val_loss', 'val_mae', 'learning_rate']) AS metric,
      unnest([loss, val_loss, val_mae, used]) AS value FROM run JOIN maes USING (round))"""


def state(base: str) -> str:
    """``day0``: the newest row, the last 168 loads and the 24th of the last 168 rows of each series."""
    return f"""{base},
    tail AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS place, count(*) OVER (PARTITION BY series_id) AS rows_
      FROM (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t DESC) <= 168)),
    lists AS (SELECT series_id, max(t) AS first_ts, list(load ORDER BY t) AS loads FROM tail GROUP BY series_id HAVING count(*) = 168),
    newest AS (SELECT * FROM tail WHERE place = 168), middle AS (SELECT * FROM tail WHERE place = 24),
    day0 AS (SELECT l.series_id, l.first_ts, l.first_ts AS now, l.loads, {', '.join(f'CAST(n.{c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)}
      FROM lists l JOIN newest n USING (series_id))"""


def day(number: int) -> str:
    """``made<number>``: 24 forecasts from ``day<number>``; and the state after them."""
    width = {c: f"(CASE WHEN b.max_{c} = b.min_{c} THEN 1.0 ELSE b.max_{c} - b.min_{c} END)" for c in [*FEATURE_COLUMNS, TARGET_COLUMN]}
    features = ", ".join(f"(d.{c} - b.min_{c}) / {width[c]}" for c in FEATURE_COLUMNS)
    back = ", ".join(f"(d.loads[{168 - k} + s.step] - b.min_load) / {width['load']}" for k in BACK)
    target = ", ".join(f"target_{c}" for c in CYCLE_NAMES)
    predict = f"""made{number} AS MATERIALIZED (SELECT series_id, first_ts, now, step, {number} * 24 + step AS full_step, ts,
        greatest(0.0, round(list_dot_product(list_concat([1.0::DOUBLE], own, [{target}], refs), weights) * width + low, 2)) AS yhat
      FROM (SELECT *, {cycles('ts', 'target_')} FROM (SELECT d.series_id, d.first_ts, d.now, s.step, d.now + to_days(CAST(s.step AS INTEGER)) AS ts,
        [{features}] AS own, [{back}] AS refs, k.signed[1:{K + 1}] AS weights, {width['load']} AS width, b.min_load AS low
        FROM day{number} d JOIN bounds b USING (series_id) CROSS JOIN steps s CROSS JOIN run_kept k)))"""
    mean = "list_avg(loads[{a}:192])"
    made = {
        "is_weekend": "CAST(isodow(now) >= 6 AS DOUBLE)", "is_holiday": "0.0", "lag_1": "loads[191]", "lag_24": "loads[168]", "lag_168": "loads[24]",
        "rolling_mean_24": mean.format(a=169), "rolling_std_24": "list_stddev_pop(loads[169:192])", "rolling_mean_168": mean.format(a=25),
    }
    kept = ", ".join(f"{made[c]} AS {c}" if c in made else c for c in FEATURE_COLUMNS if c not in CYCLE_NAMES)
    order = ", ".join(FEATURE_COLUMNS)
    return f"""{predict},
    after{number} AS (SELECT d.series_id, d.first_ts, max(m.ts) AS now, list_concat(any_value(d.loads), list(m.yhat ORDER BY m.step)) AS loads
      FROM day{number} d JOIN made{number} m USING (series_id) GROUP BY d.series_id, d.first_ts),
    day{number + 1} AS (SELECT series_id, first_ts, now, loads[25:192] AS loads, {order}
      FROM (SELECT series_id, first_ts, now, loads, {kept}, {cycles('now', '')}
        FROM after{number} JOIN (SELECT series_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS if c not in CYCLE_NAMES and c not in made)} FROM middle) USING (series_id)))"""


def label(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%dT%H:%M:%S')"


def round_sql() -> dict[str, str]:
    out = {}
    plain = rounds([Settings()])
    best = searched()
    one = f"""SELECT series_id, first_ts AS origin_ts, CAST(step AS INTEGER) AS step, ts, round(yhat, 2) AS yhat, {label('ts')} AS label FROM made0"""
    out["forecast_ml_24"] = f"WITH {state(plain)}, {day(0)} {one}"
    out["saved_forecaster"] = f"WITH {state(best)}, {day(0)} {one}"
    chain = ", ".join(day(i) for i in range(7))
    union = " UNION ALL ".join(f"SELECT * FROM made{i}" for i in range(7))
    out["forecast_ml_168"] = f"""WITH {state(plain)}, {chain} SELECT series_id, first_ts AS origin_ts, CAST(full_step AS INTEGER) AS step, ts,
      round(yhat, 1) AS yhat, {label('ts')} AS label FROM ({union})"""
    low, width = "b.min_load", "(CASE WHEN b.max_load = b.min_load THEN 1.0 ELSE b.max_load - b.min_load END)"
    scored = f"""fitted_pairs AS (SELECT f.series_id, f.split, f.x[{K + 2}] * {width} + {low} AS y,
        list_dot_product(f.x[1:{K + 1}], k.signed[1:{K + 1}]) * {width} + {low} AS yhat
      FROM frame f JOIN bounds b USING (series_id) CROSS JOIN run_kept k WHERE f.split <> 'train')"""
    naive = PAIRS[len(SPLIT_ORDERS):]
    out["forecaster_metrics"] = f"""WITH {plain}, {scored}{naive}
      SELECT series_id, split, 'fitted' AS model, {METRICS.format(d=3)} FROM fitted_pairs GROUP BY series_id, split
      UNION ALL SELECT series_id, split, 'seasonal_naive', {METRICS.format(d=3)} FROM pairs WHERE split <> 'train' GROUP BY series_id, split"""
    several = rounds([Settings()], sums(SPLIT_PRIORITY))
    out["forecast_ml_24_by_priority"] = f"WITH {state(several)}, {day(0)} {one}"
    out["forecaster_metrics_by_priority"] = f"WITH {several}, {scored} SELECT series_id, split, {METRICS.format(d=2)} FROM fitted_pairs GROUP BY series_id, split"
    out["tune_forecaster"] = f"""WITH {best} SELECT CAST(t.trial AS INTEGER) AS trial, round(p.learning_rate, 6) AS learning_rate, round(p.momentum, 6) AS momentum,
      round(p.l2, 6) AS l2, CAST(p.warmup AS INTEGER) AS warmup, CAST(t.rounds AS INTEGER) AS rounds, CAST(p.patience AS INTEGER) AS patience,
      CAST(t.best_round AS INTEGER) AS best_round, round(t.val_loss, 6) AS val_loss, round(t.val_mae, 6) AS val_mae
      FROM tried t JOIN trial_settings p USING (trial)"""
    out["training_history"] = f"WITH {history(best)} SELECT run_id, epoch, metric, round(value, 6) AS value FROM history"
    out["history_best"] = f"""WITH {history(best)} SELECT run_id, metric, count(*) AS epochs, round(min(value), 6) AS best_value,
      arg_min(epoch, (value, epoch)) AS best_epoch FROM history GROUP BY run_id, metric"""
    out["run_log"] = f"""WITH {best}, {scored},
      tested AS (SELECT {METRICS.format(d=3)} FROM fitted_pairs WHERE split = 'test')
      SELECT 'forecaster' AS run_id, 'param' AS kind, unnest(['learning_rate', 'momentum', 'l2', 'warmup']) AS key,
        unnest([CAST(learning_rate AS VARCHAR), CAST(momentum AS VARCHAR), CASE WHEN l2 = 0.0001 THEN '0.0001' ELSE CAST(l2 AS VARCHAR) END, CAST(warmup AS VARCHAR)]) AS value,
        NULL::DOUBLE AS number FROM run_settings
      UNION ALL SELECT 'forecaster', 'metric', unnest(['best_val_loss', 'epochs_trained', 'test_mae', 'test_rmse', 'test_smape']), NULL,
        unnest([round(val_loss, 3), CAST(rounds AS DOUBLE), mae, rmse, smape]) FROM run_kept CROSS JOIN tested"""
    return out
