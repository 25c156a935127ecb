import numpy as np
import pytest

from frames import noisy, pdf, series
from tidewatt.errors import WindowError
from tidewatt.operators import features, forecast, prepare, rounds
from tidewatt.plans import training
from tidewatt.sources import artefacts


def by_hand(train, val, settings):
    """Gradient descent over the rows themselves."""
    x, y = train[:, :-1], train[:, -1]
    centre, spread = x.mean(0), x.std(0)
    live = spread**2 > rounds.MIN_VARIANCE
    z = np.where(live, (x - centre) / np.where(live, spread, 1), 0)
    v, step, rate, best, wait, flat, out = np.zeros(x.shape[1]), np.zeros(x.shape[1]), settings.learning_rate, np.inf, 0, 0, []
    for number in range(1, settings.rounds + 1):
        used = rate * min(1, number / settings.warmup) if settings.warmup else rate
        slope = 2 * z.T @ (z @ v - (y - y.mean())) / len(y) + 2 * settings.l2 * v
        step = settings.momentum * step - used / live.sum() * slope
        v = v + step
        w = v / np.where(live, spread, 1)
        bias = y.mean() - w @ centre
        errors = [part[:, -1] - part[:, :-1] @ w - bias for part in (train, val)]
        out.append((np.mean(errors[0]**2), np.mean(errors[1]**2), np.mean(abs(errors[1])), used))
        if out[-1][1] < best - rounds.MIN_DELTA:
            best, wait, flat = out[-1][1], 0, 0
            continue
        wait, flat = wait + 1, flat + 1
        if flat >= 5:
            rate, flat = max(rate / 2, 1e-7), 0
        if wait >= settings.patience:
            break
    return np.array(out)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(600, 3)) * [1, 5, 0.1], np.full(600, 7.0)])
    y = x @ [1, -0.2, 3, 0.5] + rng.normal(size=600) * 0.3
    data = [("train" if i < 400 else "val", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    data += [("train", None, 1.0, 1.0, 1.0, 1.0), ("val", 1.0, 1.0, 1.0, 1.0, float("nan"))]
    return spark.createDataFrame(data, "split string, a double, b double, c double, d double, label double").repartition(5)


@pytest.mark.parametrize("settings", [rounds.Settings(), rounds.Settings(0.6, 0.0, 0.01, 0), rounds.Settings(0.9, 0.95, patience=3), rounds.Settings(rounds=4)])
def test_history_is_that_of_descent_over_the_rows(rows, settings):
    sums = rounds.moments(rows, list("abcd"))
    made = rounds.train(sums, settings)
    local = rows.toPandas().dropna()
    parts = [local[local.split == s].drop(columns="split").to_numpy() for s in ("train", "val")]
    want = by_hand(*parts, settings)
    assert (sums.rows("train"), sums.rows("val")) == (400, 200) and len(made.models) == len(want)
    errors = rounds.absolute_errors(rows.where("split = 'val'"), made.models, list("abcd"))
    got = np.column_stack([made.history["loss"], made.history["val_loss"], errors, made.history["learning_rate"]])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and made.best == want[:, 1].argmin() + 1


def test_the_kept_model_is_a_pipeline(rows):
    made = rounds.train(rounds.moments(rows, list("abcd")))
    scored = made.model().transform(rows.where("split = 'val'")).toPandas().dropna()
    intercept, *weights = made.models[made.best - 1]
    assert np.allclose(scored["scaled_yhat"], scored[list("abcd")].to_numpy() @ weights + intercept)
    assert ((scored["scaled_yhat"] - scored["label"])**2).mean() == pytest.approx(made.history["val_loss"][made.best - 1])


def test_search_records_every_trial(rows):
    sums, points = rounds.moments(rows, list("abcd")), rounds.search_points(6)
    found = rounds.search(rows, sums, points)
    assert [t["trial"] for t in found] == list(range(6)) and len(set(points)) == 6 and points == rounds.search_points(6)
    for t, p in zip(found, points):
        made = rounds.train(sums, p)
        assert (t["rounds"], t["best_round"]) == (len(made.models), made.best) and t["rounds"] <= 25
        assert t["val_mae"] == pytest.approx(rounds.absolute_errors(rows.where("split = 'val'"), made.models[made.best - 1:made.best], list("abcd"))[0])
    with pytest.raises(ValueError, match="160 points"):
        rounds.search_points(161)


def test_without_validation_or_training_rows(rows):
    alone = rounds.train(rounds.moments(rows.where("split = 'train'"), list("abcd")))
    assert alone.history["loss"] == alone.history["val_loss"]
    with pytest.raises(WindowError):
        rounds.train(rounds.moments(rows.where("split = 'val'"), list("abcd")))


def test_training_job_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tidewatt import session

    table = features.load_features(series(spark, noisy(1700)), gapless=True).persist()
    table.count()
    root = Path(session.scratch_root(spark))
    before = sorted(root.iterdir())
    made = training.training_job(table, f"{tmp_path}/job", trials=4, origin_stride=6, gapless=True)
    assert sorted(root.iterdir()) == before
    history = pdf(made["history"], "metric", "epoch")
    assert set(history["metric"]) == {"loss", "val_loss", "val_mae", "learning_rate"}
    assert (history.groupby("metric")["epoch"].max() == made["epochs_trained"]).all()
    assert history[history["metric"] == "val_loss"]["value"].min() == pytest.approx(made["best_val_loss"])
    logged = {r["key"] for r in made["runs"].collect()}
    assert {"best_val_loss", "epochs_trained", "test_mae", "learning_rate", "momentum"} <= logged
    assert artefacts.read_record(spark, f"{tmp_path}/job/trials", training.TRIALS_SCHEMA).count() == 4
    day = forecast.run_forecast(prepare.chrono_split(table), made["model"])
    assert day.count() == 24 and {r["split"] for r in made["metrics"].collect()} == {"val", "test"}
    # what is cut afterwards goes to the usual place again
    assert session.cut(spark.range(3)).count() == 3
    with pytest.raises(ZeroDivisionError), session.owned_scratch(spark):
        session.stage(spark.range(3))
        raise ZeroDivisionError
    assert len(sorted(root.iterdir())) <= len(before) + 1
