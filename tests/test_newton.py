"""Second-order boosted trees against a plain version, and as a stage of a pipeline."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from marketlens.operators import newton
from marketlens.operators.newton import NewtonTrees


def data(n=600, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 5)), 2)
    x[:, 3] = r.integers(0, 3, n)
    x[:, 4] = 1.0  # no spread
    signal = x[:, 0] * 2 - (x[:, 1] > 0.3) * (x[:, 3] == 1) * 3
    return x, signal, (signal + r.normal(size=n) * 0.5 > 0).astype(float)


def frame(spark, x, y):
    return spark.createDataFrame(
        [(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"])


def plain(x, y, edges, logistic, rounds, depth, rate, l2, least):
    """Margins after boosting by exact loops over all cuts of all nodes."""
    start = np.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    margin = np.full(len(y), start)
    for _ in range(rounds):
        g, h = newton.derivatives(y, margin, logistic)
        step = np.zeros(len(y))
        nodes = [np.arange(len(y))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-9, None)
                for f, cuts in enumerate(edges):
                    for cut in cuts:
                        left = x[rows, f] <= cut
                        a, b = rows[left], rows[~left]
                        if h[a].sum() < least or h[b].sum() < least:
                            continue
                        gain = (g[a].sum() ** 2 / (h[a].sum() + l2) + g[b].sum() ** 2 / (h[b].sum() + l2)
                                - g[rows].sum() ** 2 / (h[rows].sum() + l2))
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (a, b))
                if best[1] is not None:
                    for part in best[1]:
                        step[part] = -rate * g[part].sum() / (h[part].sum() + l2)
                        below.append(part)
            nodes = below
        margin = margin + step
    return margin


@pytest.mark.parametrize("logistic", [True, False])
def test_against_plain_version(spark, logistic, monkeypatch):
    monkeypatch.setattr(newton, "KEEP_EVERY", 2)
    x, signal, y = data()
    y = y if logistic else signal
    rows = frame(spark, x, y).repartition(3)
    trees = NewtonTrees(logistic, rounds=5, depth=3, bins=16)
    model = trees.fit(rows)
    edges = trees.edges(rows.select(vector_to_array("features").alias("x")), 5)
    told = plain(x, y, edges, logistic, 5, 3, trees.rate, trees.l2, trees.least)
    got = {tuple(r["features"]): r for r in model.transform(rows).collect()}
    if logistic:
        assert [got[tuple(a)]["rawPrediction"][1] for a in x] == pytest.approx(list(told), abs=1e-9)
        assert [got[tuple(a)]["probability"][1] for a in x] == pytest.approx(list(1 / (1 + np.exp(-told))))
    else:
        assert [got[tuple(a)]["prediction"] for a in x] == pytest.approx(list(told), abs=1e-9)
    gains = model.featureImportances.toArray()
    assert gains.sum() == pytest.approx(1) and gains.argmax() == 0 and gains[4] == 0


def test_learns_and_is_saved(spark, tmp_path):
    x, _, y = data(800)
    rows = frame(spark, x, y)
    model = PipelineModel([NewtonTrees(True, rounds=12).fit(rows)])
    assert BinaryClassificationEvaluator().evaluate(model.transform(rows)) > 0.97
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    first, second = (sorted(r["probability"][1] for r in m.transform(rows).collect()) for m in (model, again))
    assert first == second


def test_one_label_and_no_spread(spark):
    rows = frame(spark, np.ones((6, 2)), np.ones(6))
    got = NewtonTrees(True, rounds=3).fit(rows).transform(rows).collect()
    assert all(r["probability"][1] > 0.999 for r in got)


def test_rows_are_few_blocks_and_many_tasks_add_up_alike(spark, monkeypatch):
    """A pass costs by the block, not by the row, and sums agree whoever adds them up."""
    x, _, y = data(500)
    rows = frame(spark, x, y).repartition(6)
    found = spark.createDataFrame(
        [(1.0, [float(v) for v in a]) for a in x], "label double, x array<double>").coalesce(1).mapInArrow(
        newton._binning([np.array([0.0])] * 5), "label binary, x binary").collect()
    assert len(found) == 1 and len(found[0]["x"]) == x.size
    few = NewtonTrees(True, rounds=3).fit(rows).content
    monkeypatch.setattr(newton, "TABLES", 1)
    many = NewtonTrees(True, rounds=3).fit(rows).content
    assert [t["feature"] for t in many["trees"]] == [t["feature"] for t in few["trees"]]
    assert [v for t in many["trees"] for v in t["value"]] == pytest.approx(
        [v for t in few["trees"] for v in t["value"]])
