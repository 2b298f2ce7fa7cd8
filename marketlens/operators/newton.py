"""Second-order boosted trees over binned features.

Each feature is cut into bins at approximate quantiles once, and rows are kept as blocks: a matrix
of one byte a feature, labels and margins. A tree grows level by level: one pass over the blocks sums
the loss's first and second derivatives per node, feature and bin, a table a task, and the tables are
added up as a tree; the driver, which gets their sum, picks for each node the cut with the largest
gain. A leaf's weight is Newton's step -G / (H + l2). Rows carry the margin of the trees up to the
last checkpoint; later trees are added where they are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.rdd import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import checkpoint_dir

BINS = 32
BLOCK = 65_536  # rows with which a block ends
TABLES = 64  # of sums that the driver takes at once
KEEP_EVERY = 8  # trees after which the rows are written again with their margins


def descend(x: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Sum of the trees' leaf weights for each row of ``x``; to the left where x <= cut."""
    out = np.zeros(len(x))
    for tree in trees:
        feature, cut = np.array(tree["feature"]), np.array(tree["cut"], float)
        value, node = np.array(tree["value"], float), np.zeros(len(x), np.int64)
        while True:
            on = np.flatnonzero(feature[node] >= 0)
            if not len(on):
                break
            at = node[on]
            node[on] = 2 * at + 1 + (x[on, feature[at]] > cut[at])
        out += value[node]
    return out


def derivatives(label: np.ndarray, margin: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return margin - label, np.ones(len(label))
    p = 1 / (1 + np.exp(-margin))
    return p - label, p * (1 - p)


def best_cuts(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> list[tuple | None]:
    """For each node of (node, feature, bin) sums: gain, feature, bin, and the sums of both sides."""
    left_g, left_h = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    all_g, all_h = g.sum(2)[:, :1, None], h.sum(2)[:, :1, None]
    right_g, right_h = all_g - left_g, all_h - left_h

    def score(a, b):
        return a * a / (b + l2)

    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    out: list[tuple | None] = []
    for k, own in enumerate(gain):
        top = own.max(initial=-np.inf)
        if not top > 1e-9:
            out.append(None)
            continue
        # sums of doubles differ in their last digits from run to run; ties go to the first cut
        f, b = np.unravel_index(int(np.argmax(own >= top * (1 - 1e-9))), own.shape)
        out.append((float(own[f, b]), int(f), int(b), float(left_g[k, f, b]), float(left_h[k, f, b]),
                    float(right_g[k, f, b]), float(right_h[k, f, b])))
    return out


class NewtonTrees:
    """Fits ``rounds`` trees of ``depth`` levels; ``logistic`` for labels 0 and 1, else squares."""

    def __init__(self, logistic: bool, rounds: int = 30, depth: int = 4, rate: float = 0.3,
                 l2: float = 1.0, least: float = 1.0, bins: int = BINS) -> None:
        if not 2 <= bins <= 256:
            raise ValueError("bins must lie between 2 and 256")
        self.logistic, self.rounds, self.depth = logistic, rounds, depth
        self.rate, self.l2, self.least, self.bins = rate, l2, least, bins

    def edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Upper ends of the bins but the last, per feature: distinct approximate quantiles."""
        shares = [k / self.bins for k in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[k], shares, 2000).alias(f"q{k}")
                           for k in range(width)]).first()
        return [np.unique(np.array(found[f"q{k}"] or [], float)) for k in range(width)]

    def fit(self, rows: DataFrame) -> NewtonModel:
        """``rows`` has ``label`` and the vector ``features``."""
        rows = rows.select(F.col("label").cast("double").alias("label"),
                           vector_to_array("features").alias("x"))
        facts = rows.agg(F.avg("label").alias("mean"), F.max(F.size("x")).alias("width")).first()
        width, mean = facts["width"] or 0, facts["mean"] or 0.0
        if self.logistic:
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            start = float(np.log(mean / (1 - mean)))
        else:
            start = float(mean)
        edges = self.edges(rows, width) if width else []
        checkpoint_dir(rows.sparkSession)
        binned = rows.mapInArrow(_binning(edges), "label binary, x binary").checkpoint()
        blocks = binned.rdd.map(_block(width, start)).cache()
        # tables of few tasks are added up by the driver, those of many by tasks first
        depth = 1 if blocks.getNumPartitions() <= TABLES else 2
        done, trees, gains = [], [], np.zeros(max(width, 1))
        while len(done) + len(trees) < self.rounds and width:
            tree = self._grow(blocks, trees, width, gains, depth)
            if tree is None:
                break
            trees.append(tree)
            if len(trees) == KEEP_EVERY and len(done) + len(trees) < self.rounds:
                before, blocks = blocks, blocks.map(_adding(trees)).cache()
                blocks.checkpoint()
                blocks.count()
                before.unpersist()
                done, trees = done + trees, []
        blocks.unpersist()
        return NewtonModel.of(self.logistic, start, [_real(t, edges) for t in done + trees],
                              gains / max(gains.sum(), 1e-300))

    def _grow(self, blocks: RDD, trees: list[dict], width: int, gains: np.ndarray,
              depth: int) -> dict | None:
        size = 2 ** (self.depth + 1) - 1
        tree = {"feature": [-1] * size, "cut": [0.0] * size, "value": [0.0] * size}
        open_ = [0]
        for _ in range(self.depth):
            # at most nodes x features x bins
            g, h = blocks.mapPartitions(_histograms(
                trees, tree, open_, width, self.bins, self.logistic)).treeReduce(np.add, depth)
            below = []
            for node, cut in zip(open_, best_cuts(g, h, self.l2, self.least), strict=True):
                if cut is None:
                    continue
                gain, f, b, left_g, left_h, right_g, right_h = cut
                gains[f] += gain
                tree["feature"][node], tree["cut"][node] = f, float(b)
                for child, cg, ch in ((2 * node + 1, left_g, left_h), (2 * node + 2, right_g, right_h)):
                    tree["value"][child] = -self.rate * cg / (ch + self.l2)
                    below.append(child)
            open_ = below
            if not open_:
                break
        return tree if tree["feature"][0] >= 0 else None


def _real(tree: dict, edges: list[np.ndarray]) -> dict:
    """The tree with its cuts in the features' units."""
    cuts = [float(edges[f][int(c)]) if f >= 0 else 0.0
            for f, c in zip(tree["feature"], tree["cut"], strict=True)]
    return {**tree, "cut": cuts}


def _binning(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            label, bins = (np.concatenate(parts) for parts in zip(*held, strict=True))
            return pa.record_batch({"label": pa.array([label.tobytes()], pa.binary()),
                                    "x": pa.array([bins.tobytes()], pa.binary())})

        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column("x").flatten()).reshape(len(batch), -1)
            bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
            held.append((np.array(batch.column("label"), float), bins.astype(np.uint8)))
            size += len(batch)
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return run


def _block(width: int, start: float):
    """Labels, margins and bins of a block."""
    def run(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = np.frombuffer(row["label"], float)
        return (label, np.full(len(label), start),
                np.frombuffer(row["x"], np.uint8).reshape(len(label), width))

    return run


def _adding(trees: list[dict]):
    return lambda block: (block[0], block[1] + descend(block[2], trees), block[2])


def _histograms(trees: list[dict], tree: dict, open_: list[int], width: int, bins: int, logistic: bool):
    """Sums per cell (node, feature, bin) of a task's rows."""
    def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        place = np.full(len(tree["feature"]), -1)
        place[open_] = np.arange(len(open_))
        feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
        total = np.zeros((2, len(open_), width, bins))
        for label, margin, x in blocks:
            g, h = derivatives(label, margin + descend(x, trees), logistic)
            node = np.zeros(len(x), np.int64)
            while len(on := np.flatnonzero(feature[node] >= 0)):
                at = node[on]
                node[on] = 2 * at + 1 + (x[on, feature[at]] > cut[at])
            at = place[node]
            kept = at >= 0
            at, x, g, h = at[kept] * bins, x[kept], g[kept], h[kept]
            for f in range(width):
                cell = at + x[:, f]
                for k, weight in enumerate((g, h)):
                    total[k, :, f] += np.bincount(cell, weight, len(open_) * bins).reshape(-1, bins)
        yield total

    return run


class NewtonModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Trees as one parameter, so the model is saved and loaded within any pipeline."""

    body = Param(Params._dummy(), "body", "objective, start, trees and gains as JSON",
                 TypeConverters.toString)

    @classmethod
    def of(cls, logistic: bool, start: float, trees: list[dict], gains: np.ndarray) -> NewtonModel:
        model = cls()
        model._set(body=json.dumps({"logistic": logistic, "start": start, "trees": trees,
                                    "gains": [float(v) for v in gains]}))
        return model

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.body))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name of the other tree models
        return Vectors.dense(self.content["gains"])

    def _transform(self, rows: DataFrame) -> DataFrame:
        content = self.content
        trees, start = content["trees"], content["start"]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(start + descend(np.stack(x.to_numpy()), trees) if len(x) else np.zeros(0))

        out = rows.withColumn("_margin", margin(vector_to_array("features")))
        m = F.col("_margin")
        if not content["logistic"]:
            return out.withColumn("prediction", m).drop("_margin")
        p = 1 / (1 + F.exp(-m))
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (m > 0).cast("double")}).drop("_margin")
