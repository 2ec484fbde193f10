"""Gradient-boosted quantile regression.

Spark's boosted trees know squared and absolute loss only. Here each round grows one tree per
quantile on the pinball gradient from histograms (``histograms``), takes the quantile of the
residuals in each leaf, and adds it, shrunk, to the prediction. Histograms, leaf quantiles and
validation loss are Spark jobs over all quantiles together; the driver holds the nodes of the
trees and the loss history.

A fitted tree is kept as rows of a node table: all trees of a version are one small stored
table, loading reads it once, and prediction walks all trees in one vectorised function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from liftspark import config as C
from liftspark.operators import histograms as H
from liftspark.operators.features import require
from liftspark.session import scratch_path
from liftspark.sources import stored, tables

_VECTOR = "_features"
SKETCH_ACCURACY = H.SKETCH_ACCURACY
MAX_NODES = 2_000_000  # of all trees; bounds what is broadcast
NODES = (
    "q string, alpha double, start double, tree int, node int, feature int, threshold double,"
    " low int, high int, value double"
)


@dataclass
class Tree:
    """Nodes in pre-order: inner ones test ``feature <= threshold``, leaves have a value."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    value: list[float]

    def depth(self) -> int:
        deep = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                deep[self.low[i]] = deep[self.high[i]] = deep[i] + 1
        return max(deep)


@dataclass
class QuantileModel:
    """A start value and trees whose leaves hold shrunken values."""

    alpha: float
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def cut(self, rounds: int) -> QuantileModel:
        return QuantileModel(self.alpha, self.start, self.trees[:rounds], self.losses[: rounds + 1])


def tree_of(binned: H.BinnedTree, cuts: list[np.ndarray]) -> Tree:
    """A tree over bins as one over the features themselves, its nodes in pre-order."""
    tree = Tree([], [], [], [], [])

    def build(node: int) -> int:
        at, feature = len(tree.feature), binned.feature[node]
        threshold = float(cuts[feature][binned.bin[node]]) if feature >= 0 else 0.0
        for column, value in zip(
            (tree.feature, tree.threshold, tree.low, tree.high, tree.value),
            (feature, threshold, at, at, 0.0 if feature >= 0 else binned.value[node]),
        ):
            column.append(value)
        if feature >= 0:
            tree.low[at] = build(binned.low[node])
            tree.high[at] = build(binned.high[node])
        return at

    build(0)
    return tree


def split(
    df: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = "video_id"
) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the key: the same on every run, under any
    partitioning and in any engine."""
    digits = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), 1, 8)
    share = F.conv(digits, 16, 10).cast("long") / (1 << 32)
    return df.filter(share < ratio), df.filter(~F.coalesce(share < ratio, F.lit(False)))


def assemble(df: DataFrame, features=C.FEATURE_COLUMNS) -> DataFrame:
    """Add the feature vector."""
    require(df, features, "assemble")
    assembler = VectorAssembler(inputCols=list(features), outputCol=_VECTOR)
    return assembler.transform(df)


def shrunken(value: float, n: int, params: C.BoostConfig) -> float:
    """Leaf value after L1 and L2, which weigh less the more rows a leaf has."""
    size = max(abs(value) * n - params.l1, 0.0) / (n + params.l2)
    return params.learning_rate * math.copysign(size, value)


def columns_of(round_: int, n: int, params: C.BoostConfig) -> list[int]:
    """Features the tree of a round may use."""
    count = max(1, math.ceil(params.column_share * n))
    return sorted(np.random.default_rng([params.seed, round_]).choice(n, count, replace=False).tolist())


def fit_models(
    train: DataFrame, valid: DataFrame, quantiles: dict[str, float], params: C.BoostConfig
) -> dict[str, QuantileModel]:
    """Fit all quantiles together, each until its validation loss stops improving.

    A round takes one job for each level of the trees, one for the leaf values and one for the
    losses, whatever the number of quantiles. Between writes, tasks add the trees of the last
    rounds to the written predictions.
    """
    alphas, spark = list(quantiles.values()), train.sparkSession
    starts = train.agg(F.percentile_approx(C.LABEL, F.lit(alphas), H.SKETCH_ACCURACY)).first()[0]
    if starts is None:
        raise ValueError("no labelled training rows")
    models = [QuantileModel(alpha, float(start)) for alpha, start in zip(alphas, starts)]
    cuts = H.cuts_of(train, params.features)
    homes = {n: [scratch_path(spark, n), scratch_path(spark, n)] for n in ("train", "valid")}

    def cut(name: str, df: DataFrame) -> DataFrame:
        """Write the rows with their predictions so far, and go on from the files.

        Two folders take turns: one is read while the other is replaced.
        """
        homes[name].reverse()
        tables.overwrite(df, homes[name][0])
        return spark.read.schema(H.ROWS).parquet(homes[name][0])

    sets = {n: cut(n, H.binned(df, params.features, cuts, list(starts))) for n, df in (("train", train), ("valid", valid))}
    pending: list[list[H.BinnedTree]] = [[] for _ in alphas]
    for model, loss in zip(models, H.losses(sets["valid"], pending, alphas)):
        model.losses.append(loss)
    best, active = [0] * len(alphas), list(range(len(alphas)))
    for i in range(params.rounds):
        bag_seed = params.seed + i // params.subsample_rounds
        draw = F.pmod(F.xxhash64("video_id", F.lit(bag_seed)), F.lit(1000)) / 1000
        bag = sets["train"].filter(draw < params.subsample)
        columns = columns_of(i, len(params.features), params)
        trees = H.grow(bag, pending, alphas, active, columns, params.max_depth, params.min_rows_per_leaf)
        # At most 2^max_depth leaves a quantile.
        for q, node, value, n in H.leaf_quantiles(bag, pending, trees, alphas).collect():
            trees[q].value[node] = shrunken(float(value), n, params)
        for q, tree in trees.items():
            pending[q].append(tree)
            models[q].trees.append(tree_of(tree, cuts))
        found = H.losses(sets["valid"], pending, alphas)
        for q in list(active):
            models[q].losses.append(found[q])
            if found[q] < models[q].losses[best[q]]:
                best[q] = i + 1
            elif i + 1 - best[q] >= params.patience:
                active.remove(q)
        if not active:
            break
        if (i + 1) % params.cut_every == 0:
            sets = {name: cut(name, H.with_trees(df, pending)) for name, df in sets.items()}
            pending = [[] for _ in alphas]
    for paths in homes.values():
        for path in paths:
            tables.remove(spark, path)
    return {name: model.cut(n) for name, model, n in zip(quantiles, models, best)}


def fit_quantile_gbt(train: DataFrame, valid: DataFrame, alpha: float, params: C.BoostConfig) -> QuantileModel:
    """Fit one quantile."""
    return fit_models(train, valid, {"q": alpha}, params)["q"]


def fit(df: DataFrame, params: C.BoostConfig = C.BoostConfig()) -> dict[str, QuantileModel]:
    """Fit the three quantiles on the labelled rows."""
    require(df, [*params.features, C.LABEL, "video_id"], "fit")
    train, valid = split(df.filter(F.col(C.LABEL).isNotNull()), params.train_ratio, params.seed)
    return fit_models(train, valid, C.QUANTILES, params)


class Forest:
    """All trees of the three quantiles as flat arrays."""

    def __init__(self, models: dict[str, QuantileModel]):
        trees = [(number, t) for number, m in enumerate(models.values()) for t in m.trees]
        sizes = [len(t.feature) for _, t in trees]
        if sum(sizes) > MAX_NODES:
            raise ValueError(f"{sum(sizes)} nodes exceed {MAX_NODES}")
        self.roots = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if trees else []
        self.quantile = [number for number, _ in trees]
        self.depths = [t.depth() for _, t in trees]
        self.starts = [m.start for m in models.values()]

        def flat(name: str, kind) -> np.ndarray:
            return np.array([x for _, t in trees for x in getattr(t, name)], kind)

        base = np.repeat(self.roots, sizes) if trees else np.zeros(0, np.int64)
        self.feature = np.maximum(flat("feature", np.int64), 0)
        self.threshold = flat("threshold", np.float64)
        self.low, self.high = flat("low", np.int64) + base, flat("high", np.int64) + base
        self.value = flat("value", np.float64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Raw predictions (rows, quantiles), added up in the order of the trees."""
        out = np.tile(np.array(self.starts), (len(x), 1))
        rows = np.arange(len(x))
        for root, number, depth in zip(self.roots, self.quantile, self.depths):
            at = np.full(len(x), root)
            for _ in range(depth):
                goes_low = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_low, self.low[at], self.high[at])
            out[:, number] += self.value[at]
        return out


def predict(
    df: DataFrame, models: dict[str, QuantileModel], features=C.FEATURE_COLUMNS
) -> DataFrame:
    """Add the three lifts; per row they are put in ascending order, and not below zero."""
    require(df, features, "predict")
    columns = [c for c in df.columns if c not in C.LIFT_COLUMNS]
    kind = StructType()
    for name in C.LIFT_COLUMNS:
        kind = kind.add(name, DoubleType())
    shared = df.sparkSession.sparkContext.broadcast(Forest(models))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = shared.value.predict(batch.to_numpy(np.float64))
            yield pd.DataFrame(np.maximum(np.sort(raw, axis=1), 0.0), columns=list(C.LIFT_COLUMNS))

    inputs = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    scored = df.select(*columns, F.pandas_udf(score, kind)(inputs).alias("_lifts"))
    return scored.select(*columns, *[F.col(f"_lifts.{c}").alias(c) for c in C.LIFT_COLUMNS])


def _rows(models: dict[str, QuantileModel]) -> list[tuple]:
    rows = []
    for q, model in models.items():
        rows.append((q, model.alpha, model.start, -1, 0, None, None, None, None, None))
        for i, t in enumerate(model.trees):
            nodes = zip(t.feature, t.threshold, t.low, t.high, t.value)
            rows += [(q, model.alpha, model.start, i, n, *node) for n, node in enumerate(nodes)]
    return rows


def from_nodes(rows: DataFrame) -> dict[str, QuantileModel]:
    """Models from a node table, at most ``MAX_NODES`` rows of it."""
    found = rows.orderBy("q", "tree", "node").limit(MAX_NODES + 1).toPandas()
    if len(found) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    models: dict[str, QuantileModel] = {}
    for (q, number), nodes in found.groupby(["q", "tree"], sort=True):
        first = nodes.iloc[0]
        model = models.setdefault(q, QuantileModel(float(first.alpha), float(first.start)))
        if number >= 0:
            ints = (nodes[c].astype(int).tolist() for c in ("feature", "low", "high"))
            feature, low, high = ints
            model.trees.append(Tree(feature, nodes.threshold.tolist(), low, high, nodes.value.tolist()))
    return {q: models[q] for q in C.QUANTILES if q in models}


def save_models(spark: SparkSession, models: dict[str, QuantileModel], path: str) -> str:
    """Publish the trees as a new version of the node table; returns its number.

    Scorers go on with the version before until the new one is complete.
    """
    number = stored.next_number(spark, path)
    nodes = spark.createDataFrame(_rows(models), NODES).coalesce(1)
    stored.publish(spark, path, nodes, number=number)
    return number


def load_models(spark: SparkSession, path: str) -> dict[str, QuantileModel]:
    """The live version written by ``save_models``."""
    return from_nodes(stored.read(spark, path, spark.createDataFrame([], NODES).schema))
