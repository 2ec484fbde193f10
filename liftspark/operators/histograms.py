"""Trees grown from histograms of gradients, for several quantiles at once.

Features are cut into bins once. The pinball gradient of a row is one of two values, so a bin's
gradient sum follows from two counts: rows, and rows whose label lies above the prediction. A
level of the trees of all quantiles is one job: every task counts its rows by (quantile, node,
feature, bin) in an array of known size, Spark adds the counts up, and a window over the bins
picks the best split of each node; only the splits come to the driver. Counts are whole numbers,
so a fit does not depend on the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftspark import config as C

BINS = 64
SKETCH_ACCURACY = 100_000
LOSS_UNIT = 1_000_000
ROWS = "video_id string, bins array<tinyint>, label double, preds array<double>"
_COUNTS = "q int, node int, feature int, bin int, n bigint, above bigint"
_RESIDUALS = "q int, node int, residual double"


@dataclass
class BinnedTree:
    """Nodes in the order they were made; inner ones send bins up to ``bin`` low."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    low: list[int] = field(default_factory=lambda: [0])
    high: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, bin: int) -> list[int]:
        """Make a leaf an inner node; returns its two leaves."""
        made = [len(self.feature), len(self.feature) + 1]
        for new in made:
            for column, start in ((self.feature, -1), (self.bin, 0), (self.low, new), (self.high, new), (self.value, 0.0)):
                column.append(start)
        self.feature[node], self.bin[node], (self.low[node], self.high[node]) = feature, bin, made
        return made

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        feature, cut = np.maximum(self.feature, 0), np.array(self.bin)
        low, high = np.array(self.low), np.array(self.high)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            at = np.where(bins[rows, feature[at]] <= cut[at], low[at], high[at])
        return at


def cuts_of(df: DataFrame, features, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: its distinct quantiles but the highest, in one pass."""
    shares = F.lit([(i + 1) / bins for i in range(bins)])
    ends = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, SKETCH_ACCURACY).alias(c) for c in features]).first()
    return [np.unique(np.array(e if e is not None else [0.0], np.float64))[:-1] for e in ends]


def binned(df: DataFrame, features, cuts: list[np.ndarray], starts: list[float]) -> DataFrame:
    """Rows of ``ROWS``: bin of each feature, label and first predictions. Unknown values lie in the last bin."""
    n = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(n)]
            bins = np.array([np.searchsorted(c, x) for c, x in zip(cuts, columns)], np.int8).T
            yield _rows(batch.column(0), bins, batch.column(1), np.tile(starts, (batch.num_rows, 1)))

    values = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    return df.select(F.col("video_id").cast("string"), F.col(C.LABEL).cast("double").alias("label"), *values).mapInArrow(run, ROWS)


def _rows(ids, bins: np.ndarray, labels, preds: np.ndarray) -> pa.RecordBatch:
    def nested(values: np.ndarray, kind) -> pa.Array:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))

    arrays = [ids, nested(bins, pa.int8()), labels, nested(preds, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names=["video_id", "bins", "label", "preds"])


def _arrays(batch: pa.RecordBatch, pending: list[list[BinnedTree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and present predictions of a batch: what is written plus the trees since."""
    n = batch.num_rows
    bins = batch.column("bins").flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), np.int8)
    preds = batch.column("preds").flatten().to_numpy().reshape(n, -1).copy() if n else np.zeros((0, len(pending)))
    for q, trees in enumerate(pending):
        for tree in trees:
            preds[:, q] += np.array(tree.value)[tree.leaves_of(bins)]
    return bins, batch.column("label").to_numpy(zero_copy_only=False), preds


def with_trees(rows: DataFrame, pending: list[list[BinnedTree]]) -> DataFrame:
    """The rows with the trees' values added to the predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, preds = _arrays(batch, pending)
            if len(bins):
                yield _rows(batch.column("video_id"), bins, batch.column("label"), preds)

    return rows.mapInArrow(run, ROWS)


def counts(rows: DataFrame, pending, growing: dict[int, BinnedTree], open_nodes: dict[int, list[int]], columns: list[int]) -> DataFrame:
    """(q, node, feature, bin, n, above) of the open nodes, one array per task."""
    used = np.array(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = {q: (len(nodes), len(used), BINS) for q, nodes in open_nodes.items()}
        sums = {q: np.zeros((2, int(np.prod(s))), np.int64) for q, s in shape.items()}
        for batch in batches:
            bins, labels, preds = _arrays(batch, pending)
            for q, nodes in open_nodes.items():
                place = np.full(len(growing[q].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[growing[q].leaves_of(bins)] if len(bins) else np.zeros(0, np.int64)
                inside = at >= 0
                cell = (at[inside, None] * len(used) + np.arange(len(used))) * BINS + bins[inside][:, used]
                above = np.repeat(labels[inside] > preds[inside, q], len(used))
                size = sums[q].shape[1]
                sums[q][0] += np.bincount(cell.ravel(), minlength=size)
                sums[q][1] += np.bincount(cell.ravel()[above], minlength=size)
        for q, (n, above) in sums.items():
            cells = np.flatnonzero(n)
            node, feature, bin = np.unravel_index(cells, shape[q])
            values = [np.full(len(cells), q), np.array(open_nodes[q])[node], used[feature], bin]
            arrays = [pa.array(v.astype(np.int32)) for v in values] + [pa.array(n[cells]), pa.array(above[cells])]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "node", "feature", "bin", "n", "above"])

    found = rows.mapInArrow(run, _COUNTS).groupBy("q", "node", "feature", "bin")
    return found.agg(F.sum("n").alias("n"), F.sum("above").alias("above"))


def best_splits(found: DataFrame, alphas: list[float], min_rows: int) -> DataFrame:
    """(q, node, feature, bin) of the split that takes most off the squared gradients of each node.

    Of equal splits the first feature and the lowest bin count; a node that no split improves, or
    whose halves would be too small, has no row.
    """
    bins = Window.partitionBy("q", "node", "feature").orderBy("bin")
    upto, every = bins.rowsBetween(Window.unboundedPreceding, 0), bins.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alpha = F.get(F.array(*[F.lit(a) for a in alphas]), F.col("q"))

    def score(n, above):
        return F.pow(above * alpha - (n - above) * (1 - alpha), 2) / n

    n, above = F.sum("n"), F.sum("above")
    sides = found.select(
        "q", "node", "feature", "bin", n.over(upto).alias("n_low"), above.over(upto).alias("a_low"), n.over(every).alias("n"), above.over(every).alias("a")
    )
    n_high, a_high = F.col("n") - F.col("n_low"), F.col("a") - F.col("a_low")
    sides = sides.filter((F.col("n_low") >= max(min_rows, 1)) & (n_high >= max(min_rows, 1)))
    gain = score(F.col("n_low"), F.col("a_low")) + score(n_high, a_high) - score(F.col("n"), F.col("a"))
    order = Window.partitionBy("q", "node").orderBy(F.desc("gain"), "feature", "bin")
    ranked = sides.withColumn("gain", F.round(gain, 9)).filter("gain > 0").withColumn("rank", F.row_number().over(order))
    return ranked.filter("rank = 1").select("q", "node", "feature", "bin")


def grow(rows: DataFrame, pending, alphas: list[float], active: list[int], columns: list[int], depth: int, min_rows: int) -> dict[int, BinnedTree]:
    """A tree for each active quantile, level by level; leaf values are still zero."""
    growing = {q: BinnedTree() for q in active}
    open_nodes = {q: [0] for q in active}
    for _ in range(depth):
        found = counts(rows, pending, growing, open_nodes, columns)
        splits = best_splits(found, alphas, min_rows).collect()  # at most 2^level a quantile
        open_nodes = {}
        for q, node, feature, bin in sorted(tuple(s) for s in splits):
            open_nodes.setdefault(q, []).extend(growing[q].split(node, feature, bin))
        for q in open_nodes:
            growing[q].depth += 1
        if not open_nodes:
            break
    return growing


def leaf_quantiles(rows: DataFrame, pending, growing: dict[int, BinnedTree], alphas: list[float]) -> DataFrame:
    """(q, node, value, n): quantile of the residuals in each leaf, and its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, labels, preds = _arrays(batch, pending)
            for q, tree in growing.items():
                leaf = tree.leaves_of(bins).astype(np.int32)
                arrays = [pa.array(np.full(len(leaf), q, np.int32)), pa.array(leaf), pa.array(labels - preds[:, q])]
                yield pa.RecordBatch.from_arrays(arrays, names=["q", "node", "residual"])

    values = F.percentile_approx("residual", F.lit(list(alphas)), SKETCH_ACCURACY)
    found = rows.mapInArrow(run, _RESIDUALS).groupBy("q", "node").agg(values.alias("values"), F.count("*").alias("n"))
    return found.select("q", "node", F.get("values", F.col("q")).alias("value"), "n")


def losses(rows: DataFrame, pending, alphas: list[float]) -> list[float]:
    """Mean pinball loss of each quantile, added up in whole millionths; infinite without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(alphas), np.int64), 0
        for batch in batches:
            _, labels, preds = _arrays(batch, pending)
            gap = labels[:, None] - preds
            each = np.maximum(gap * alphas, gap * (np.array(alphas) - 1))
            sums += np.round(each * LOSS_UNIT).astype(np.int64).sum(axis=0)
            n += len(labels)
        arrays = [pa.array(np.arange(len(alphas), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(alphas), n))]
        yield pa.RecordBatch.from_arrays(arrays, names=["q", "total", "n"])

    found = rows.mapInArrow(run, "q int, total bigint, n bigint").groupBy("q").agg(F.sum("total"), F.sum("n"))
    out = [float("inf")] * len(alphas)
    for q, total, n in found.collect():
        out[q] = total / n / LOSS_UNIT if n else float("inf")
    return out
