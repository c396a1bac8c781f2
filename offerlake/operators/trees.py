"""Exact contributions of tree ensembles.

``tree_contributions`` gives the interventional Shapley values of an MLlib decision tree, forest
or boosted ensemble against a background sample: no coalition is scored and no ordering drawn.
A leaf is reached by a mix of a row and a background row if every feature on its path comes
from one of them that satisfies the path's splits on it. With ``a`` features that only the row
satisfies and ``b`` that only the background row does, the leaf's value counts (a - 1)! b! / (a + b)!
for each of the first and - a! (b - 1)! / (a + b)! for each of the second. A background row matters by
the set of path features that it satisfies, so the background is summed up per leaf once;
the work per row grows with the leaves, not with the background.

The node tables come from the model as MLlib saves it. They are the fitted state, bounded by
trees x nodes, and are broadcast with the background's summary; rows are scored in numpy on Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.session import scratch_root


class Leaf(NamedTuple):
    """A leaf: its value and, per feature of its path, the splits as (threshold or categories, goes left)."""

    value: float
    features: tuple[int, ...]
    splits: tuple[tuple[tuple[object, bool], ...], ...]

    def satisfied(self, x: np.ndarray) -> np.ndarray:
        """Rows x features of the path: whether the row's value passes all splits on the feature."""
        out = np.ones((len(x), len(self.features)), bool)
        for j, (f, splits) in enumerate(zip(self.features, self.splits, strict=True)):
            for rule, left in splits:
                goes = np.isin(x[:, f], rule) if isinstance(rule, tuple) else x[:, f] <= rule
                out[:, j] &= goes == left
        return out


def node_table(model, spark) -> DataFrame:
    """The nodes of a tree model, as MLlib saves them: tree, id, left, right (-1 for leaves), prediction, split."""
    path = f"{scratch_root(spark)}/trees/{uuid.uuid4().hex}"
    model.save(path)
    data = spark.read.parquet(f"{path}/data")
    node = data.select(F.col("treeID").alias("tree"), "nodeData.*") if "nodeData" in data.columns else data.select(
        F.lit(0).alias("tree"), "*")
    return node.select("tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction",
                       "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories")


def leaves(model, spark) -> list[Leaf]:
    """All leaves with their paths, values times the tree's weight (a forest's trees count one n-th each)."""
    weights = list(getattr(model, "treeWeights", [1.0]))
    if type(model).__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    nodes = {(r["tree"], r["id"]): r for r in node_table(model, spark).collect()}  # bounded by the model
    out = []

    def walk(tree: int, at: int, path: dict[int, list]) -> None:
        r = nodes[tree, at]
        if r["left"] < 0:
            features = tuple(sorted(path))
            out.append(Leaf(r["prediction"] * weights[tree], features, tuple(tuple(path[f]) for f in features)))
            return
        f, values = r["featureIndex"], r["leftCategoriesOrThreshold"]
        rule = values[0] if r["numCategories"] == -1 else tuple(values)
        for child, left in ((r["left"], True), (r["right"], False)):
            walk(tree, child, {**path, f: [*path.get(f, []), (rule, left)]})

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, {})
    return out


def _weights(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a - 1)! b! / (a + b)! and a! (b - 1)! / (a + b)! for all pairs; 0 where the factorial has no meaning."""
    gain = [[factorial(i - 1) * factorial(j) / factorial(i + j) if i else 0.0 for i in a] for j in b]
    loss = [[factorial(i) * factorial(j - 1) / factorial(i + j) if j else 0.0 for i in a] for j in b]
    return np.array(gain).reshape(len(b), len(a)), np.array(loss).reshape(len(b), len(a))


class TreeExplainer:
    """Contributions of dense rows; ``background`` (rows x slots) is summed up per leaf."""

    def __init__(self, found: list[Leaf], background: np.ndarray):
        self.found, self.slots, self.seen = found, background.shape[1], []
        for leaf in found:
            kinds, counts = np.unique(leaf.satisfied(background), axis=0, return_counts=True)
            self.seen.append((kinds, counts / len(background)))

    def explain(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.slots))
        for leaf, (kinds, share) in zip(self.found, self.seen, strict=True):
            if not leaf.features:
                continue
            own, which = np.unique(leaf.satisfied(x), axis=0, return_inverse=True)
            reached = (own[:, None, :] | kinds[None, :, :]).all(axis=2) * share
            gain, loss = _weights((~kinds).sum(axis=1), (~own).sum(axis=1))
            part = (reached * gain) @ (~kinds) - (reached * loss).sum(axis=1, keepdims=True) * ~own
            out[:, leaf.features] += leaf.value * part[which.reshape(-1)]
        return out


def slots(prepared: DataFrame, numeric: list[str], categorical: list[str], column: str = "features") -> list[tuple[str, str]]:
    """(name, source) of every slot of the assembled vector, from its ML attributes: a numeric column is a slot of its
    own name, a one-hot slot is ``column_value``."""
    attrs = prepared.schema[column].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    out = []
    for i in range(len(names)):
        name = names[i]
        source = next((c for c in numeric if name == f"{c}_scaled"), None)
        if source is None:
            source = max((c for c in categorical if name.startswith(f"{c}_ohe_")), key=len)
            out.append((f"{source}_{name[len(source) + 5:]}", source))
        else:
            out.append((source, source))
    return out


def tree_contributions(model, rows: DataFrame, background: DataFrame, id_col: str, names: list[str],
                       column: str = "features") -> DataFrame:
    """``id_col``, feature, contribution for every slot that moves a row's prediction: exact interventional Shapley
    values against ``background``, which must be small (the reference took 100 rows). Their sum is the
    prediction minus the background's mean prediction."""
    spark = rows.sparkSession
    held = background.select(vector_to_array(column).alias("x")).toArrow()  # the bounded background sample
    explainer = TreeExplainer(leaves(model, spark), np.stack(held.column(0).to_numpy()))
    shared = spark.sparkContext.broadcast((explainer, names))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = own.explain(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
            row, slot = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(labels).take(pa.array(slot)), pa.array(found[row, slot])],
                names=[id_col, "feature", "contribution"])

    kind = rows.schema[id_col].dataType.simpleString()
    dense = rows.select(id_col, vector_to_array(column).alias("x"))
    return dense.mapInArrow(explain, f"`{id_col}` {kind}, feature string, contribution double")


def linear_slot_contributions(model, rows: DataFrame, background: DataFrame, id_col: str, names: list[str],
                              column: str = "features") -> DataFrame:
    """The same for a linear model: coefficient times the slot's distance from its mean over ``background``."""
    mean = background.select(F.posexplode(vector_to_array(column)).alias("slot", "x")).groupBy("slot").agg(F.avg("x").alias("m"))
    means = dict(mean.collect())  # a number per slot
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), (
        (F.col("_x")[i] - F.lit(float(means[i]))) * F.lit(float(c))).alias("contribution"))
        for i, (n, c) in enumerate(zip(names, model.coefficients.toArray(), strict=True))])
    return rows.select(id_col, vector_to_array(column).alias("_x")).select(id_col, F.explode(parts).alias("c")).select(id_col, "c.*")
