"""Isolation forest (Liu, Ting and Zhou, 2008) grown and scored on Spark.

Each tree is grown from a small sample in a task of its own; samples, features and cuts are drawn from MD5
digests, which any engine can repeat. Scoring sends the trees to the executors and walks them with
numpy, one Arrow batch of rows at a time, or with array functions in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.config import ForestConfig
from riskline.functions import scalar as S
from riskline.operators.scaling import percentile, scaled
from riskline.session import materialize, ship

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, child int, path double"
)
EULER_GAMMA = 0.5772156649015329
# Rows that walk a tree together.
WALK_ROWS = 4096
ship(__name__)


def average_path(size: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``size`` items."""
    n = np.asarray(size, dtype=float)
    big = np.maximum(n, 3.0)
    steps = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, steps, np.where(n == 2, 1.0, 0.0))


def _clean(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as doubles; only a fraction can hold more than a null to replace."""
    fractions = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return [
        S.clean_numeric(c) if c in fractions else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in columns
    ]


def _share(*parts: Column) -> list[Column]:
    """Four numbers in [0, 1) from the MD5 digest of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for at in (1, 9, 17, 25)]


def drawn(*parts: object) -> float:
    """The first of those numbers, in a task."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def _entered(trees: int, share: float, seed: int) -> Column:
    """The trees for which a row competes, each with probability ``share``.

    The gaps between them are drawn, not every tree: about ``trees`` times ``share`` numbers, and as
    many more as chance may ask for.
    """
    if share >= 1.0:
        return F.sequence(F.lit(0), F.lit(trees - 1))
    mean = trees * share
    blocks = math.ceil((mean + 10 * math.sqrt(mean) + 10) / 4)
    numbers = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.array(*_share(F.lit(seed), F.col("event_id"), b))))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, number: Column) -> Column:
        gap = 1 + F.floor(F.log(1 - number) / F.lit(math.log(1 - share)))
        at = F.least(state["at"] + gap, F.lit(trees)).cast("int")
        return F.when(state["at"] >= trees, state).otherwise(F.struct(at.alias("at"), F.concat(state["found"], F.array(at)).alias("found")))

    return F.filter(F.aggregate(numbers, start, step, lambda state: state["found"]), lambda tree: tree < trees)


def tree_samples(df: DataFrame, columns: Sequence[str], cfg: ForestConfig, rows: int) -> DataFrame:
    """``sample_size`` rows for each tree, chosen by digests of the event, so repeatable anywhere.

    Every row competes in every tree with the same chance, in a log of any size; about four times the rows
    needed enter, and the least digests stay. Should that leave a tree short, the chance is raised.
    Features are rounded, so sums that differ in their last bits only are one value.
    """
    need = min(cfg.sample_size, rows)
    features = F.array(*[F.round(c, 9) for c in _clean(df, columns)]).alias("x")
    share = min(1.0, (4.0 * cfg.sample_size + 64.0) / rows) if rows else 1.0
    while True:
        entered = df.select("event_id", features, F.explode(_entered(cfg.trees, share, cfg.seed)).alias("tree_id"))
        rank = F.md5(F.concat_ws(":", F.lit(str(cfg.seed)), F.lit("rank"), F.col("tree_id").cast("string"), "event_id"))
        entered = materialize(entered.select("tree_id", rank.alias("_h"), "event_id", "x"), "tree-rows")
        full = entered.groupBy("tree_id").count().filter(F.col("count") >= need).count()
        if full == cfg.trees or share == 1.0:
            break
        share = min(1.0, 4 * share)
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy("_h", "event_id"))
    return entered.withColumn("_place", place).filter(F.col("_place") <= cfg.sample_size).drop("_place")


def grow_tree(sample: np.ndarray, key: tuple, height: int) -> list[tuple]:
    """Nodes of one tree, breadth first: (feature, threshold, left child, path length).

    The right child follows the left one. A leaf is its own child, so a walk of fixed
    length stays on it, and holds its depth plus the mean depth below it. A node is numbered by its way
    from the root (1, then twice that and one more to the right); its feature is drawn among those that
    vary over its rows, and the cut in their range, from the digest of ``key`` and that number.
    """
    below = average_path(np.arange(len(sample) + 1))
    nodes: list[tuple] = []
    waiting = [(np.arange(len(sample)), 0, 1)]
    while len(nodes) < len(waiting):
        rows, depth, way = waiting[len(nodes)]
        values = sample[rows]
        low, high = values.min(axis=0), values.max(axis=0)
        vary = np.flatnonzero(high > low)
        if depth >= height or not len(vary):
            nodes.append((0, math.inf, len(nodes), depth + float(below[len(rows)])))
            continue
        feature = int(vary[int(drawn(*key, way, "feature") * len(vary))])
        cut = float(low[feature] + drawn(*key, way, "cut") * (high[feature] - low[feature]))
        goes_left = values[:, feature] <= cut
        nodes.append((feature, cut, len(waiting), 0.0))
        waiting.append((rows[goes_left], depth + 1, 2 * way))
        waiting.append((rows[~goes_left], depth + 1, 2 * way + 1))
    return nodes


def grow_forest(samples: DataFrame, cfg: ForestConfig) -> DataFrame:
    height = math.ceil(math.log2(max(cfg.sample_size, 2)))
    seed = cfg.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        nodes = grow_tree(np.stack(pdf["x"].to_numpy()).astype(float), (seed, tree), height)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "child", "path"])
        out.insert(0, "node_id", np.arange(len(out)))
        out.insert(0, "tree_id", tree)
        return out

    return samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


def walk(x: np.ndarray, trees: Sequence[tuple], height: int) -> np.ndarray:
    """Mean path length of each row of ``x`` over all trees; a block of rows at a time stays in the cache."""
    whole = [(np.asarray(f, dtype=np.intp), cut, np.asarray(child, dtype=np.intp), path) for f, cut, child, path in trees]
    total = np.zeros(len(x))
    for start in range(0, len(x), WALK_ROWS):
        block = np.ascontiguousarray(x[start : start + WALK_ROWS])
        flat, rows, out = block.ravel(), len(block), total[start : start + WALK_ROWS]
        base = np.arange(rows) * block.shape[1]
        at, value, cut = np.empty(rows, dtype=np.intp), np.empty(rows), np.empty(rows)
        for feature, threshold, child, path in whole:
            node = np.zeros(rows, dtype=np.intp)
            for _ in range(height):
                np.add(np.take(feature, node, out=at, mode="clip"), base, out=at)
                np.take(flat, at, out=value, mode="clip")
                right = value > np.take(threshold, node, out=cut, mode="clip")
                np.add(np.take(child, node, out=at, mode="clip"), right, out=node)
            out += np.take(path, node, out=value, mode="clip")
    return total / len(trees)


@dataclass(frozen=True)
class ForestModel:
    """Fitted forest. ``nodes`` has at most trees * (2 * sample_size - 1) rows."""

    nodes: DataFrame
    columns: tuple[str, ...]
    sample_size: int
    threshold: float | None = None
    cfg: ForestConfig = ForestConfig()

    @classmethod
    def grow(cls, df: DataFrame, columns: Sequence[str], cfg: ForestConfig = ForestConfig()) -> ForestModel:
        """Grow the trees; :meth:`calibrate` then sets the threshold from scored rows."""
        rows = df.count()
        samples = tree_samples(df, columns, cfg, rows)
        nodes = materialize(grow_forest(samples, cfg), "forest")
        return cls(nodes, tuple(columns), min(cfg.sample_size, rows), None, cfg)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], cfg: ForestConfig = ForestConfig()) -> ForestModel:
        model = cls.grow(df, columns, cfg)
        return model.calibrate(materialize(model.score(df).select("iso_raw"), "forest-scores"))

    def calibrate(self, scored: DataFrame) -> ForestModel:
        """Set the threshold so that the configured share of the scored rows lies below it."""
        cut = percentile(scored, "iso_raw", 100 * self.cfg.contamination)
        return ForestModel(self.nodes, self.columns, self.sample_size, cut, self.cfg)

    def _trees(self) -> list[tuple]:
        # Bounded by the configuration, not by the log.
        pdf = self.nodes.toPandas().sort_values(["tree_id", "node_id"])
        return [
            tuple(t[c].to_numpy() for c in ("feature", "threshold", "child", "path"))
            for _, t in pdf.groupby("tree_id")
        ]

    def raw_score(self) -> Column:
        """Score in [-1, 0] as a column expression; lower is more unusual."""
        spark = self.nodes.sparkSession
        trees = spark.sparkContext.broadcast(self._trees())
        height = math.ceil(math.log2(max(self.cfg.sample_size, 2)))
        norm = max(float(average_path(self.sample_size)), 1e-12)

        @F.pandas_udf("double")
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                columns = columns if isinstance(columns, tuple) else (columns,)
                x = np.column_stack([c.astype(float).to_numpy() for c in columns])
                x[~np.isfinite(x)] = 0.0
                paths = walk(x, trees.value, height)
                yield pd.Series(-np.power(2.0, -paths / norm))

        return score(*[F.col(c) for c in self.columns])

    def walked(self, df: DataFrame) -> DataFrame:
        """The same score without Python workers: the trees, one row whose size the configuration
        bounds, are broadcast as arrays, and every row walks them by array functions."""
        node = F.struct("feature", "threshold", "child", "path")
        by_tree = self.nodes.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("node_id", node.alias("n")))).alias("s"))
        forest = by_tree.agg(F.array_sort(F.collect_list(F.struct("tree_id", F.col("s.n").alias("nodes")))).alias("_trees"))
        height = math.ceil(math.log2(max(self.cfg.sample_size, 2)))
        norm = max(float(average_path(self.sample_size)), 1e-12)
        x = F.array(*_clean(df, self.columns))

        def leaf(nodes: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                here = F.get(nodes, at)
                return here["child"] + (F.get(F.col("_x"), here["feature"]) > here["threshold"]).cast("int")

            return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.lit(0), step))["path"]

        total = F.aggregate("_trees", F.lit(0.0), lambda sum, tree: sum + leaf(tree["nodes"]))
        rows = df.withColumn("_x", x).crossJoin(F.broadcast(forest))
        return rows.withColumn("iso_raw", -F.pow(F.lit(2.0), -(total / F.size("_trees")) / norm)).drop("_x", "_trees")

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("iso_raw", self.raw_score())

    def label(self, df: DataFrame) -> DataFrame:
        odd = F.col("iso_raw") < F.lit(self.threshold)
        return df.withColumns(
            {"iso_anomaly_label": F.when(odd, -1).otherwise(1), "iso_is_anomaly": odd.cast("int")}
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Add label, score in [0, 1] (1 = most unusual) and flag."""
        scored = self.label(materialize(self.score(df), "forest-scored"))
        low, high = scored.agg(F.min(-F.col("iso_raw")), F.max(-F.col("iso_raw"))).first()
        out = scored.withColumn("iso_anomaly_score", scaled(-F.col("iso_raw"), low, high))
        return out.drop("iso_raw")

    def save(self, path: str) -> None:
        facts = F.struct(
            F.lit(self.threshold).cast("double").alias("threshold"),
            F.lit(self.sample_size).alias("sample_size"),
            F.lit(json.dumps(asdict(self.cfg))).alias("config"),
            F.array(*[F.lit(c) for c in self.columns]).alias("columns"),
        )
        self.nodes.withColumn("facts", facts).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> ForestModel:
        """The model as it was saved, with its own configuration."""
        table = spark.read.parquet(path)
        facts = table.select("facts.*").first()
        cfg = ForestConfig(**json.loads(facts["config"]))
        return cls(table.drop("facts"), tuple(facts["columns"]), facts["sample_size"], facts["threshold"], cfg)
