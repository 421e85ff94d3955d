"""Learning to rank: scaling, pairwise learner, scoring, training files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import FLAT, place
from ..functions.text import six_places

# Published weights of the six cluster features, in sorted order
# of their names.
PUBLISHED = (0.006048895, -3.2712941, 4.1410227, -0.19549844, 2.1483274, 1.4449468)


@dataclass(frozen=True)
class Scaler:
    """Per feature (offset, width): minimum and range, or mean and deviation."""

    mode: str
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)


def fit_scaler(instances: DataFrame, names: list[str], mode: str = "minmax") -> Scaler:
    """Global statistics over all instances, one aggregation."""
    if mode not in ("minmax", "zscore"):
        return Scaler("none")
    aggregates = []
    for n in names:
        x = F.coalesce(n, F.lit(0.0))
        if mode == "minmax":
            aggregates += [F.min(x), F.max(x) - F.min(x)]
        else:
            aggregates += [F.avg(x), F.stddev_pop(x)]
    row = instances.agg(*(a.alias(f"c{k}") for k, a in enumerate(aggregates))).first()
    return Scaler(mode, {n: (row[2 * k] or 0.0, row[2 * k + 1] or 0.0) for k, n in enumerate(names)})


def apply_scaler(instances: DataFrame, scaler: Scaler, names: list[str]) -> DataFrame:
    """Scaled features; a constant feature becomes 0, a missing one counts as 0."""

    def scaled(n: str) -> Column:
        x = F.coalesce(n, F.lit(0.0))
        if scaler.mode == "none":
            return x
        offset, width = scaler.stats[n]
        return F.lit(0.0) if abs(width) <= FLAT else (x - offset) / F.lit(width)

    return instances.withColumns({n: scaled(n) for n in names})


def linear_score(weights: dict[str, float] | list[float], names: list[str], bias: float = 0.0) -> Column:
    """``sum(w x) + bias`` as one column expression."""
    values = [weights[n] for n in names] if isinstance(weights, dict) else list(weights)
    if len(values) != len(names):
        raise ValueError("one weight per feature")
    total = F.lit(float(bias))
    for n, w in zip(names, values):
        total = total + F.coalesce(n, F.lit(0.0)) * F.lit(float(w))
    return place(total)


def preferences(instances: DataFrame, names: list[str]) -> DataFrame:
    """``(topic_id, d)``: feature differences of pairs with y_i > y_j in a topic."""
    x = F.array(*(F.coalesce(n, F.lit(0.0)) for n in names))
    a = instances.select("topic_id", F.col("label").alias("ya"), x.alias("xa"))
    b = instances.select("topic_id", F.col("label").alias("yb"), x.alias("xb"))
    pairs = a.join(b, "topic_id").where("ya > yb")
    return pairs.select("topic_id", F.zip_with("xa", "xb", lambda p, q: p - q).alias("d"))


@dataclass(frozen=True)
class LinearModel:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    scaler: Scaler
    objective: float = 0.0
    bias: float = 0.0

    def score(self, instances: DataFrame) -> DataFrame:
        scaled = apply_scaler(instances, self.scaler, list(self.names))
        keys = [c for c in instances.columns if c not in self.names]
        return scaled.select(*keys, linear_score(list(self.weights), list(self.names), self.bias).alias("score"))


def margin(w) -> Column:
    """``w d``, term by term: compiled, while a lambda would be interpreted for
    every pair and round."""
    total = F.lit(0.0)
    for k, v in enumerate(w):
        total = total + F.col("d")[k] * F.lit(float(v))
    return total


def hinge(pairs: DataFrame, w, weight: float):
    """Objective and subgradient of ``|w|^2 / 2 + weight * sum(max(0, 1 - w d))``:
    one aggregation over the pairs, which stay where they are."""
    import numpy as np

    violated = pairs.withColumn("loss", 1.0 - margin(w)).where("loss > 0")
    parts = [F.sum("loss"), *(F.sum(F.col("d")[k]) for k in range(len(w)))]
    row = violated.agg(*(p.alias(f"c{k}") for k, p in enumerate(parts))).first()
    loss = weight * (row[0] or 0.0)
    grad = np.array([-(row[k + 1] or 0.0) * weight for k in range(len(w))])
    return float(w @ w / 2 + loss), grad, loss


def train_ranksvm(
    instances: DataFrame,
    names: list[str],
    c: float = 1.0,
    scaling: str = "minmax",
    rounds: int = 60,
    tolerance: float = 1e-3,
) -> LinearModel:
    """Pairwise hinge learner by cutting planes.

    Minimises ``|w|^2 / 2 + (c / topics) * sum(max(0, 1 - w (x_i - x_j)))``
    over pairs with y_i > y_j of one topic. Each round is one distributed
    aggregation; the driver solves a tiny dual over the planes so far. Without
    any pair the weights are zero.
    """
    import numpy as np

    scaler = fit_scaler(instances, names, scaling)
    scaled = apply_scaler(instances, scaler, names)
    topics = max(1, instances.select("topic_id").distinct().count())
    pairs = preferences(scaled, names).persist()
    try:
        weight = c / topics
        w = np.zeros(len(names))
        best, best_w = np.inf, w
        slopes, offsets = [], []
        for _ in range(rounds):
            value, grad, loss = hinge(pairs, w, weight)
            if value < best:
                best, best_w = value, w
            slopes.append(grad)
            offsets.append(loss - grad @ w)
            a, b = np.array(slopes), np.array(offsets)
            alpha = simplex_dual(a, b)
            w = -a.T @ alpha
            lower = float(w @ w / 2 + (a @ w + b).max(initial=0.0))
            if best - lower <= tolerance * max(1.0, best):
                break
        return LinearModel(tuple(names), tuple(map(float, best_w)), scaler, float(best))
    finally:
        pairs.unpersist()


def simplex_dual(a, b, steps: int = 3000):
    """Maximise ``b alpha - |a' alpha|^2 / 2`` over alpha >= 0, sum(alpha) <= 1,
    by accelerated projected gradient (a handful of planes)."""
    import numpy as np

    gram = a @ a.T
    rate = 1.0 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    x = y = np.full(len(b), 1.0 / len(b))
    t = 1.0
    for _ in range(steps):
        new = project(y + rate * (b - gram @ y))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-12:
            break
        x, t = new, t_new
    return x


def project(v):
    """Nearest point with non-negative entries whose sum is at most one."""
    import numpy as np

    clipped = np.maximum(v, 0)
    if clipped.sum() <= 1:
        return clipped
    u = np.sort(v)[::-1]
    total = np.cumsum(u) - 1
    k = np.nonzero(u - total / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - total[k] / (k + 1), 0)


def train_linear_svc(
    instances: DataFrame, names: list[str], c: float = 1.0, balanced: bool = True, max_iter: int = 100
) -> LinearModel:
    """Point-wise linear classifier (label > 0) on standardised features."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    scaler = fit_scaler(instances, names, "zscore")
    scaled = apply_scaler(instances, scaler, names).withColumn("y", (F.col("label") > 0).cast("double"))
    counts = {r["y"]: r["count"] for r in scaled.groupBy("y").count().collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        return LinearModel(tuple(names), (0.0,) * len(names), scaler)
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col("y") > 0, n / (2.0 * counts[1.0])).otherwise(n / (2.0 * counts[0.0]))
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(scaled.withColumn("weight", weight))
    fitted = LinearSVC(
        featuresCol="x", labelCol="y", weightCol="weight", regParam=1.0 / (c * n), maxIter=max_iter, standardization=False
    ).fit(rows)
    return LinearModel(tuple(names), tuple(map(float, fitted.coefficients)), scaler, 0.0, float(fitted.intercept))


BACKENDS = {"svm_rank": "rank", "svmrank": "rank", "linear_svc": "svc", "linearsvc": "svc", "linear": "svc"}


def train(instances: DataFrame, names: list[str], backend: str = "svm_rank", **options) -> LinearModel:
    kind = BACKENDS.get(backend)
    if kind is None:
        raise ValueError(f"unknown learner {backend!r}")
    return train_ranksvm(instances, names, **options) if kind == "rank" else train_linear_svc(instances, names, **options)


def swapped_pairs(scored: DataFrame) -> DataFrame:
    """``(topic_id, pairs, swapped, fraction)``; equal scores count as swapped,
    a topic without pairs has fraction 0."""
    a = scored.select("topic_id", F.col("label").alias("ya"), F.col("score").alias("sa"))
    b = scored.select("topic_id", F.col("label").alias("yb"), F.col("score").alias("sb"))
    counted = (
        a.join(b, "topic_id")
        .where("ya > yb")
        .groupBy("topic_id")
        .agg(F.count("*").alias("pairs"), F.sum((F.col("sa") <= F.col("sb")).cast("long")).alias("swapped"))
    )
    out = scored.select("topic_id").distinct().join(counted, "topic_id", "left").fillna(0, ["pairs", "swapped"])
    fraction = F.coalesce(F.col("swapped") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(0.0))
    return out.withColumn("fraction", place(fraction))


def learning_lines(instances: DataFrame, names: list[str], item: str) -> DataFrame:
    """``label qid:t i:v ... # id`` lines: features from 1, zeros left out, six places."""

    def one(k: int, n: str) -> Column:
        x = F.bround(F.coalesce(n, F.lit(0.0)), 6)
        return F.when(x != 0, F.concat(F.lit(f"{k}:"), six_places(x)))

    parts = [one(k, n) for k, n in enumerate(names, 1)]
    head = F.concat(F.col("label").cast("int").cast("string"), F.lit(" qid:"), F.col("topic_id").cast("string"))
    line = F.concat_ws(" ", head, *parts, F.concat(F.lit("# "), F.col(item).cast("string")))
    return instances.select("topic_id", F.col(item).alias("item"), line.alias("line"))
