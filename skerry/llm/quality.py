"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of lookup tables, one per feature and one per chosen pair
of features, put through a logistic function. Tables are learned by cyclic
boosting: in every round each feature in turn gets a shallow tree over its
bins, fitted to the gradient of the log loss, and a small step of it is added
to the feature's table. Then the pairs whose joint table explains most of what
is left are boosted in the same way with trees over both features.

Scoring looks up one number per table and adds them, for a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MADE = ("held_out", "score", "predicted")

FEATURES = (
    "log_bytes",
    "log_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "stop_share",
    "bang_share",
    "pipe_share",
    "distinct_word_share",
    "distinct_line_share",
    "log_line_bytes",
    "log_longest_word",
    "glued_symbol_share",
)

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*+<=>@[\\]^_`{}~|/"
_STOP = b".,;:?!"


def features(text: bytes) -> list[float]:
    """One value per name in ``FEATURES`` from a UTF-8 text; all finite."""
    from math import log1p

    n = len(text)
    found = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = n - len(text.translate(None, _LETTER))
    upper = n - len(text.translate(None, _UPPER))
    symbols = n - len(text.translate(None, _SYMBOL))
    glued = sum(map(text.count, (b"# ", b"$ ", b"% ", b"& ", b"* ", b"! ")))
    words = max(len(found), 1)
    return [
        log1p(n),
        log1p(len(found)),
        sum(map(len, found)) / words,
        upper / max(letters, 1),
        (n - len(text.translate(None, _DIGIT))) / max(n, 1),
        symbols / max(n, 1),
        (n - len(text.translate(None, _STOP))) / words,
        text.count(b"!") / words,
        text.count(b"|") / words,
        len(set(found)) / words,
        len(set(lines)) / max(len(lines), 1),
        log1p(n / max(len(lines), 1)),
        log1p(max(map(len, found), default=0)),
        glued / words,
    ]


@dataclass
class Model:
    """Tables of a fitted model; ``edges[f]`` are the inner bin borders."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (f, g, edges of f, edges of g, table)

    def raw(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, ef, eg, table in self.pairs:
            i = np.searchsorted(ef, x[:, f], side="right")
            j = np.searchsorted(eg, x[:, g], side="right")
            total += table[i, j]
        return total

    def score(self, x):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(values, bins: int):
    """Distinct inner quantiles of a feature."""
    import numpy as np

    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _value(grad, hess, ridge: float):
    return grad / (hess + ridge)


def _split(grad, hess, ridge: float):
    """Best cut of binned sums along the first axis: (gain, bins on the left)."""
    import numpy as np

    if len(grad) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gt, ht = grad.sum(), hess.sum()
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(grad, hess, leaves: int, ridge: float):
    """Step values per bin of a tree of at most ``leaves`` leaves (best first)."""
    import numpy as np

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        options = [(*_split(grad[a:b], hess[a:b], ridge), a, b) for a, b in parts]
        gain, cut, a, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = _value(grad[a:b].sum(), hess[a:b].sum(), ridge)
    return out


def _pair_tree(grad, hess, ridge: float):
    """Step values per cell of a tree of depth two over both axes."""
    import numpy as np

    def best(g, h):
        rows = _split(g.sum(axis=1), h.sum(axis=1), ridge)
        columns = _split(g.sum(axis=0), h.sum(axis=0), ridge)
        return (0, *rows) if rows[0] >= columns[0] else (1, *columns)

    def grow(g, h, depth):
        axis, gain, cut = best(g, h)
        if not depth or gain <= 1e-9:
            return np.full(g.shape, _value(g.sum(), h.sum(), ridge))
        (g1, g2), (h1, h2) = np.split(g, [cut], axis), np.split(h, [cut], axis)
        return np.concatenate([grow(g1, h1, depth - 1), grow(g2, h2, depth - 1)], axis)

    return grow(grad, hess, 2)


def fit(
    x,
    y,
    *,
    bins: int = 48,
    pair_bins: int = 12,
    rounds: int = 120,
    pair_rounds: int = 60,
    n_pairs: int = 6,
    rate: float = 0.1,
    leaves: int = 4,
    ridge: float = 2.0,
) -> Model:
    """Fit a model to feature rows ``x`` and labels ``y`` of 0 and 1."""
    import numpy as np

    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, float)
    if not len(y):
        return Model()
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(base=float(np.log(prior / (1 - prior))))
    model.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            r, h = slopes()
            step = rate * _tree(
                np.bincount(at[f], r, len(table)), np.bincount(at[f], h, len(table)), leaves, ridge
            )
            table += step
            total += step[at[f]]

    coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def joint(f, g, values):
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return np.bincount(cell[f] * shape[1] + cell[g], values, shape[0] * shape[1]).reshape(shape)

    r, h = slopes()
    gains = []
    for f in range(x.shape[1]):
        for g in range(f):
            grad, hess = joint(f, g, r), joint(f, g, h)
            gains.append((float((grad * _pair_tree(grad, hess, ridge)).sum()), f, g))
    for _, f, g in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))))
    for _ in range(pair_rounds):
        for f, g, _, _, table in model.pairs:
            r, h = slopes()
            step = rate * _pair_tree(joint(f, g, r), joint(f, g, h), ridge)
            table += step
            total += step[cell[f], cell[g]]
    return model


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_features(docs: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus the feature vector ``x``."""
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = T.StructType([*common.fields(source, keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(raw) for raw in common.as_bytes(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"]
            )

    return source.mapInArrow(run, schema)


def train(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_rows: int = 20_000, **params
) -> Model:
    """Fit on at most ``max_rows`` labelled documents that aren't held out.

    The sample is drawn by a hash of the id, so its size doesn't grow with the
    corpus, and it is the same in every run. A document with several labels
    counts as good if they are good on average.
    """
    marks = labels.select(common.named(doc_id).alias("of"), F.col("quality").alias("mark"))
    per = (
        marks.where(F.col("mark").isNotNull() & F.col("of").isNotNull() & ~held_out(F.col("of")))
        .groupBy("of")
        .agg((F.avg("mark") >= 0.5).cast("int").alias("y"))
    )
    drawn = per.orderBy(F.xxhash64("of", F.lit(5)), "of").limit(max_rows)
    # The sample has at most max_rows rows of two numbers.
    rows = docs.select(common.named(doc_id).alias("id"), common.named(text).alias("text")).join(
        F.broadcast(common.cut(drawn)), F.col("id") == F.col("of")
    )
    # Of repeated ids the text with the smallest hash, so the fit is the same in every run.
    rows = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    found = with_features(rows, text="text", keep=["id", "y"]).collect()
    found.sort(key=lambda r: r[0])
    return fit([r["x"] for r in found], [r["y"] for r in found], **params)


def score(
    docs: DataFrame,
    model: Model,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = 0.3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Score every whole text with a fitted model.

    Adds ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) to
    the columns ``carry`` (all, if None).

    Defined cases: a null text scores as an empty one; long texts are scored as
    a whole; without any labelled document every score is 0.5; a null id isn't
    held out; repeated rows each get their own score; an empty table gives no
    rows; input columns named like an output column are left out, other names
    are free.
    """
    common.bound_batches(docs.sparkSession)
    own = common.Own(docs, carry, MADE)
    keep = own.names
    source = docs.select(*own.staged, common.named(text).alias("body"), held_out(common.named(doc_id)).alias("held_out"))
    schema = T.StructType(
        [*common.fields(source, [*keep, "held_out"]), T.StructField("score", T.DoubleType())]
    )
    fitted = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = [features(raw) for raw in common.as_bytes(batch.column("body"))]
            x = np.array(rows, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), batch.column("held_out"), pa.array(fitted.value.score(x))],
                names=[*keep, "held_out", "score"],
            )

    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return source.mapInArrow(run, schema).select(*own.restored, "held_out", "score", predicted)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model, carry=["doc_id"])
