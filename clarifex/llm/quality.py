"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into one Spark expression.

Small trees, each grown on a part of a bounded sample, give rules: every path from a root is a
conjunction of comparisons. A logistic model with an L1 penalty gives most rules no weight; those
left become a sum of CASE expressions, so scoring runs inside Spark's generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import cut

#: The bounded sample of labelled rows; trees, their depth, rows of a leaf; weight of the penalty.
SAMPLE, TREES, DEPTH, LEAF, PENALTY, SEED = 20_000, 40, 3, 20, 0.002, 11


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions; all are defined, and zero, for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    size = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "characters_a_word": F.length(t) / n_words,
        "capitals": count(r"\p{Lu}") / size,
        "digits": count(r"[0-9]") / size,
        "symbols": count(r"[#$%&*+<=>@\\^_`{|}~\[\]]") / size,
        "bars": count(r"\|") / n_words,
        "bangs": count(r"!") / n_words,
        "stops": count(r"[.?]") / n_words,
        "commas": count(r",") / n_words,
        "lines": count(r"\n") / n_words,
        "not_letters": count(r"[^\p{L}\s]") / size,
    }


FEATURES = ["log_words", "distinct_words", "characters_a_word", "capitals", "digits", "symbols", "bars", "bangs", "stops", "commas", "lines", "not_letters"]


#: One comparison: the number of a feature, a threshold, and whether the value must be above it.
Test = tuple[int, float, bool]


@dataclass
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    bias: float
    rules: list[tuple[tuple[Test, ...], float]]

    def column(self, of: dict[str, Column]) -> Column:
        names = list(of)
        total = F.lit(float(self.bias))
        for tests, weight in self.rules:
            holds = F.lit(True)
            for k, limit, above in tests:
                holds &= (of[names[k]] > F.lit(limit)) if above else (of[names[k]] <= F.lit(limit))
            total += F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for tests, weight in self.rules:
            total += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, limit, above in tests:
        ok &= (x[:, k] > limit) if above else (x[:, k] <= limit)
    return ok


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray) -> tuple[int, float] | None:
    """The comparison that lowers the Gini impurity most, with at least LEAF rows on either side."""
    best, found = 1e-9, None
    n, ones = len(y), y.sum()
    impure = ones * (n - ones) / n
    for k in features:
        order = np.argsort(x[:, k], kind="stable")
        v, left = x[order, k], np.cumsum(y[order])[:-1]
        m = np.arange(1, n)
        gain = impure - left * (m - left) / m - (ones - left) * (n - m - ones + left) / (n - m)
        gain[(v[1:] <= v[:-1]) | (m < LEAF) | (n - m < LEAF)] = -1
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = gain[at], (int(k), float((v[at] + v[at + 1]) / 2))
    return found


def paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, above: tuple[Test, ...] = ()) -> list[tuple[Test, ...]]:
    """The conjunctions at all nodes but the root of one tree; each split sees a random part of the features."""
    if not depth or len(y) < 2 * LEAF or y.min() == y.max():
        return []
    features = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
    if (found := _split(x, y, features)) is None:
        return []
    k, limit = found
    out = []
    for side in (False, True):
        own = _holds(x, ((k, limit, side),))
        rule = (*above, (k, limit, side))
        out += [rule, *paths(x[own], y[own], rng, depth - 1, rule)]
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of the logistic model with an L1 penalty on the weights, by accelerated proximal gradient steps."""
    mean = r.mean(axis=0)
    z = r - mean
    step = 4 * len(y) / max(1e-9, float(np.linalg.eigvalsh(z.T @ z)[-1]) if r.shape[1] else 1.0)
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, last, t = w.copy(), w, 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(z @ v + b))) - y
        b -= 2 * gap.mean()
        u = v - step * (z.T @ gap) / len(y)
        w = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, last = w + (before - 1) / t * (w - last), w
    return b - float(mean @ w), w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x with labels y (0 or 1). Without rows every score is 0.5; with one label it is near that label."""
    if not len(y):
        return Model(0.0, [])
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, [])
    rng = np.random.default_rng(SEED)
    order = np.lexsort([y, *x.T])
    x, y = x[order], y[order].astype(float)
    rules: dict[tuple[Test, ...], None] = {}
    for _ in range(TREES):
        own = rng.choice(len(y), max(1, min(len(y), max(2 * LEAF, len(y) // 4))), replace=False)
        rules |= dict.fromkeys(paths(x[own], y[own], rng))
    held: dict[bytes, tuple[Test, ...]] = {}
    for rule in sorted(rules, key=len):  # of rules that hold for the same rows, a shortest stays
        held.setdefault(_holds(x, rule).tobytes(), rule)
    kept = list(held.values())
    if not kept:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), [])
    bias, weights = lasso(np.stack([_holds(x, r) for r in kept], axis=1).astype(float), y, PENALTY)
    return Model(bias, [(r, float(w)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (id, label), from ``sample`` labelled rows at most, drawn by a hash of the id.

    Null labels are left out; of several labels of an id the least counts, and a row counts as often as
    it is repeated, up to 4 * ``sample`` rows with the least hashes of their statistics. Only the sampled
    rows' statistics reach the driver, in an order that does not depend on partitions.
    """
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__quality_id")).agg(F.min(label_col).cast("int").alias("__quality_label"))
    some = cut(each.orderBy(F.xxhash64(F.lit(SEED), "__quality_id"), "__quality_id").limit(sample))
    rows = docs.join(F.broadcast(some), F.col(f"`{id_col}`") == F.col("__quality_id")).select("__quality_label", *[c.alias(n) for n, c in statistics(F.col(f"`{text_col}`")).items()])
    got = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(4 * sample).toPandas()
    return fit(got[FEATURES].to_numpy(np.float64), (got["__quality_label"].to_numpy() > 0).astype(int)) if len(got) else fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text (0 to 1), null and empty texts included; all in built-in expressions."""
    hidden = {n: f"__quality_{n}" for n in FEATURES}
    with_stats = docs.withColumns({hidden[n]: c for n, c in statistics(F.col(f"`{text_col}`")).items()})
    return with_stats.withColumn(name, model.column({n: F.col(h) for n, h in hidden.items()})).drop(*hidden.values())
