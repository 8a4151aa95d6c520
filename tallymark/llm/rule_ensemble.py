"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees propose rules: every path from a root is a conjunction of
bounds on statistics. Lasso logistic regression keeps a few of them, and these
become one Spark column expression, so scoring is a projection of the texts.

Training takes the SAMPLE labelled rows with the least hashes of their id; ids
with crc32(id) mod 5 = 0 are held out, rows without a label are not used, and of
repeated ids the least label counts. Without labels of both kinds every score is
the share of label 1 (0.5 without any). Null texts are empty; empty tables give
empty results; statistics are computed under names of their own, so columns of
the input with such names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import words

#: Bound on the labelled rows that a model is fitted on.
SAMPLE = 10_000
FOLDS = 5
CUTOFF = 0.3
TREES, DEPTH, BINS, LEAF = 40, 3, 32, 20
LASSO = 5e-4
ROUNDS = 600

#: A rule: bounds (statistic, threshold, below) that all hold.
Rule = tuple[tuple[str, float, bool], ...]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


STATISTICS = ("words", "word_length", "distinct_words", "distinct_root", "symbols", "pipes", "shouts", "stops", "digits",
              "capitals", "distinct_lines", "words_per_line")


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the statistics of its texts as columns `__stat_*`; no label, language or source is among them.

    What several statistics share is a column of its own, so it is computed once.
    """
    t, w, n, chars, n_lines = (F.col(f"__stat_{c}") for c in ("t", "w", "n", "chars", "n_lines"))
    rows = docs.withColumn("__stat_t", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumns({"__stat_w": words(t), "__stat_l": F.array_remove(F.split(t, "\n"), ""), "__stat_chars": F.length(t)})
    rows = rows.withColumns({"__stat_n": F.size(w), "__stat_different": F.size(F.array_distinct(w)), "__stat_n_lines": F.size("__stat_l"),
                             "__stat_inside": F.length(F.array_join(w, "")), "__stat_own_lines": F.size(F.array_distinct("__stat_l"))})
    different = F.col("__stat_different")

    def count(signs: str) -> Column:
        return chars - F.length(F.translate(t, signs, ""))

    rows = rows.withColumns({f"__stat_{name}": value for name, value in zip(STATISTICS, (
        n.cast("double"), _share(F.col("__stat_inside"), n), _share(different, n), _share(different, F.sqrt(n.cast("double"))),
        _share(count("#*$%&<>"), chars), _share(count("|"), chars), _share(count("!?"), chars), _share(count(".,;:"), n),
        _share(count("0123456789"), chars), _share(chars - F.length(F.regexp_replace(t, r"\p{Lu}+", "")), chars),
        _share(F.col("__stat_own_lines"), n_lines), _share(n, n_lines)), strict=True)})
    return rows.select(*docs.columns, *[f"__stat_{c}" for c in STATISTICS])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """The compiled ensemble, over the columns of with_statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, bound, below in rule:
                value = F.col(f"__stat_{name}")
                holds = holds & ((value <= bound) if below else (value > bound))
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(binned: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, path: tuple, depth: int, out: list) -> None:
    """A tree on the gradient; out gets (path, rows, step) of each node below the root."""
    if path:
        out.append((path, rows, grad[rows].sum() / (hess[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    best, cut = 1e-6, None
    for f in range(binned.shape[1]):
        bins = binned[rows, f]
        g = np.cumsum(np.bincount(bins, grad[rows], BINS))
        h = np.cumsum(np.bincount(bins, hess[rows], BINS))
        n = np.cumsum(np.bincount(bins, minlength=BINS))
        gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(n < LEAF) | (n > len(rows) - LEAF)] = 0
        if gain.max() > best:
            best, cut = gain.max(), (f, int(gain.argmax()))
    if cut is None:
        return
    f, b = cut
    low = binned[rows, f] <= b
    _grow(binned, rows[low], grad, hess, (*path, (f, b, True)), depth - 1, out)
    _grow(binned, rows[~low], grad, hess, (*path, (f, b, False)), depth - 1, out)


def _paths(binned: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The paths of boosted trees, without repeats."""
    found: dict[tuple, None] = {}
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        nodes: list = []
        _grow(binned, np.arange(len(y)), y - p, p * (1 - p), (), DEPTH, nodes)
        for path, rows, step in nodes:
            found.setdefault(tuple(sorted(path)))
            if len(path) == DEPTH or not any(other[0][: len(path)] == path and other[0] != path for other in nodes):
                margin[rows] += 0.3 * step
    return list(found)


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss with an L1 penalty on scaled rules, by accelerated proximal steps.

    x is 0 or 1; what the rules share of the rows and their scale stay factors, so x is not copied.
    """
    n, k = x.shape
    mean = x.mean(axis=0, dtype=np.float64)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 1e-3)
    gram = ((x.T @ x).astype(np.float64) - n * np.outer(mean, mean)) / np.outer(scale, scale)
    step = 4 * n / (np.linalg.norm(gram, 2) + n)
    w, v, b, c, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 1.0
    for _ in range(ROUNDS):
        margin = (x @ (v / scale).astype(np.float32)).astype(np.float64) + c - mean @ (v / scale)
        gap = 1 / (1 + np.exp(-margin)) - y
        w_new = v - step * (gap.astype(np.float32) @ x - mean * gap.sum()) / scale / n
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * LASSO, 0)
        b_new = c - step * gap.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return float(b - mean @ (w / scale)), w / scale


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    paths = _paths(binned, y)
    holds = np.ones((len(y), len(paths)), dtype=np.float32)
    for k, path in enumerate(paths):
        for f, b, below in path:
            holds[:, k] *= (binned[:, f] <= b) == below
    bias, weights = _lasso(holds, y) if paths else (float(np.log(y.mean() / (1 - y.mean()))), np.zeros(0))
    rules = tuple((float(w), tuple((names[f], float(edges[f][b]), below) for f, b, below in path))
                  for w, path in zip(weights, paths, strict=True) if abs(w) > 1e-9)
    return Model(bias, rules)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> Model:
    marked = (labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
              .where(F.col("label").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
              .groupBy("label_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # No more than `sample` narrow rows: small enough to broadcast at any input size.
    rows = with_statistics(texts.join(F.broadcast(marked), F.col("id") == F.col("label_id")), "text")
    rows = rows.select("id", "label", *[F.col(f"__stat_{c}").alias(c) for c in STATISTICS]).toPandas()
    names = list(STATISTICS)
    rows = rows.sort_values(["id", *names]).reset_index(drop=True)
    return train(rows[names].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float), names)


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with a column more: the score between 0 and 1."""
    return with_statistics(docs, text_col).select(*docs.columns, model.score().alias(into))
