"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of the text (shares of symbols, capitals, repeated words and so on)
are Spark expressions. On a bounded sample of labelled rows small boosted trees
are grown; each path from a root to a node is a rule, a conjunction of
thresholds. A lasso-penalised logistic regression over the rules leaves few
with a weight. These become one Spark expression, so that scoring the corpus is
a narrow pass without Python.

Defined results: a null text counts as empty and is scored like one; rows
without a label or with a held-out id are never learned from; without any
labels the score is 0.5, with one class the smoothed share of that class;
repeated rows get equal scores; other columns never enter a score; an empty
table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import text_or_empty

#: Labelled rows that a fit takes at most, those with the least hash of their id.
MAX_ROWS = 20_000
HELD_OUT = 5
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules may use; all are finite for every text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.array_remove(F.split(text, r"[\x09-\x0D\x20]+"), "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.array_remove(F.split(text, "\n"), "")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share(of: str) -> Column:
        return F.regexp_count(text, F.lit(of)) / n

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "mean_word": F.length(text) / n_words,
        "symbols": share(r"[$&%#*@^~_=+<>{}\[\]\\/]"),
        "bangs": share("[!?]"),
        "bars": share(r"[|]"),
        "stops": share("[.,;:]"),
        "digits": share("[0-9]"),
        "capitals": share(r"\p{Lu}"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "log_lines": F.log1p(n_lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, above, threshold)`` with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, limit in self.terms:
            out = out & ((stats[name] > limit) if above else (stats[name] <= limit))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {v:.6g}" for n, a, v in self.terms)


@dataclass(frozen=True)
class Model:
    """A constant and weighted rules; the score is the logistic of their sum."""

    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for r in self.rules:
            z = z + F.when(r.column(stats), F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score_rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """The same score over arrays, for tests."""
        z = np.full(len(next(iter(x.values()))), self.bias)
        for r in self.rules:
            on = np.ones(len(z), dtype=bool)
            for name, above, limit in r.terms:
                on &= (x[name] > limit) if above else (x[name] <= limit)
            z += r.weight * on
        return 1 / (1 + np.exp(-z))


def _best_split(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The gain, feature and threshold of the best split of some rows."""
    g, h = gradient.sum(), curvature.sum()
    best = None
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        size = len(edges) + 1
        gl = np.bincount(binned[:, j], gradient, size).cumsum()[:-1]
        hl = np.bincount(binned[:, j], curvature, size).cumsum()[:-1]
        nl = np.bincount(binned[:, j], minlength=size).cumsum()[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(nl < least) | (len(binned) - nl < least)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), j, float(edges[k]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[tuple[tuple[str, bool, float], ...]]:
    """The paths of boosted trees as conjunctions, without repeats."""
    cuts = [np.unique(np.quantile(c, np.linspace(0.005, 0.995, 199), method="midpoint")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], axis=1)
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    least = max(2, len(y) // 2000)
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        gradient, curvature = y - p, p * (1 - p)
        leaves = [(np.arange(len(y)), ())]
        for _ in range(depth):
            grown = []
            for rows, path in leaves:
                split = _best_split(x[rows], gradient[rows], curvature[rows], cuts, binned[rows], least) if len(rows) >= 2 * least else None
                if split is None:
                    grown.append((rows, path))
                    continue
                _, j, limit = split
                above = x[rows, j] > limit
                for side in (False, True):
                    term = (*path, (names[j], side, limit))
                    found.setdefault(_simplified(term))
                    grown.append((rows[above == side], term))
            leaves = grown
        for rows, _ in leaves:
            z[rows] += rate * gradient[rows].sum() / (curvature[rows].sum() + 1)
    return list(found)


def _simplified(terms: tuple[tuple[str, bool, float], ...]) -> tuple[tuple[str, bool, float], ...]:
    """One bound a side and statistic: the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, limit in terms:
        k = (name, above)
        tight[k] = limit if k not in tight else max(tight[k], limit) if above else min(tight[k], limit)
    return tuple(sorted((n, a, v) for (n, a), v in tight.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the constant isn't penalised."""
    n = len(y)
    a = np.concatenate([np.ones((n, 1)), r], axis=1)
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    v, t = w.copy(), 1.0
    power = np.ones(a.shape[1])
    for _ in range(20):
        power = a.T @ (a @ power)
        power /= np.linalg.norm(power)
    step = 4 * n / float(power @ (a.T @ (a @ power)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v)))
        u = v - step * (a.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return float(w[0]), w[1:]


def fit_rows(x: dict[str, np.ndarray], y: np.ndarray) -> Model:
    """Fit the ensemble to arrays of statistics and labels."""
    n, ones = len(y), float(np.sum(y))
    prior = np.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return Model(float(prior), ())
    names = sorted(x)
    m = np.stack([x[k] for k in names], axis=1)
    terms = grow_rules(m, y.astype(float), names)
    r = np.ones((n, len(terms)))
    for i, rule in enumerate(terms):
        for name, above, limit in rule:
            r[:, i] *= (x[name] > limit) if above else (x[name] <= limit)
    bias, w = lasso_logistic(r, y.astype(float))
    return Model(bias, tuple(Rule(t, float(v)) for t, v in zip(terms, w, strict=True) if abs(v) > 1e-6))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled rows that aren't held out.

    The sample's ids and labels (``max_rows`` at most) are broadcast to the
    texts, which are not moved; the statistics of as many rows come back.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
    picked = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("__doc"), text.alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    stats = statistics(F.col("__text"))
    # in one order, whatever the order of arrival: sums of the fit and a cut among repeated ids stay the same;
    # the statistics are made first, so that no text is ordered or sent
    order = [F.xxhash64("__id").alias("__1"), F.col("__id").alias("__2"), F.xxhash64("__text").alias("__3")]
    made = rows.select("__y", *order, *[c.cast("double").alias(k) for k, c in stats.items()])
    got = made.orderBy("__1", "__2", "__3", "__y").limit(max_rows).collect()
    y = np.array([r["__y"] for r in got], dtype=float)
    return fit_rows({k: np.array([r[k] for r in got], dtype=float) for k in stats}, y)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__score`` (0 to 1) and ``__predicted``."""
    names = {k: f"__stat_{k}" for k in statistics(F.lit(""))}
    stats = statistics(text_or_empty(text_col))
    used = {name for r in model.rules for name, _, _ in r.terms}
    # one struct, so that no statistic is computed again for each rule that uses it
    rows = docs.withColumn("__stats", F.struct(*[stats[k].cast("double").alias(names[k]) for k in sorted(used)])) if used else docs
    out = rows.withColumn("__score", model.score({k: F.col(f"__stats.{v}") for k, v in names.items()}))
    return out.withColumn("__predicted", (F.col("__score") >= threshold).cast("int")).drop("__stats")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = fit(docs, labels, **options)
    return score(docs, model).filter("__predicted = 1").select(*docs.columns)
