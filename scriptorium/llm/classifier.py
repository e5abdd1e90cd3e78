"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of the text are Spark expressions. On a bounded sample of labelled training rows
(``SAMPLE`` documents at most, the smallest by a hash of id and statistics, whatever their labels; independent of the input's size)
small boosted regression trees are grown on the driver, each on ``TREE_SAMPLE`` of these rows drawn anew; every path of every tree becomes a
conjunctive rule over the statistics; a lasso logistic regression picks and weighs few of them; the
chosen rules become one Spark column, so scoring is a scan without Python.

Training uses only labels of rows whose crc32 of the id is not 0 modulo 5; neither labels nor
lang, source or doc_id enter a score.

Edge cases: null and empty texts have all statistics 0 and get the score those rules give;
repeated rows are scored each time, and a repeated label counts as often as it occurs; labels
that are null take no part, nor do labels of ids no document has; with fewer than ``LEAST_TRAINED`` training rows, or without both
classes among them, every score is the share of label 1 (0.5 if there is none); rows with null ids are scored, never held out and never
trained on; very long texts are read whole; documents of equal statistics get equal scores; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table, words
from .quality_rules import let

#: Labelled documents the ensemble is fitted on at most, of these each tree, and at least.
SAMPLE = 20_000
TREE_SAMPLE = 4_000
LEAST_TRAINED = 40
FOLDS = 5
THRESHOLD = 0.3
TREES = 40
DEPTH = 3
BINS = 32
LASSO = 2e-3
STEPS = 500

STATISTICS = (
    "n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "unique_share", "repeat_share",
    "dup_line_share", "bang_share", "short_line_share", "top_share", "stop_share",
)


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text, all doubles and never null."""
    t = F.coalesce(text, F.lit(""))
    d = lambda c: c.cast("double")
    count = lambda p: d(F.regexp_count(t, F.lit(p)))

    def of(w: Column) -> Column:
        n = F.greatest(d(F.size(w)), F.lit(1.0))
        chars = F.greatest(d(F.length(F.array_join(w, ""))), F.lit(1.0))
        again = F.size(F.filter(w, lambda x, i: F.get(w, i + 1) == x))
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)
        unique = d(F.size(F.array_distinct(w))) / n
        return let(
            lines,
            lambda ls: F.struct(
                d(F.size(w)).alias("n_words"), (chars / n).alias("mean_word"), (count(r"[#*$%&|<>{}=_~^\\]") / n).alias("symbol_share"),
                (count(r"\p{Lu}") / chars).alias("upper_share"), (count(r"[0-9]") / chars).alias("digit_share"), unique.alias("unique_share"),
                (d(again) / n).alias("repeat_share"),
                ((d(F.size(ls)) - d(F.size(F.array_distinct(ls)))) / F.greatest(d(F.size(ls)), F.lit(1.0))).alias("dup_line_share"),
                (count("[!?]") / n).alias("bang_share"), (d(F.size(ls)) / n).alias("short_line_share"),
                (d(F.size(F.filter(w, lambda x: x == F.get(w, F.lit(0))))) / n).alias("top_share"), (d(F.size(F.filter(w, lambda x: F.length(x) <= 3))) / n).alias("stop_share"),
            ),
        )

    return let(words(t), of)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for f, above, cut in self.terms:
            hit &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        return hit

    def column(self, stats: Column) -> Column:
        hit = F.lit(True)
        for f, above, cut in self.terms:
            c = stats[STATISTICS[f]]
            hit = hit & ((c > cut) if above else (c <= cut))
        return hit


def _tree_rules(x: np.ndarray, gain: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], columns: np.ndarray, out: list[tuple[Rule, float]], terms: tuple = (), at: np.ndarray | None = None) -> None:
    """Grows one tree on gradients; every node but the root is a rule, leaves carry steps."""
    at = np.arange(len(x)) if at is None else at
    best = (1e-6, -1, 0.0)
    g, h = gain[at].sum(), hess[at].sum()
    if len(terms) < DEPTH and len(at) >= 20:
        for f in columns:
            v = x[at, f]
            for c in cuts[f]:
                left = v <= c
                n = int(left.sum())
                if n < 10 or len(at) - n < 10:
                    continue
                gl, hl = gain[at][left].sum(), hess[at][left].sum()
                s = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if s > best[0]:
                    best = (s, int(f), float(c))
    if terms:
        out.append((Rule(terms), float(g / (h + 1)) if best[1] < 0 else 0.0))
    if best[1] >= 0:
        _, f, c = best
        left = x[at, f] <= c
        _tree_rules(x, gain, hess, cuts, columns, out, (*terms, (f, False, c)), at[left])
        _tree_rules(x, gain, hess, cuts, columns, out, (*terms, (f, True, c)), at[~left])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[float, list[tuple[Rule, float]]]:
    """The intercept and the weighted rules of a lasso over the paths of boosted trees."""
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(y) < LEAST_TRAINED or share in (0.0, 1.0):
        return base, []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    z, rules = np.full(len(y), base), []
    for _ in range(TREES):
        some = rng.permutation(len(y))[: min(len(y), TREE_SAMPLE)]
        columns = np.sort(rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)])
        p = _sigmoid(z[some])
        found: list[tuple[Rule, float]] = []
        _tree_rules(x[some], y[some] - p, p * (1 - p), cuts, columns, found)
        for rule, step in found:
            z += 0.3 * step * rule.on(x)
        rules += [r for r, _ in found]
    rules = list(dict.fromkeys(rules))
    a = np.stack([r.on(x) for r in rules], axis=1).astype(np.float64)
    keep = (a.mean(axis=0) > 1e-3) & (a.mean(axis=0) < 1 - 1e-3)
    a, rules = a[:, keep], [r for r, k in zip(rules, keep, strict=True) if k]
    if not rules:
        return base, []
    # Proximal gradient with momentum; the intercept is not penalised.
    scale = len(y) / (0.25 * (np.linalg.norm(a, 2) ** 2 + len(y)))
    w, b = np.zeros(a.shape[1]), base
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = (_sigmoid(a @ vw + vb) - y) / len(y)
        step = vw - scale * (a.T @ r)
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - scale * LASSO, 0), vb - scale * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    return float(b), [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]


def score_column(stats: Column, intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    z = F.lit(intercept)
    for rule, w in rules:
        z = z + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, labels being (doc_id, quality)."""
    stats = materialize(docs.select("doc_id", statistics(F.col("text")).alias("s")))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    trained = stats.join(broadcast_if_small(known.where(~held_out(F.col("doc_id")))), "doc_id")
    chosen = trained.orderBy(F.xxhash64("doc_id", "s"), "doc_id", "quality").limit(sample)
    rows = chosen.select("quality", *[F.col("s")[c].alias(c) for c in STATISTICS]).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=np.float64).reshape(-1, 1 + len(STATISTICS))
    intercept, rules = fit(data[:, 1:], data[:, 0])
    out = stats.withColumn("score", score_column(F.col("s"), intercept, rules))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
