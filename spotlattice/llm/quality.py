"""Quality scores by a sparse rule ensemble.

Small regression trees are boosted on a bounded sample of labelled rows; every path from a root to a node is a
conjunctive rule over statistics of the text. A logistic model with an L1 penalty weighs the rules and leaves few. What is
left compiles into one Spark column expression over the statistics, which are column expressions themselves, so whole
tables are scored in one pass in the JVM, without a shuffle.

The sample is ``max_rows`` keys with a label at most, the first ones in the order of a hash, and as many of their texts.

Defined cases: null and empty texts have statistics of 0 and get a score like any other; a sample without both labels
gives the constant score of its mean (0.5 for no rows); rows with a null key or label are not learned from; a key with
several label rows counts once, with its largest label; of a key with several texts each may be in the sample. Extra
columns do no harm, as statistics live in one struct that is dropped; a column named as the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.util import own_name

STATISTICS = ("log_words", "word_length", "words_per_line", "symbols", "upper", "digits", "echoes", "distinct", "sentence_ends", "letters")


def statistics(text: Column) -> Column:
    """A struct of doubles for each of STATISTICS, over the whole text.

    Characters of a class are counted by what is left of the text without its runs, which makes no object a character.
    """
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    of_class = lambda chars_of: (chars - F.length(F.regexp_replace(t, f"[{chars_of}]+", ""))).cast("double")
    few = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    # Split at white space; an empty string stands before leading and after trailing white space.
    words = F.split(t, r"[\x20\x09-\x0D]+")
    blank = lambda w: (w == "").cast("int")
    ends = blank(F.element_at(words, 1)) + F.when(F.size(words) > 1, blank(F.element_at(words, -1))).otherwise(0)
    n_words = (F.size(words) - ends).cast("double")
    any_blank = F.greatest(blank(F.element_at(words, 1)), blank(F.element_at(words, -1)))
    of_chars, of_words = F.greatest(chars.cast("double"), F.lit(1.0)), F.greatest(n_words, F.lit(1.0))
    lines = (chars - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double") + 1
    others = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'\"()?-]+", "")).cast("double")
    return F.struct(
        F.log1p(n_words).alias("log_words"),
        (chars / of_words).alias("word_length"),
        (n_words / lines).alias("words_per_line"),
        (others / of_words).alias("symbols"),
        (of_class(r"\p{Lu}") / of_chars).alias("upper"),
        (of_class("0-9") / of_chars).alias("digits"),
        (few(r"(?<![^\s])([^\s]++)\s(?=\1(?:\s|$))") / of_words).alias("echoes"),
        ((F.size(F.array_distinct(words)) - any_blank) / of_words).alias("distinct"),
        (few(r"[.!?](?:\s|$)") / of_words).alias("sentence_ends"),
        (of_class(r"\p{L}") / of_chars).alias("letters"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = None
        for f, above, t in self.terms:
            c = stats[STATISTICS[f]] > F.lit(float(t)) if above else stats[STATISTICS[f]] <= F.lit(float(t))
            out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: Column) -> Column:
        """The score between 0 and 1 as a column expression."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list) -> None:
    """Add the rules of the best split of these rows, then those of its two sides; fills ``out`` with (rule, rows)."""
    if depth == 0 or len(rows) < 2 * least:
        return
    total, n, best = y[rows].sum(), len(rows), (1e-9, None)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        k = codes[rows, f]
        left_n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
        left_y = np.cumsum(np.bincount(k, weights=y[rows], minlength=len(c) + 1))[:-1]
        ok = (left_n >= least) & (n - left_n >= least)
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left_y**2 / left_n + (total - left_y) ** 2 / (n - left_n) - total**2 / n, -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
    if best[1] is None:
        return
    f, i = best[1]
    above = codes[rows, f] > i
    for side in (False, True):
        here = (*path, (f, side, float(cuts[f][i])))
        part = rows[above == side]
        out.append((Rule(here), part))
        _grow(x, codes, cuts, y, part, depth - 1, least, here, out)


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, rate: float, bins: int, seed: int) -> list[Rule]:
    """The distinct node paths of gradient-boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    z, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, int(0.6 * len(y))), replace=False))
        found: list[tuple[Rule, np.ndarray]] = []
        _grow(x, codes, cuts, residual, rows, depth, max(5, len(y) // 200), (), found)
        leaves = [r for r, _ in found if not any(o.terms[: len(r.terms)] == r.terms and o != r for o, _ in found)]
        for r, _ in found:
            rules.setdefault(r, None)
        for r in leaves:
            held = r.holds(x)
            z[held] += rate * residual[held].mean() * 4 if held.any() else 0
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights of an L1-penalised logistic regression by accelerated proximal gradient; the bias is free."""
    n, m = a.shape
    mean = a.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    b = (a - mean) / scale
    step = 1.0 / (0.25 * (np.linalg.norm(b, 2) ** 2 / n + 1.0))
    w, v, bias, vb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(b @ v + vb))) - y
        new = v - step * (b.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = vb - step * g.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return float(bias - (w / scale) @ mean), w / scale


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y, trees=trees, depth=depth, rate=rate, bins=bins, seed=seed)
    if not rules:
        return fit(x, np.full(1, y.mean()))
    bias, w = lasso_logistic(np.stack([r.holds(x) for r in rules], 1).astype(float), y, penalty)
    return RuleEnsemble(bias, tuple((r, float(k)) for r, k in zip(rules, w, strict=True) if k))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 4000, seed: int = 5, **options) -> RuleEnsemble:
    """Fit on max_rows labelled keys at most: the sample's bound."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max(F.col(label).cast("double")).alias("__y"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "__k"), "__k").limit(max_rows)  # each task keeps max_rows at most
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(sample), "__k")
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "__k", "__t"), "__k", F.length("__t")).limit(max_rows)
    got = drawn.select("__y", statistics(F.col("__t")).alias("s")).select("__y", *[F.col("s")[s].alias(s) for s in STATISTICS]).toPandas()
    got = got.sort_values([*STATISTICS, "__y"])
    return fit(got[list(STATISTICS)].to_numpy(float), got["__y"].to_numpy(float), seed=seed, **options)


def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x))))))


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list) -> None:
    """Add the rules of the best split of these rows, then those of its two sides; fills ``out`` with (rule, rows)."""
    if depth == 0 or len(rows) < 2 * least:
        return
    total, n, best = y[rows].sum(), len(rows), (1e-9, None)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        k = codes[rows, f]
        left_n = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
        left_y = np.cumsum(np.bincount(k, weights=y[rows], minlength=len(c) + 1))[:-1]
        ok = (left_n >= least) & (n - left_n >= least)
        if ok.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, left_y**2 / left_n + (total - left_y) ** 2 / (n - left_n) - total**2 / n, -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
    if best[1] is None:
        return
    f, i = best[1]
    above = codes[rows, f] > i
    for side in (False, True):
        here = (*path, (f, side, float(cuts[f][i])))
        part = rows[above == side]
        out.append((Rule(here), part))
        _grow(x, codes, cuts, y, part, depth - 1, least, here, out)


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, rate: float, bins: int, seed: int) -> list[Rule]:
    """The distinct node paths of gradient-boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    z, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-z))
        rows = np.sort(rng.choice(len(y), max(1, int(0.6 * len(y))), replace=False))
        found: list[tuple[Rule, np.ndarray]] = []
        _grow(x, codes, cuts, residual, rows, depth, max(5, len(y) // 200), (), found)
        leaves = [r for r, _ in found if not any(o.terms[: len(r.terms)] == r.terms and o != r for o, _ in found)]
        for r, _ in found:
            rules.setdefault(r, None)
        for r in leaves:
            held = r.holds(x)
            z[held] += rate * residual[held].mean() * 4 if held.any() else 0
    return list(rules)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights of an L1-penalised logistic regression by accelerated proximal gradient; the bias is free."""
    n, m = a.shape
    mean = a.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    b = (a - mean) / scale
    step = 1.0 / (0.25 * (np.linalg.norm(b, 2) ** 2 / n + 1.0))
    w, v, bias, vb, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(b @ v + vb))) - y
        new = v - step * (b.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = vb - step * g.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return float(bias - (w / scale) @ mean), w / scale


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, penalty: float = 0.002, seed: int = 5) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleEnsemble(float(np.log(p / (1 - p))), ())
    rules = tree_rules(x, y, trees=trees, depth=depth, rate=rate, bins=bins, seed=seed)
    if not rules:
        return fit(x, np.full(1, y.mean()))
    bias, w = lasso_logistic(np.stack([r.holds(x) for r in rules], 1).astype(float), y, penalty)
    return RuleEnsemble(bias, tuple((r, float(k)) for r, k in zip(rules, w, strict=True) if k))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 4000, seed: int = 5, **options) -> RuleEnsemble:
    """Fit on at most about max_rows labelled rows, taken by a hash of the key: the sample's bound."""
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("__k"), F.col(label).cast("double").alias("__y"))
    n = labels.count()
    share = F.lit(int(min(1.0, max_rows / max(1, n)) * 1_000_000))
    sample = labels.where(F.pmod(F.xxhash64(F.lit(seed), "__k"), F.lit(1_000_000)) < share).limit(2 * max_rows)
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(sample), "__k")
    got = rows.select("__y", statistics(F.col("__t")).alias("s")).select("__y", *[F.col("s")[s].alias(s) for s in STATISTICS]).orderBy(*STATISTICS, "__y").limit(4 * max_rows).toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), got["__y"].to_numpy(float), seed=seed, **options)


def score(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", out: str = "score") -> DataFrame:
    stats = own_name(docs, "__statistics")
    return docs.withColumn(stats, statistics(F.col(text))).withColumn(out, model.column(F.col(stats))).drop(stats)
