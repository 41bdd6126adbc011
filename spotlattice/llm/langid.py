"""Language identification by word-first backoff.

A token that the training sample knows as a word is scored by its log frequency in each language. An unseen
token falls back to its character n-grams: the longest order of which the sample knows any n-gram decides, and
shorter orders are tried only when it knows none. A document's score is the mean over its tokens, turned into a
posterior over the languages.

A token is a run of letters (Unicode's category L), in lower case; training and scoring share that one definition, so
numerals such as ½, ² or Ⅷ are no tokens. The model is learned from a sample of the labelled documents, whose bound is
``max_docs`` whole documents a language; ``min_words`` and ``min_grams`` hold at every size.

Defined cases: null text and text without letters give ``und`` and score 0, and so does a model without languages, which
has nothing to predict. A token of which the model knows nothing speaks for no language. Ties between languages go to the
one that sorts first. Repeated rows are scored alike; extra columns are kept, but for those named as the output.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.util import share_of_hash, sized_broadcast, stored

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no decimal digits
_CACHE_LIMIT = 200_000


def tokens_of(text: str | None) -> list[str]:
    found = _RUN.findall(text.lower()) if text else []
    if "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass
class LangModel:
    langs: list[str]
    words: dict[str, tuple] = field(default_factory=dict)  #: word -> log frequency in each language
    grams: dict[int, dict[str, tuple]] = field(default_factory=dict)  #: order -> n-gram -> log frequencies
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  #: tells models apart in reused workers


def sample_counts(train: DataFrame, text: str, lang: str, key: str, max_docs: int, seed: int) -> pd.DataFrame:
    """(lang, word, n) over a sample of about max_docs documents a language, chosen by a hash of ``key``.

    The sample bounds what comes to the driver, whatever the size of the table: the distinct words of that many
    documents. A null key is a key like others.
    """
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    per_lang = stored(train.groupBy("lang").agg((F.lit(float(max_docs)) / F.count("*")).alias("share")), "languages")
    # A row for each language: labels are few, but nothing says so, hence the look at the size.
    picked = train.join(sized_broadcast(per_lang, per_lang.count()), "lang").where(share_of_hash(seed, "key") < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter((x, w) for x, t in zip(b["lang"], b["text"], strict=True) for w in tokens_of(t))
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["lang", "word", "n"])

    words = picked.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()


def _log_rows(counts: dict[str, np.ndarray], n_langs: int) -> dict[str, tuple]:
    if not counts:
        return {}
    total = np.sum(list(counts.values()), axis=0) + 0.5 * len(counts)
    return {k: tuple(np.log((v + 0.5) / total)) for k, v in counts.items()}


def fit(counts: pd.DataFrame, *, max_order: int = 4, min_words: int = 2, min_grams: int = 3) -> LangModel:
    """Words seen at least min_words times are known; n-grams of orders 1 to max_order come from those words."""
    counts = counts.sort_values(["lang", "word"]) if len(counts) else counts
    langs = sorted(counts["lang"].unique()) if len(counts) else []
    at = {x: i for i, x in enumerate(langs)}
    words: dict[str, np.ndarray] = {}
    for lang, word, n in zip(counts["lang"], counts["word"], counts["n"], strict=True):
        words.setdefault(word, np.zeros(len(langs)))[at[lang]] += n
    words = {k: v for k, v in words.items() if v.sum() >= min_words}
    grams: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(1, max_order + 1)}
    for word, row in words.items():
        padded = f" {word} "
        for n in grams:
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                grams[n][g] = grams[n][g] + row if g in grams[n] else row
    kept = {n: {g: v for g, v in grams[n].items() if v.sum() >= min_grams} for n in grams}
    return LangModel(langs, _log_rows(words, len(langs)), {n: _log_rows(v, len(langs)) for n, v in kept.items()})


class _Rows(dict):
    """word -> row of self.values; unseen words get a row by backoff, until the cache is full."""

    def __init__(self, model: LangModel):
        super().__init__((w, i) for i, w in enumerate(model.words))
        self.model, self.base = model, len(self)
        self.values = np.zeros((max(1024, 2 * self.base), max(1, len(model.langs))))
        if self.base:
            self.values[: self.base] = list(model.words.values())

    def backoff(self, word: str):
        padded = f" {word} "
        for n in sorted(self.model.grams, reverse=True):
            known = self.model.grams[n]
            hits = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return 0.0

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[i] = self.backoff(word)
        self[word] = i
        return i


class Scorer:
    def __init__(self, model: LangModel):
        self.model, self.rows = model, _Rows(model)

    def score(self, text: str | None) -> tuple[str, float]:
        tokens = tokens_of(text) if self.model.langs else []
        if not tokens:
            return UNDETERMINED, 0.0
        if len(self.rows) > self.rows.base + _CACHE_LIMIT:
            self.rows = _Rows(self.model)
        ids = list(map(self.rows.__getitem__, tokens))
        mean = self.rows.values[ids].sum(axis=0) / len(ids)
        best = int(np.argmax(mean))
        return self.model.langs[best], 1.0 / float(np.exp(mean - mean[best]).sum())


_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: LangModel, *, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior (0 to 1); whole texts, one Arrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        key = shared.value.token
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        return pd.DataFrame([_SCORERS[key].score(t) for t in texts], columns=["lang", "score"])

    out = docs.withColumn("__lang_id", scored(F.col(text)))
    return out.withColumns({pred: F.col("__lang_id.lang"), score: F.col("__lang_id.score")}).drop("__lang_id")


def train_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 500, seed: int = 7, **options) -> LangModel:
    """Fit on a bounded sample: about max_docs labelled documents a language. ``options`` are those of ``fit``."""
    return fit(sample_counts(docs, text, lang, key, max_docs, seed), **options)
