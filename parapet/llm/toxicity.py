"""Toxicity by classifier chains over labelled categories.

Categories are predicted one after the other by linear models. A later model sees the probabilities of the earlier
categories besides the words of the text; in training these are out-of-fold predictions, so that it learns how far they
can be trusted. Fitting uses a bounded sample of labelled rows; prediction reads every whole text, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm import linear
from parapet.llm.common import one_text, written

#: Labelled rows used for fitting, per category and side (the lowest by hash of the id).
ROWS_PER_SIDE = 2_000
#: Words with a weight, per category.
WORDS = 400
LEAST_DOCS = 5
FOLDS = 5
RIDGE = 0.5
#: Words must tell this much (chi-square with one degree of freedom); weaker ones are noise in long texts.
LEAST_SCORE = 20.0
WORD = re.compile(r"[^\W\d_]+")
SHAPES = 4


@dataclass
class Chain:
    """Word positions, scale of the shape features, and per category its weights and threshold."""

    categories: list[str]
    words: dict[str, int]
    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words) + SHAPES), np.float32)
        for i, text in enumerate(texts):
            for word in self.words.keys() & set(WORD.findall(text.lower())):
                x[i, self.words[word]] = 1
            x[i, len(self.words):] = shape(text)
        x[:, len(self.words):] = (x[:, len(self.words):] - self.centre) / self.spread
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column per category, each fed to the later ones."""
        found = np.zeros((len(x), 0))
        for w in self.weights:
            found = np.column_stack([found, linear.predict(w, np.column_stack([x, found]))])
        return found


def shape(text: str) -> list[float]:
    """Share of upper-case letters and of symbols, mean word length, logarithm of the length."""
    size = max(1, len(text))
    upper = len(re.findall(r"[A-Z]", text))
    symbols = len(re.findall(r"[#$%&*!?<>|@]", text))
    blanks = text.count(" ") + text.count("\n")
    return [upper / size, symbols / size, min(size / (blanks + 1), 50.0), float(np.log(size))]


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows_per_side: int = ROWS_PER_SIDE,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, shape and categories (0 or 1) of a bounded number of labelled documents.

    Labels with a null id or category are left out; an id labelled several times counts as positive if any label is.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in categories])
    sides = [known.filter(F.col(n) == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_side)
             for n in categories for side in (0, 1)]
    ids = sides[0]
    for other in sides[1:]:
        ids = ids.unionByName(other)
    ids = ids.dropDuplicates(["doc_id"])

    @F.pandas_udf("words array<string>, shape array<double>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        return pd.DataFrame({"words": [sorted(set(WORD.findall(t.lower()))) for t in texts], "shape": [shape(t) for t in texts]})

    rows = one_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id"))
    return written(rows.withColumn("parts", parts("text")).select("doc_id", *categories, "parts.words", "parts.shape"),
                   "toxicity-sample")


def vocabulary(rows: DataFrame, categories: list[str], words: int = WORDS, least: int = LEAST_DOCS) -> list[str]:
    """Words that tell most about a category, by chi-square over documents."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    counts = rows.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).filter(F.col("n") >= least)
    found: set[str] = set()
    for c in categories:
        a, b = F.col(c).cast("double"), (F.col("n") - F.col(c)).cast("double")
        rest, other = F.lit(float(n[c])) - a, F.lit(float(n["n"] - n[c])) - b
        below = (a + b) * (rest + other) * (a + rest) * (b + other)
        score = F.when(below > 0, F.lit(float(n["n"])) * F.pow(a * other - b * rest, F.lit(2.0)) / below).otherwise(0.0)
        told = counts.select("word", score.alias("score")).filter(F.col("score") >= LEAST_SCORE)
        best = told.orderBy(F.desc("score"), "word").limit(words)
        found |= {r["word"] for r in best.collect()}
    return sorted(found)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows_per_side: int = ROWS_PER_SIDE) -> Chain:
    """Fit the chain in the order of ``categories``. A category with one class only gets no positives at all."""
    rows = sample(docs, labels, categories, rows_per_side)
    names = list(categories)
    words = vocabulary(rows, names)
    place = {w: i for i, w in enumerate(words)}
    chosen = F.array_intersect("words", F.array(*map(F.lit, words)).cast("array<string>"))
    got = rows.select("doc_id", *names, chosen.alias("words"), "shape").orderBy(
        *names, F.xxhash64("doc_id"), "doc_id", "shape").collect()  # every fold gets its share of each side
    x = np.zeros((len(got), len(words) + SHAPES), np.float32)
    for i, row in enumerate(got):
        x[i, [place[w] for w in row["words"]]] = 1
        x[i, len(words):] = row["shape"]
    centre = x[:, len(words):].mean(0) if len(got) else np.zeros(SHAPES)
    spread = x[:, len(words):].std(0) + 1e-6 if len(got) else np.ones(SHAPES)
    x[:, len(words):] = (x[:, len(words):] - centre) / spread
    folds = np.arange(len(got)) % FOLDS
    weights, thresholds = [], []
    for name in names:
        y = np.array([row[name] for row in got], np.float64)
        held_out = linear.out_of_fold(x, y, folds, RIDGE)
        weights.append(linear.fit(x, y, RIDGE))
        thresholds.append(linear.best_threshold(held_out, y))
        x = np.column_stack([x, held_out.astype(np.float32)])
    return Chain(names, place, centre, spread, weights, thresholds)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All rows and columns, and a struct ``toxicity`` with ``p_<category>`` and ``is_<category>``.

    Null and empty texts have the probabilities of a text without words and no category. A column named ``toxicity`` is
    replaced.
    """
    kind = ", ".join(f"p_{c} double, is_{c} boolean" for c in chain.categories)

    @F.pandas_udf(kind)
    def judged(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        p = chain.predict(chain.features(texts))
        some = np.array([bool(t) for t in texts], bool)
        return pd.DataFrame({k: v for i, c in enumerate(chain.categories) for k, v in
                             ((f"p_{c}", p[:, i]), (f"is_{c}", (p[:, i] >= chain.thresholds[i]) & some))})

    return docs.withColumn("toxicity", judged(F.col(text).cast("string")))


def categories() -> dict[str, Column]:
    """The categories of the ``labels`` table, in chain order."""
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}


def rejected(docs: DataFrame, chain: Chain, category: str = "toxic", text: str = "text") -> DataFrame:
    """The documents that do not fall into the category, with their own columns."""
    @F.pandas_udf("boolean")
    def falls(texts: pd.Series) -> pd.Series:
        texts = [t or "" for t in texts]
        k = chain.categories.index(category)
        p = chain.predict(chain.features(texts))[:, k]
        return pd.Series([bool(t) and bool(x >= chain.thresholds[k]) for t, x in zip(texts, p)], dtype=bool)

    return docs.filter(~falls(F.col(text).cast("string")))
