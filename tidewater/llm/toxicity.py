"""Toxicity scores from a linear classifier with counterfactual regularisation.

The model is a logistic regression over the distinct words of a text. Besides the usual penalty, each labelled text that names a
group is paired with a copy in which the identity term is swapped for another of its group, and the squared change of the score is
penalised; so is the change that a bare, neutral mention of any term makes. Identity terms thus can't carry a score by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import settle

#: Labelled rows that a fit reads at most: those with the least hash of their doc_id. They are broadcast to find their texts.
MOST_LABELLED = 20_000

#: Words a model has at most, identity terms apart, and the least |z| of a word's log odds to be one of them.
MOST_WORDS = 2_000
LEAST_Z = 2.5

# Identity terms by group; a term may be swapped for any other of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("africans", "asians", "europeans", "latinos", "immigrants", "refugees"),
    ("african", "asian", "european", "latino", "immigrant", "refugee", "black", "white"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("blind", "deaf", "disabled", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Weights by word, at most MOST_WORDS and the identity terms, and a bias."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        found = words_of(text) & self.weights.keys()
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(self.weights[w] for w in found)), -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Whether a row may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_words(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(toxic, words) of the labelled rows that a fit reads; held-out rows and rows without a label never do.

    A doc_id with several labels counts as toxic if one says so.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"toxic": frame["toxic"], "words": [sorted(words_of(x)) for x in frame["text"]]})

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the sample is bounded by ``most`` rows of two numbers
    return texts.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInPandas(split, "toxic int, words array<string>")


def _vocabulary(rows: DataFrame) -> tuple[list[str], int, int]:
    """Words whose share differs most surely between toxic and other rows, and the number of either."""
    toxic, other = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    a, b = F.col("t") + 0.5, F.col("o") + 0.5
    odds = F.log(a / (toxic - F.col("t") + 0.5)) - F.log(b / (other - F.col("o") + 0.5))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = counts.where("t + o >= 3").withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(MOST_WORDS)
    return [r.word for r in best.select("word").collect()], int(toxic), int(other)


def _swaps(words: list[str], index: dict[str, int]) -> list[dict[int, float]]:
    """Feature differences between a text and its copies with one identity term swapped for the next of its group."""
    out, present = [], set(words)
    for group in IDENTITY_TERMS:
        for i, term in enumerate(group):
            other = group[(i + 1) % len(group)]
            if term in present and other not in present:
                out.append({index[term]: 1.0, index[other]: -1.0})
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, ridge: float = 0.2, fairness: float = 50.0, rounds: int = 600) -> Model:
    """A model from at most ``most`` labelled rows. Without labels of both kinds there is nothing to learn: every score is the smoothed
    share of toxic rows, kept below one half so that nothing is rejected for it.

    The driver gets the chosen words (2,000 at most) and, for each sampled row, which of them it has.
    """
    rows = settle(labelled_words(docs, labels, most), "toxicity-sample")
    chosen, toxic, other = _vocabulary(rows)
    bias = float(np.log((toxic + 0.5) / (other + 1.5)))
    if not toxic or not other:
        return Model(min(bias, -0.1))
    terms = sorted({t for group in IDENTITY_TERMS for t in group})
    names = sorted({*chosen, *terms})
    index = {w: i for i, w in enumerate(names)}
    wanted = F.array(*[F.lit(w) for w in names])
    found = rows.select("toxic", F.array_sort(F.array_intersect("words", wanted)).alias("words")).orderBy("toxic", "words").toPandas()
    y = found["toxic"].to_numpy(float)
    lists = [list(x) for x in found["words"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.array([index[w] for x in lists for w in x], dtype=np.int64)
    pairs = [d for x in lists for d in _swaps(x, index)]
    # a neutral mention against none, and against its swap
    pairs += [{index[t]: 1.0} for t in terms] + [d for t in terms for d in _swaps([t], index)]
    pair_row = np.repeat(np.arange(len(pairs)), [len(d) for d in pairs])
    pair_column = np.array([c for d in pairs for c in d], dtype=np.int64)
    pair_value = np.array([v for d in pairs for v in d.values()])
    size, width = len(y), len(names)
    weights, b = np.zeros(width), bias
    speed, scale = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights[column], size), -30, 30)))
        error = p - y
        change = np.bincount(pair_row, weights[pair_column] * pair_value, len(pairs))
        grad = np.bincount(column, error[row], width) + ridge * weights + fairness * np.bincount(pair_column, change[pair_row] * pair_value, width)
        grad = np.append(grad, error.sum())
        speed = 0.9 * speed + 0.1 * grad
        scale = 0.99 * scale + 0.01 * grad**2
        move = 0.1 / np.sqrt(step) * 3 * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-9)
        weights, b = weights - move[:-1], b - move[-1]
    return Model(float(b), {w: float(x) for w, x in zip(names, weights) if abs(x) > 1e-3})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int, 1 from 0.5). A missing text is scored as an empty one."""

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in texts], dtype=float)

    out = docs.withColumn("score", scores(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those predicted toxic, all columns kept; columns of theirs named score or predicted are no hindrance."""
    return score(docs.select(F.struct("*").alias("__doc"), "text"), model).where("predicted = 0").select("__doc.*")
